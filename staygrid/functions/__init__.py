"""Column functions: geodesy, text rules, dates."""
