"""Continuous forms of the folds."""
