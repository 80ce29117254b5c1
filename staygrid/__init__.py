"""staygrid: rental-marketplace analytics as set-oriented Spark jobs."""
