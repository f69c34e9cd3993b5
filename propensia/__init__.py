"""Customer feature tables, profiling, cleaning and propensity scoring on Spark."""
