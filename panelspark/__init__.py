"""Panel time-series analytics on Spark: screening, event studies, validation."""
