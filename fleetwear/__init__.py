"""Fleet maintenance analytics expressed as Spark DataFrame operations."""
