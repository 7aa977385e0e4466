"""Column functions. Everything here is built from Spark's own expressions."""
