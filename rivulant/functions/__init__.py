"""Column-level helpers built only from native Spark expressions."""
