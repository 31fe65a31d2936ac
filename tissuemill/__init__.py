"""Object-feature analytics as ordinary Spark DataFrame operations."""
