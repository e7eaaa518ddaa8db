"""tidewright: disclosure analytics as Spark DataFrame operations."""
