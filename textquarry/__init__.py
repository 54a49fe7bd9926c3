"""Schema-driven extraction over text, expressed as Spark DataFrame operations."""
