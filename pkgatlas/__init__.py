"""Package-ecosystem analytics as Spark DataFrame operators."""
