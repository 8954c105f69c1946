"""Statement digests for SQL query logs, as Spark DataFrame operators."""
