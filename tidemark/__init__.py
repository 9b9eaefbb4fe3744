"""Market-signal analytics as Spark DataFrame operators."""
