"""rosterlens: workforce analytics as Spark DataFrame operators."""
