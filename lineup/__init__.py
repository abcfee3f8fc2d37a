"""lineup: roster and talent analytics as Spark DataFrame operators."""
