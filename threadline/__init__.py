"""threadline: evidence linkage analytics as Spark DataFrame operators."""
