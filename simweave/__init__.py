"""simweave: duplicate and similarity analytics as Spark DataFrame operators."""
