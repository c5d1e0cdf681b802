"""Hospital operations analytics as Spark DataFrame operators."""
