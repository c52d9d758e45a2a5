"""Points-of-interest search and analytics as Spark DataFrame operators."""
