"""Evidence analytics expressed as Spark DataFrame operators."""
