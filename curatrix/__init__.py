"""Dataset curation, auditing and evaluation as lazy Spark DataFrame operators."""
