"""lociflow: interval-track analytics expressed as Spark DataFrame plans."""
