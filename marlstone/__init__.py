"""Document-retrieval analytics on Spark: DataFrame operators, expression libraries and streaming jobs."""

__version__ = "0.1.0"
