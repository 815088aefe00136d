"""folioquery: cited-passage retrieval over document corpora, on Spark DataFrames."""

__version__ = "0.1.0"
