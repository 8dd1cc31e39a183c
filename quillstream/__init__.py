"""quillstream: grounded question answering and corpus preparation over Spark DataFrames."""

__version__ = "0.1.0"
