"""Operators that prepare training data for language models.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrames to a DataFrame; ``queries`` holds the registered queries over the
synthetic tables.
"""
