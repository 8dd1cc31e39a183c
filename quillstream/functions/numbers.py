"""Numbers as a client prints them, and a classifier's output layer, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, digits: int = 4) -> Column:
    """A score with so many decimals, rounded by its exact binary value (0.01125 lies
    below the middle and gives 0.0112, where ``format_string`` rounds its print)."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits))


def kilobytes(size: Column) -> Column:
    """A file's size in whole kilobytes, halves up."""
    return F.concat(F.floor(size / 1024 + 0.5).cast("bigint").cast("string"), F.lit("KB"))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, from differences to the largest."""
    powers = F.transform(logits, lambda x: F.exp(x.cast("double") - F.array_max(logits).cast("double")))
    return F.transform(powers, lambda e: e / F.aggregate(powers, F.lit(0.0), lambda a, y: a + y))


def argmax(values: Column) -> Column:
    """Place of the largest value, from 0; the first of equals."""
    return F.array_position(values, F.array_max(values)) - 1
