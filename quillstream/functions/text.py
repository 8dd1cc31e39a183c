"""Text functions with Unicode white space, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = r"[\s\x1c-\x1f]"


def java(pattern: str, ignore_case: bool = True, dot_all: bool = False) -> str:
    """A pattern written with plain ``\\s`` and ``\\w``, for Spark: Unicode classes,
    only ``\\n`` ends a line, flags in a group of their own."""
    body = pattern.replace(r"\s", _SPACE).replace(r"\w", r"[\p{L}\p{N}_]")
    return f"(?{'i' * ignore_case}uUd{'s' * dot_all}:{body})"


def any_of(patterns: list[str]) -> str:
    return "|".join(patterns)


def strip(c: Column) -> Column:
    """Without white space at both ends.  A run inside the text is looked at once:
    only its first character may begin a match, and it gives nothing back."""
    return F.regexp_replace(c, rf"(?U)^{_SPACE}++|(?<!{_SPACE}){_SPACE}++\z", "")


def words(c: Column) -> Column:
    """Lower-cased parts between white space; punctuation stays."""
    return F.filter(F.split(F.lower(c), rf"(?U){_SPACE}+"), lambda x: x != "")


def blank(c: Column) -> Column:
    return strip(c) == ""


def non_empty(*columns: Column) -> Column:
    """The first that is neither null nor an empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work that is
    heavy on each row; rows move only if the input has fewer splits than that."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def bind(value: Column, use) -> Column:
    """``use(value)`` with value computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def first_of(values: list[str], holds) -> Column:
    """The first of some literals for which ``holds``; null if there is none."""
    return F.get(F.filter(F.array(*[F.lit(v) for v in values]), holds), F.lit(0))
