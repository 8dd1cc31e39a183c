"""Session helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import spread
from ..store import forget, new_folder, saved, shared_dir, tidy

__all__ = ["forget", "hot_keys", "join_hot", "new_folder", "release", "replayable", "row_key", "saved", "shared_dir", "shuffle_partitions", "spread", "tidy"]

#: Keys that are told apart as hot, at most.
HOT_KEYS = 10_000


def replayable(df: DataFrame, name: str) -> DataFrame:
    """``df`` if a task that is run again meets its rows in the same order: if it is
    read from files without an exchange; a written copy otherwise."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return df if "FileScan" in plan and "Exchange" not in plan and "Aggregate" not in plan else saved(df, name)


def hot_keys(left: DataFrame, key: str) -> DataFrame:
    """Keys that more than one in HOT_KEYS rows of ``left`` have: HOT_KEYS at most."""
    counts = left.groupBy(key).count()
    n = left.count()
    return saved(counts.filter((F.col("count") > max(n // HOT_KEYS, 1)) & F.col(key).isNotNull()).select(key), "hot-keys")


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``left`` with the columns of ``right``, which has one row for each ``key``.

    The rows of ``right`` of the ``hot_keys`` of ``left`` (``hot``, where they are known) are
    broadcast, so that no task gathers a hot key's rows.
    ``left`` is read three times and should be a written table."""
    hot = hot_keys(left, key) if hot is None else hot
    some = right.join(F.broadcast(hot), key, "left_semi")
    few = left.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(some), key, how)
    rest = left.join(F.broadcast(hot), key, "left_anti").join(right, key, how)
    return few.unionByName(rest)


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """A 128-bit key of a row's id and whole text, struct<a, b>: equal for repeated rows."""
    return F.struct(F.xxhash64(F.col(doc_id), F.col(text)).alias("a"), F.xxhash64(F.lit(7), F.col(text), F.col(doc_id)).alias("b"))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now: it does so when the
    driver's garbage collector finds them unused."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
