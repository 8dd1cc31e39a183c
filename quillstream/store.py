"""Written tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine gets a temporary folder; on a
    cluster nothing can stand in for it, and this raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillstream-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, by: str | None = None, scope: list | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, in folders by a column if one is
    named, and read it back.

    The result has no lineage to recompute, survives lost executors, and is
    column-pruned and compressed, unlike a checkpoint of rows.  ``forget``
    deletes it when nothing reads it any more.  ``scope``: the ``tidy`` call that it
    belongs to (see ``current``), where that is not the innermost.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    schema = df.schema
    (df.write.partitionBy(by) if by else df.write).option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._saved_at = path
    scope = current() if scope is None else scope
    if scope is not None:
        scope.append(out)
    return out


#: Tables written within each ``tidy`` call that runs.
_SCOPES: list[list[DataFrame]] = []


def current() -> list[DataFrame] | None:
    """The innermost ``tidy`` call that runs."""
    return _SCOPES[-1] if _SCOPES else None


def tidy(function):
    """Delete what ``function`` saved on its way, but for the tables that the
    DataFrame it returns reads; those are left to the caller."""

    @functools.wraps(function)
    def run(*args, **kwargs):
        _SCOPES.append([])
        out = None
        try:
            out = function(*args, **kwargs)
            return out
        finally:
            made = _SCOPES.pop()
            read = "\n".join(out.inputFiles()) if made and isinstance(out, DataFrame) else ""
            kept = [t for t in made if t._saved_at.rpartition("/")[2] in read]
            forget(*[t for t in made if not any(t is k for k in kept)])
            if _SCOPES:
                _SCOPES[-1].extend(kept)

    return run


def forget(*tables: DataFrame | None) -> None:
    """Delete what ``saved`` wrote for these tables (others are left alone): no
    plan that is still to run may read them."""
    for t in tables:
        path = t.__dict__.get("_saved_at") if t is not None else None
        if path:
            folder = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
