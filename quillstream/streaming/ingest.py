"""Pages as a stream: sanitised and chunked batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import chunk_pages
from ..operators.guard import sanitize

PAGES = "session_id string, file_ord int, page_number int, text string"


def pages_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Sanitised pages of the Parquet files that arrive in ``path``."""
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", max_files).parquet(path)
    return pages.withColumn("z", sanitize(F.col("text"))).select("session_id", "file_ord", "page_number", F.col("z.text").alias("text"), F.col("z.n").alias("n_redactions"))


def ingest(pages: DataFrame, out: str, checkpoint: str):
    """Start writing the chunks of each batch, by session; a batch that is tried
    again replaces what it wrote, as its number is part of its folder."""

    def write(batch: DataFrame, number: int) -> None:
        chunks = chunk_pages(batch, file=("session_id", "file_ord"))
        chunks.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
