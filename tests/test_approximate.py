import random

import pytest
from pyspark.sql import functions as F

from quillstream.operators import approximate, retrieval


@pytest.fixture(scope="module")
def chunks(spark, tmp_path_factory):
    """Vectors around forty directions, in two sessions."""
    rng = random.Random(4)
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    middle = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    rows = [(i, f"t{i}", 1, unit([m + rng.gauss(0, 0.4) for m in middle[rng.randrange(40)]]) if i % 50 else None, f"s{i % 2}") for i in range(3000)]
    path = f"file://{tmp_path_factory.mktemp('vectors')}"
    spark.createDataFrame(rows, "chunk_ord long, text string, page_number int, embedding array<double>, session_id string").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_recall_and_exactness(spark, chunks):
    asked = chunks.filter("chunk_ord % 75 = 1").select(F.col("chunk_ord").alias("query_id"), "session_id", F.col("embedding").alias("vector"))
    lists = approximate.VectorLists(chunks)
    exact = retrieval.semantic_ranks(chunks, asked, 60)
    got = approximate.recall(exact, approximate.approximate_ranks(lists, asked, 60)).agg(F.sum("found"), F.sum("n")).first()
    assert got[1] == 40 * 60 and got[0] >= 0.9 * got[1]
    assert 1 <= approximate.tuned(lists, asked, 60, 0.5) <= approximate.tuned(lists, asked, 60, 0.99) <= lists.lists
    rows = lambda df: sorted(map(tuple, df.select("query_id", "chunk_ord", "semantic_rank", "session_id").collect()))
    assert rows(approximate.approximate_ranks(lists, asked, 60, probes=lists.lists)) == rows(exact)
    # a question reads the folders of its lists only
    one = approximate.approximate_ranks(lists, asked.limit(1), 5, probes=1)
    assert one.count() == 5 and {r["session_id"] for r in one.collect()} == {"s1"}


def test_without_vectors(spark, chunks):
    asked = spark.createDataFrame([(1, [1.0] * 16)], "query_id long, vector array<double>")
    assert approximate.approximate_ranks(approximate.VectorLists(chunks.filter("embedding IS NULL")), asked, 5).count() == 0
