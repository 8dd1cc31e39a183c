"""Registered plans read all rows of their tables and the whole of each text."""

import pytest
from pyspark.sql import functions as F

from quillstream.operators import chunking
from quillstream.plans import registry


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Twelve documents, but vectors for three numbers only."""
    folder = f"file://{tmp_path_factory.mktemp('tables')}"
    texts = [f"word{i} common text of some length" for i in range(12)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, [float(i == k) for k in range(3)]) for i in range(3)], "vec_id bigint, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(0, "word11")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_every_document_is_indexed_and_has_a_vector(spark, tables):
    df = {r["term"]: r["df"] for r in registry.bm25_terms(spark, tables).collect()}
    assert df["common"] == 12 and df["word11"] == 1
    got = {r["chunk_ord"]: r["keyword_rank"] for r in registry.bm25_topk(spark, tables).collect()}
    assert len(got) == 12 and got[11] == 0
    near = sorted((r["semantic_rank"], r["chunk_ord"]) for r in registry.semantic_topk(spark, tables).collect())
    assert near == [(0, 0), (1, 3), (2, 6), (3, 9), (4, 1)]  # documents share vectors in turn


def test_fail_open_judges_every_document(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(i, f"line {i}\nmore") for i in range(16)], "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    got = {r["doc_id"]: r["grp"] for r in registry.fail_open_filter(spark, folder).collect()}
    clean, whole = {0, 4, 8, 12, 5, 6, 7, 9, 11, 14, 15}, {2, 3}  # the pair 2, 3 has no clean member
    assert set(got) == clean | whole and all(g == i // 2 for i, g in got.items())


def test_source_strip_reads_whole_texts(spark, tmp_path):
    folder, long = f"file://{tmp_path}", "long " * 50 + "end"
    spark.createDataFrame([(0, long), (1, long + " Source: page 3 and more"), (2, "short"), (3, long)], "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    got = {r["doc_id"]: r["answer"] for r in registry.source_strip(spark, folder).collect()}
    assert got == {0: long, 1: long, 2: "short", 3: long}


def test_caps_are_those_of_the_operator_and_blank_rows_replace_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}"
    text = "\n".join(f"line {i}" for i in range(30))
    spark.createDataFrame([(i, text) for i in range(23)], "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    sizes = {r["doc_id"]: r["count"] for r in registry.multi_file_cap(spark, folder).groupBy("doc_id").count().collect()}
    assert sizes == {i: 10 for i in range(23)}  # a section for every third line
    assert sorted(r["doc_id"] for r in registry.row_normalize(spark, folder).collect()) == list(range(23))
    small = chunking.cap_files(registry._chunks(spark, folder, 3).withColumn("session_id", F.lit(0)), "session_id", 25)
    assert small.count() == 25 and small.groupBy("file_ord").count().agg(F.max("count")).first()[0] == 3
