"""Sessions that a task holds are ranked there, equal to plain Python and to the postings' way."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillstream.operators import by_session, index, retrieval


def corpus(spark, sizes):
    r, rows, n = random.Random(5), [], 0
    for s, size in sizes.items():
        for _ in range(size):
            text = None if n % 17 == 3 else " ".join(r.choice("red fox hen owl sees the old blue barn".split()) for _ in range(n % 6 + 1))
            rows.append((n, s, text, n % 4 + 1, None if n % 11 == 5 else [math.cos(n), math.sin(n)]))
            n += 1
    return spark.createDataFrame(rows, "chunk_ord bigint, session_id string, text string, page_number int, embedding array<double>")


def asked(spark):
    rows = [(f"{s}{i}", s, q, [math.cos(i), math.sin(i)] if i else None) for s in ("a", "b", "c", "none") for i, q in enumerate(["red hen red", "zzz", "the old owl sees", None])]
    return spark.createDataFrame(rows, "query_id string, session_id string, question string, vector array<double>")


def listed(df, rank):
    return sorted(tuple(r) for r in df.select("query_id", "chunk_ord", rank, "text", "page_number").collect())


@pytest.mark.parametrize("held", [2048, 10])
def test_ranks_of_sessions(spark, monkeypatch, held):
    c, q = corpus(spark, {"a": 12, "b": 3, "c": 40}), asked(spark)
    whole = index.Index(c, whole=True)
    want = listed(retrieval.keyword_ranks(whole, q, 5), "keyword_rank"), listed(retrieval.semantic_ranks(c, q, 5), "semantic_rank")
    terms = lambda ix: sorted((r[0], r[1], r[2], round(r[3], 9)) for r in ix.terms.collect())
    monkeypatch.setattr(by_session, "SESSION_CHUNKS", held)
    monkeypatch.setattr(retrieval, "QUESTIONS_AT_ONCE", 2)
    ix = index.Index(c)
    assert (ix.large is None) == (held > 40)
    assert listed(retrieval.keyword_ranks(ix, q, 5), "keyword_rank") == want[0]
    assert listed(retrieval.semantic_ranks(c, q, 5, index=ix), "semantic_rank") == want[1]
    assert terms(ix) == terms(whole)
    fused = lambda ix: sorted(map(tuple, retrieval.hybrid_query(ix, q, 3).withColumn("rrf_score", F.round("rrf_score", 12)).collect()))
    assert fused(ix) == fused(whole) and {r[0][0] for r in fused(ix)} == {"a", "b", "c"}


def test_many_questions_do_not_pass_over_all_chunks(spark, monkeypatch):
    # before, each block of questions read all chunks, whatever sessions they belong to
    def never(*_):
        raise AssertionError("questions in blocks")

    monkeypatch.setattr(retrieval, "in_blocks", never)
    ix = index.Index(corpus(spark, {"a": 12, "b": 3}))
    assert retrieval.hybrid_query(ix, asked(spark), 3).count() == 4 * 3 * 2


def test_terms_of_sessions_move_texts_once(spark):
    # before, every word of every chunk was a row of a shuffle and of a written table
    ix = index.Index(corpus(spark, {"a": 12, "b": 3}))
    plan = ix.terms._jdf.queryExecution().optimizedPlan().toString()
    assert "postings" not in plan and plan.count("Repartition") == 1 and "Aggregate" not in plan
