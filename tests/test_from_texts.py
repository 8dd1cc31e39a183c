"""Few questions are asked of the texts themselves: equal to the postings' way, and no word is stored."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstream.functions.text import words
from quillstream.operators import index, retrieval


def corpus(spark, n, rare=""):
    r, rows = random.Random(3), []
    for i in range(n):
        # words of most chunks (their idf is the mean's) and of few, runs of equal scores, no words
        text = None if i % 17 == 3 else "" if i % 19 == 4 else " ".join(r.choices(["the", "old", "fox", "hen", "owl", "Red", f"w{i % 40}", f"v{i}{rare}"], [9, 6, 3, 2, 1, 1, 1, 1], k=i % 9 + 1))
        rows.append((i * 7 % n, "ab"[i % 3 == 0], text, i % 4 + 1))
    return spark.createDataFrame(rows, "chunk_ord bigint, session_id string, text string, page_number int").repartition(3)


def asked(spark):
    said = ["the old fox", "red red hen w3", "zzz", None, "the", "owl w1 v12 the the"]
    return spark.createDataFrame([(i, s, q) for i, (s, q) in enumerate((s, q) for s in ("a", "b", "none") for q in said)], "query_id bigint, session_id string, question string")


def ranks(ix, q, width):
    return sorted(map(tuple, retrieval.keyword_ranks(ix, q, width).select("query_id", "chunk_ord", "keyword_rank").collect()))


@pytest.mark.parametrize("n, at_once", [(300, 4 << 20), (300, 40), (9, 1)])
def test_texts_and_postings_agree(spark, monkeypatch, n, at_once):
    monkeypatch.setattr(index, "BYTES_AT_ONCE", at_once)
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    monkeypatch.setattr(retrieval, "SCORED_AT_ONCE", 4)
    c, q = corpus(spark, n), asked(spark)
    a, b = index.Index(c, whole=True), index.Index(c, whole=True)
    assert b.entries is not None and b.listed
    terms = lambda ix: sorted((r[0], r[1], r[2], round(r[3], 9)) for r in ix.terms.collect())
    assert terms(a) == terms(b) and (a.n, a.avgdl) == (b.n, b.avgdl)
    assert ranks(a, q, 20) == ranks(b, q, 20)
    assert not a.listed


def test_negative_weights_leave_other_chunks_before(spark):
    # two words of nearly all chunks: even the mean of all idfs is negative
    rows = [(i, "all more" if i else "none", 1) for i in range(30)]
    c = spark.createDataFrame(rows, "chunk_ord bigint, text string, page_number int")
    q = spark.createDataFrame([(0, "all"), (1, "zzz")], "query_id bigint, question string")
    a, b = index.Index(c), index.Index(c)
    assert b.entries is not None and a.asked(q).agg(F.min("weight")).first()[0] < 0
    assert ranks(a, q, 3) == ranks(b, q, 3) == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 0), (1, 1, 1), (1, 2, 2)]


def test_words_are_those_of_spark(spark):
    # every character of the first plane between, before and after letters, and what lower-casing makes of it
    texts = [f"{chr(c)}A{chr(c)}{chr(c)}b {chr(c)}" for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000] + ["", " ", None, "ΑΣ İI ß", "one", "\U0001F600 x"]
    df = spark.createDataFrame(pa.table({"text": pa.array(texts)}))
    got = df.select(F.lower("text").alias("l"), words(F.col("text")).alias("w")).toArrow()
    row, coded, n = index.tokens(got.column("l").combine_chunks())
    want = [w or [] for w in got.column("w").to_pylist()]
    assert n.tolist() == list(map(len, want)) and row.tolist() == [i for i, w in enumerate(want) for _ in w]
    assert coded.cast(pa.string()).to_pylist() == [x for w in want for x in w]


def test_best_is_that_of_a_whole_sort():
    r = np.random.default_rng(1)
    best, score, number = retrieval._Best(4, 5), r.integers(0, 6, (4, 60)).astype(float), r.permutation(60)
    score[r.random((4, 60)) < 0.3] = -np.inf
    score[3, 3:] = -np.inf
    for at in range(0, 60, 7):
        of = np.array([3, 1, 2]) if at % 2 else np.array([0, 2, 1])
        best.offer(of, score[of, at : at + 7], number[at : at + 7])
    for i in (1, 2):
        want = sorted((-s, n) for s, n in zip(score[i], number) if s > -np.inf)[:5]
        assert [(-s, n) for s, n in zip(best.score[i], best.number[i])] == want


def test_few_questions_store_no_postings(spark, monkeypatch):
    # before, every word of every chunk was sorted and written for whatever number of questions
    def never(*_):
        raise AssertionError("postings")

    monkeypatch.setattr(index, "postings", never)
    ix = index.Index(corpus(spark, 40), whole=True)
    assert ix.terms.count() and len(ranks(ix, asked(spark), 5)) == 2 * 6 * 5
