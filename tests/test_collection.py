import random

import pytest
from pyspark.sql import functions as F

from quillstream.operators import collection, index, retrieval

SCHEMA = "session_id string, file_id string, chunk_no int, page_number int, text string, embedding array<double>"


def chunks_of(spark, files):
    rows = [(s, f, i, i + 1, t, [1.0, float(i)]) for (s, f), texts in files.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def rebuilt(spark, files):
    return index.Index(collection.numbered(chunks_of(spark, files), 0))


def test_changes_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    text = lambda: rng.choice([None, "", *[" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(6)]])
    store, files = collection.Collection(spark, f"file://{tmp_path}/c"), {}
    for step in range(4):
        came = {(f"s{rng.randrange(2)}", f"f{rng.randrange(8)}"): [text() for _ in range(rng.randrange(1, 5))] for _ in range(4)}
        again = {k: v for k, v in files.items() if rng.random() < 0.3 and k not in came}  # as they were
        gone = [k for k in files if k not in came and k not in again and rng.random() < 0.3]
        assert store.change(chunks_of(spark, came | again), spark.createDataFrame(gone, "session_id string, file_id string")) == step + 1
        files = {k: v for k, v in files.items() if k not in gone} | came
        got, want = store.index(), rebuilt(spark, files)
        rows = lambda df: sorted(map(str, df.collect()))
        assert rows(got.sizes.select("session_id", "n", "words", F.round("avgdl", 9))) == rows(want.sizes.select("session_id", "n", "words", F.round("avgdl", 9)))
        terms = lambda ix: rows(ix.terms.select("session_id", "term", "df", F.round("idf", 9)))
        assert terms(got) == terms(want)
        assert rows(store.chunks().select("session_id", "file_id", "chunk_no", "text", "embedding")) == rows(chunks_of(spark, files).select("session_id", "file_id", "chunk_no", "text", "embedding"))
    asked = spark.createDataFrame([(i, f"s{i % 2}", " ".join(rng.choices(words, k=4))) for i in range(8)], "query_id long, session_id string, question string")
    # ties may fall otherwise: chunks are numbered as they came
    place = lambda ix, n: {(r["query_id"], r["keyword_rank"]) for r in retrieval.keyword_ranks(ix, asked, n).collect()}
    assert place(store.index(), 60) == place(rebuilt(spark, files), 60)
    live = {r["chunk_ord"] for r in store.chunks().select("chunk_ord").collect()}
    assert {r["chunk_ord"] for r in retrieval.keyword_ranks(store.index(), asked, 60).collect()} <= live


def test_a_failed_change_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    store = collection.Collection(spark, f"file://{tmp_path}/c")
    store.change(chunks_of(spark, {("s", "a"): ["red fox", "red hen"]}))
    before = sorted(map(str, store.index().terms.collect()))

    def broken(*args):
        raise RuntimeError("lost half way")

    with monkeypatch.context() as m:
        m.setattr(collection.Collection, "_publish", broken)
        with pytest.raises(RuntimeError):
            store.change(chunks_of(spark, {("s", "b"): ["blue hen"]}))
    assert store.version() == 1 and sorted(map(str, store.index().terms.collect())) == before
    with pytest.raises(Exception):  # a number that is taken
        store._publish(1, {})
    assert store.change(chunks_of(spark, {("s", "b"): ["blue hen"]})) == 2
    assert {r["file_id"] for r in store.files(1).collect()} == {"a"} and {r["file_id"] for r in store.files().collect()} == {"a", "b"}


def test_compacting_keeps_what_is_there(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    store, files = collection.Collection(spark, f"file://{tmp_path}/c"), {}
    assert store.compact() == 0 and store.vacuum() == 0
    for step in range(4):
        came = {("s", f"f{rng.randrange(6)}"): [" ".join(rng.choices(words, k=5)) for _ in range(1 + 4 * (step == 0))] for _ in range(3)}
        store.change(chunks_of(spark, came))
        files |= came
    asked = spark.createDataFrame([(i, "s", " ".join(rng.choices(words, k=3))) for i in range(6)], "query_id long, session_id string, question string")
    shown = ["session_id", "file_id", "chunk_no", "page_number", "text", "embedding"]
    rows = lambda df: sorted(map(str, df.collect()))
    terms = lambda ix: rows(ix.terms.select("session_id", "term", "df", F.round("idf", 9)))

    def same():
        want = rebuilt(spark, files)
        assert rows(store.chunks().select(shown)) == rows(chunks_of(spark, files).select(shown)) and terms(store.index()) == terms(want)
        place = lambda ix: sorted((r["query_id"], r["keyword_rank"]) for r in retrieval.keyword_ranks(ix, asked, 60).collect())
        assert place(store.index()) == place(want)

    # segments with little left are merged, the others stay
    left = {r["segment"]: r["n"] for r in store.files().groupBy("segment").agg(F.sum("n").alias("n")).collect()}
    small = [s for s in store.manifest()["segments"] if left.get(s, 0) < 5]
    assert store.compact(below=5) == 5 and len(store.manifest()["segments"]) == 4 - len(small) + 1
    same()
    before = rows(store.chunks(4).select(shown))
    assert before == rows(chunks_of(spark, files).select(shown))  # the old snapshot is there
    version = store.compact()
    assert len(store.manifest()["segments"]) == 1 and index.vocabulary(store.postings()).filter("term <> ''").count() == store.index().terms.count()
    same()
    assert store.compact() == version and store.vacuum() > 0
    same()
    with pytest.raises(Exception):
        store.chunks(1).count()
    # changes go on after it
    store.change(chunks_of(spark, {("s", "new"): ["w1 w2"]}), spark.createDataFrame([("s", next(iter(files))[1])], "session_id string, file_id string"))
    files.pop(next(iter(files)))
    files["s", "new"] = ["w1 w2"]
    same()


def test_a_change_counts_only_what_changes(spark, tmp_path, monkeypatch):
    # before, every change read and wrote the whole vocabulary
    monkeypatch.setattr(collection, "PARTS", 2)
    store, files = collection.Collection(spark, f"file://{tmp_path}/c"), {("s", "a"): ["red fox of old", None], ("s", "b"): ["red hen"]}
    store.change(chunks_of(spark, files))
    rows = lambda ix: sorted(map(str, ix.terms.select("term", "df", F.round("idf", 9)).collect()))
    for text, parts in (("blue hen", 2), ("green", 1)):
        files["s", "b"] = [text]
        store.change(chunks_of(spark, {("s", "b"): [text]}))
        assert len(store.manifest()["vocabulary"]) == parts
        there = {r["term"] for r in store._table(store.manifest()["vocabulary"][-1]).collect()}
        assert ("fox" in there) == (parts == 1) and ("red" in there)
        assert rows(store.index()) == rows(rebuilt(spark, files))
