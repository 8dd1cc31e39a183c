import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstream.llm import ngram_join as j
from quillstream.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return sorted(((r[0], len(sets[k]), r[0] if not sets[k] else least.get(find(k))) for k, r in enumerate(rows)), key=str)


def test_join_equals_brute_force(docs, rows):
    got = sorted((tuple(r) for r in j.join(docs).collect()), key=str)
    assert got == brute(rows)


def test_chain_and_threshold(spark):
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(12):  # each like the next, the ends unlike
        rows.append((100 - i, " ".join(words[i * 4 : i * 4 + 64])))
    exact = [f"v{i}" for i in range(49)]  # 45 shingles; 36 of 45 are exactly 80 %
    rows += [(1, " ".join(exact)), (2, " ".join(exact[:40])), (3, " ".join(exact[:39]))]
    rows += [(200 + i, " ".join(exact[:30] + [f"u{i}"] + exact[30:])) for i in range(8)]
    got = sorted((tuple(r) for r in j.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert got == brute(rows)


def test_large_group_just_below_the_threshold(spark):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(150):
        near = list(base)
        for k in rng.choice(150, rng.integers(0, 6), replace=False):
            near[k] = f"x{rng.integers(0, 40)}"
        rows.append((i, " ".join(near)))
    got = sorted((tuple(r) for r in j.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert got == brute(rows)


def test_one_of_each(docs, rows):
    kept = j.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    groups = {(c, n) if n else (i, n) for i, n, c in brute(rows)}
    named = {c for c, n in groups if c is not None}
    assert {i for i in ids if i is not None} == named
    assert len(ids) == len(set(ids) - {None}) + ids.count(None)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 40), min_size=1), st.sets(st.integers(0, 40), min_size=1))
def test_prefixes_share_what_is_required(x, y):
    """Similar sets share min(l, l') tokens of their prefixes, whatever l each takes."""
    both = len(x & y)
    if 100 * both < 80 * len(x | y):
        return
    for lx in range(1, min(4, j.least_shared(len(x))) + 1):
        for ly in range(1, min(4, j.least_shared(len(y))) + 1):
            px = set(sorted(x)[: len(x) - j.least_shared(len(x)) + lx])
            py = set(sorted(y)[: len(y) - j.least_shared(len(y)) + ly])
            assert len(px & py) >= min(lx, ly)


def test_prefix_choice_prefers_longer_prefixes_when_postings_are_cheap_to_touch():
    df = np.array([50.0] * 10 + [51.0] * 90)
    matches, k = j.choose_prefix(100, 0, df)
    assert matches > 1 and k == 100 - 80 + matches
    assert j.choose_prefix(100, 90, np.array([2.0] * 10)) == (1, 0)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a bigint, b bigint")
    got = {r["node"]: r["comp"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


@pytest.mark.parametrize("at_once", [1, 7, 300, 250_000])
def test_components_contracted_or_propagated(spark, monkeypatch, at_once):
    """Equal whether tasks end the work or labels are propagated between their stars."""
    from quillstream.llm import components as c

    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 400, (2, 180))
    a[:40] = 1000  # one node with many edges
    monkeypatch.setattr(c, "EDGES_AT_ONCE", at_once)
    edges = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a bigint, b bigint").repartition(4)
    got = {r["node"]: r["comp"] for r in components(edges).collect()}
    least = {int(x): int(x) for x in [*a, *b]}
    for _ in range(len(least)):
        for x, y in zip(a.tolist(), b.tolist()):
            least[x] = least[y] = min(least[x], least[y])
    # a node that has no edge but to itself needs no label
    assert {n: got.get(n, n) for n in least} == least and set(got) <= set(least)


def test_components_of_a_small_graph_are_few_jobs(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a bigint, b bigint")
    spark.sparkContext.setJobGroup("components", "components")
    try:
        components(edges)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 5
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a b c"), (None, "a b c")]])
def test_tiny_tables(spark, rows):
    got = sorted((tuple(r) for r in j.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("at_once", [0, 1_000_000])
def test_one_of_each_with_keys_sent_either_way(docs, monkeypatch, at_once):
    monkeypatch.setattr(j, "KEYS_AT_ONCE", at_once)
    kept = j.one_of_each(docs).collect()
    keys = [(r["doc_id"], r["text"]) for r in kept]
    # rows repeated under one id and text stay once
    assert len(keys) == len(set(keys))
    labels = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in j.join(docs).collect()}
    named = [labels[i, n] for i, n in labels if n and (i, n) in labels]
    assert {r["doc_id"] for r in kept if r["doc_id"] is not None} >= {c for c in named if c is not None}


def exchanged(spark, words, monkeypatch, operator):
    """Rows that blocks send to ranges, of a corpus of so many words in small blocks and ranges."""
    from quillstream.llm import blocks, lm_score

    rng = np.random.default_rng(words)
    texts = [" ".join(map(str, rng.integers(0, 1 << 30, 50))) for _ in range(words // 50)]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1)
    if operator == "op3":
        monkeypatch.setattr(j, "BLOCK", 200)
        sent = docs.select("text").mapInArrow(j._blocks(words // 10, np.zeros(0, np.uint64)), j.BLOCKS).filter("kind <> 1")
    else:
        packed = blocks.packed(docs.selectExpr("false AS deleted", "doc_id", "false AS held_out", "text"), "few", 200)
        sent = packed.mapInArrow(lm_score._ask(words // 10), lm_score.ASKED).filter(f"key >= {words // 10}")
    return sent.count()


@pytest.mark.parametrize("operator, most", [("op3", 1), ("op10", 3)])
def test_rows_sent_are_no_more_than_the_ngrams(spark, monkeypatch, operator, most):
    for words in (2_000, 16_000):  # blocks and ranges both grow eightfold, their product 64 times
        documents = words // 50
        assert exchanged(spark, words, monkeypatch, operator) <= most * (words + documents)
