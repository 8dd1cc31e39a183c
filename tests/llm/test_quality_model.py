import math
import re
from collections import Counter, defaultdict

import pytest

from quillstream.llm import blocks, quality_model
from quillstream.llm.textnum import U


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


class Plain:
    """Interpolated modified Kneser-Ney by dictionaries."""

    def __init__(self, texts):
        c3 = Counter()
        for t in texts:
            w = ["<s>", "<s>", *words_of(t), "</s>"]
            c3.update(zip(w, w[1:], w[2:]))
        c2, c1 = Counter(), Counter()
        for (_, v, w), c in c3.items():
            c2[v, w] += c if v == "<s>" else 1
        for _, w in c2:
            c1[w] += 1
        self.counts = [Counter({(w,): c for w, c in c1.items()}), c2, c3]
        self.d = [quality_model.discounts(*[sum(c == k for c in x.values()) for k in (1, 2, 3, 4)]) for x in self.counts]
        self.follow = [defaultdict(list) for _ in range(3)]
        for x, f in zip(self.counts, self.follow):
            for gram, c in x.items():
                f[gram[:-1]].append(c)
        self.floor = 1 / (len(c1) + 1)

    def p(self, gram):
        if not gram:
            return self.floor
        k = len(gram) - 1
        below, after, d = self.p(gram[1:]), self.follow[k].get(gram[:-1]), self.d[k]
        if not after:
            return below
        c = self.counts[k][gram]
        total = sum(after)
        left = sum(d[min(x, 3) - 1] for x in after)
        return (c - d[min(c, 3) - 1] if c else 0) / total + left / total * below

    def log10(self, text):
        w = ["<s>", "<s>", *words_of(text), "</s>"]
        return sum(math.log10(self.p(g)) for g in zip(w, w[1:], w[2:]))


def test_perplexity_equals_a_plain_cross_fitted_model(spark, docs, rows):
    trusted = [r[0] for r in rows if r[0] is not None and r[0] % 3]
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted] + [(0, 0, 1)], "doc_id bigint, quality int, toxic int")
    hashes = {r["text"]: r["h"] for r in docs.selectExpr("text", "xxhash64(text) as h").distinct().collect()}
    fold = lambda t: hashes[t] % 2
    texts = {r[1] for r in rows if r[0] in trusted and r[1] is not None}
    models = [Plain([t for t in texts if fold(t) != k]) for k in (0, 1)]
    got = Counter((r["doc_id"], r["n_tokens"], round(r["log10_prob"], 3)) for r in quality_model.classify(docs, labels).collect())
    want = Counter()
    for doc_id, text, *_ in rows:
        want[doc_id, len(words_of(text)) + 1, round(models[0 if text is None else fold(text)].log10(text), 3)] += 1
    # sums of 32-bit probabilities: a last digit may differ
    close = lambda a, b: a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-5, abs=2e-3)
    order = lambda c: sorted(c.elements(), key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2]))
    assert len(order(got)) == len(order(want)) and all(close(a, b) for a, b in zip(order(got), order(want)))


def test_plain_model_sums_to_one():
    m = Plain(["a b c d", "a b c e", "b c d", "a b a b c", "c d e a b"])
    for history in (("a", "b"), ("zz", "b"), ("zz", "yy"), ("<s>", "<s>")):
        assert sum(m.p((*history, w)) for w in ["a", "b", "c", "d", "e", "</s>", "unseen"]) == pytest.approx(1)


def test_sample_is_whole_distinct_and_bounded(spark):
    rows = [(i, f"text {i % 60} " + "x" * (i % 60)) for i in range(120)] + [(500, "y" * 5000), (501, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    good = docs.select("doc_id").distinct()
    got = quality_model.sample(docs, good, 1000).collect()
    texts = [r["text"] for r in got]
    assert len(set(texts)) == len(texts) and set(texts) <= {t for _, t in rows}
    for k in (0, 1):
        assert 500 < sum(len(r["text"]) for r in got if r["fold"] == k) <= 1000
    assert len(quality_model.sample(docs, good, 10**6).collect()) == 61


def test_joins_by_shuffle_small_blocks_and_ranges_change_nothing(spark, docs, monkeypatch):
    labels = docs.selectExpr("doc_id", "1 as quality").filter("doc_id % 2 = 0").distinct()
    result = lambda **k: sorted(((r["doc_id"], r["n_tokens"], round(r["log10_prob"], 4), r["kept"]) for r in quality_model.classify(docs, labels, **k).collect()), key=str)
    want = result()
    assert result(broadcast_bytes=0) == want
    monkeypatch.setattr(quality_model, "SHARD_CHARS", 400_000)
    monkeypatch.setattr(quality_model, "BLOCKS_AT_ONCE", 2)
    monkeypatch.setattr(blocks.packed, "__defaults__", ("blocks", 300))
    assert result() == want and result(broadcast_bytes=0) == want


def test_keys_round_trip():
    import numpy as np

    rng = np.random.default_rng(1)
    for keys in (np.zeros(0, U), np.array([0, 5, (1 << 64) - 1], U), np.unique(rng.integers(0, 1 << 64, 100_000, dtype=U)), np.arange(5, 99, dtype=U)):
        assert (blocks.unsqueeze_keys(blocks.squeeze_keys(keys)) == keys).all()
    x = rng.integers(0, 9, 1000).astype("<u2")
    assert (blocks.unsqueeze(blocks.squeeze(x), "<u2", 1000) == x).all()
