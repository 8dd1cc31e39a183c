import math
import random
import re
from collections import Counter

import pytest

from quillstream.llm import decontaminate
from quillstream.llm.shared import saved


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower())


def grams(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def plain(docs, items):
    """(doc_id, item_id, passage, score, shares) by scoring every item against every passage."""
    items = sorted({(i, t) for i, t in items if t is not None}, key=str)
    parsed = [(i, words_of(t), *map(words_of, decontaminate.question_answer(t))) for i, t in items if words_of(t)]
    n = len(parsed)
    if not n:
        return Counter()
    mean, half = sum(len(w) for _, w, _, _ in parsed) / n, max(len(w) for _, w, _, _ in parsed)
    df = Counter(x for _, w, _, _ in parsed for x in set(w))

    def impacts(w):
        k = 1.2 * (0.25 + 0.75 * len(w) / mean)
        raw = {x: math.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * c * 2.2 / (c + k) for x, c in Counter(w).items()}
        return {x: v / sum(raw.values()) for x, v in raw.items()}

    weight = [impacts(w) for _, w, _, _ in parsed]

    def share(part, words):
        return max((sum(g in grams(words, m) for g in grams(part, min(3, len(part)))) / len(grams(part, min(3, len(part)))) for m in (min(3, len(part)),)), default=1) if part else 1.0

    out = Counter()
    for doc_id, text in docs:
        w = words_of(text)
        for (item_id, _, q, a), x in zip(parsed, weight):
            best = None
            for k, lo in enumerate(range(0, len(w), half)):
                passage = w[lo : lo + 2 * half]
                score = sum(v for t, v in x.items() if t in set(passage))
                shares = share(q, passage), share(a, passage)
                if score >= 0.5 and min(shares) >= 0.5 and (best is None or score > best[1] + 1e-9):
                    best = (k, score, *shares)
            if best:
                out[doc_id, item_id, best[0], *(round(v, 6) for v in best[1:])] += 1
    return out


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(4)) for _ in range(220)]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice((20, 220))]) for _ in range(n))
    items = [(i, f"{text(rng.randint(4, 18))}? {text(rng.randint(1, 4))}") for i in range(90)]
    items += [(90, None), (91, "  ??"), (None, text(12) + ". " + text(3)), (7, items[7][1]), (92, text(2)), (93, text(1)), (94, items[3][1] + " " + items[4][1])]
    docs = [(i, text(rng.randint(0, 150))) for i in range(60)]
    docs += [(100 + i, text(30) + " " + items[i][1].upper() + " " + text(25)) for i in range(40)]
    docs += [(200, None), (201, ""), (202, items[92][1]), (203, text(40) + " " + items[-5][1]), (None, items[11][1]), (100, docs[60][1]), (204, (items[20][1] + " ") * 40), (205, items[94 - 90][1])]
    return docs, items


@pytest.mark.parametrize("shard_chars, pass_bytes", [(1 << 20, 128 << 20), (700, 128 << 20), (700, 30_000), (1, 1 << 20)])
def test_search_equals_scoring_everything_whatever_the_shards(spark, case, shard_chars, pass_bytes):
    docs, items = case
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = Counter((r[0], r[1], r[2], *(round(x, 6) for x in r[3:])) for r in decontaminate.search(d, i, shard_chars, pass_bytes).collect())
    want = plain(docs, items)
    assert len(want) > 45 and got == want
    hit = {k[0] for k in want}
    assert sorted(map(str, (r["doc_id"] for r in decontaminate.clean(d, i, shard_chars, pass_bytes).collect()))) == sorted(str(k) for k, _ in docs if k not in hit)


def test_small_tiles_and_few_essential_terms_change_nothing(spark, case, monkeypatch):
    docs, items = case
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    index = decontaminate.build(i)
    shared, last = next(decontaminate.passes(index))
    import pyarrow as pa

    texts = pa.array([t for _, t in docs], pa.string())
    want = list(shared.value[0].hits(texts))
    assert last and want
    monkeypatch.setattr(decontaminate, "TILE", 60)
    assert list(shared.value[0].hits(texts)) == want


def test_no_items(spark):
    d = spark.createDataFrame([(1, "a b c d")], "doc_id bigint, text string")
    for rows in ([], [(1, None)], [(1, "?!")]):
        i = spark.createDataFrame(rows, "item_id bigint, text string")
        assert decontaminate.search(d, i).count() == 0 and decontaminate.clean(d, i).count() == 1


@pytest.mark.parametrize("keys_at_once", [0, 1_000_000])
def test_clean_in_many_passes_writes_keys_and_carries_rows_once(spark, case, monkeypatch, keys_at_once):
    docs, items = case
    d = saved(spark.createDataFrame([(k, t, "x", 3) for k, t in docs] + [(-9, None, None, 4), (-9, None, None, 4)], "doc_id bigint, text string, text_key string, row int"), "docs")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    want = Counter(map(tuple, decontaminate.clean(d, i).collect()))
    monkeypatch.setattr(decontaminate, "KEYS_AT_ONCE", keys_at_once)
    written, real = [], decontaminate.saved
    monkeypatch.setattr(decontaminate, "saved", lambda df, name, *a: written.append((name, df.columns)) or real(df, name, *a))
    out = decontaminate.clean(d, i, 700, 1)
    assert out.columns == d.columns and Counter(map(tuple, out.collect())) == want and want[-9, None, None, 4] == 2
    keys = [c for name, c in written if name == "hit-keys"]
    assert len(keys) > 1 and all(c == ["text_key"] for c in keys) and not any("row" in c for _, c in written)
