"""Source divergence, conversation trie and cutting-stock packing against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillstream.llm import cutting_stock, divergence, prefix_trie


def divergence_by_hand(rows, min_docs):
    """rows: (text, lang, source)."""
    texts = defaultdict(list)
    for text, lang, source in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        texts[lang or ""].append((source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)))
    out = []
    for lang, docs in texts.items():
        df = Counter(t for _, words in docs for t in set(words))
        kept = sorted(t for t in df if df[t] >= min_docs)
        counts = defaultdict(Counter)
        for source, words in docs:
            counts[source].update(w for w in words if w in set(kept))
        whole = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for source in counts:
            pairs = [(other, sum(abs(share(counts[source], t) - share(counts[other], t)) for t in kept)) for other in counts if other != source]
            terms = [(t, share(counts[source], t) - share(whole, t)) for t in kept if counts[source][t] and share(counts[source], t) > share(whole, t)]
            for part, items, limit in (("pair", pairs, None), ("term", terms, 50)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(4096, 48), (3, 2)])
def test_divergence(spark, monkeypatch, blocks):
    monkeypatch.setattr(divergence, "TERM_BLOCK", blocks[0])
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", blocks[1])
    monkeypatch.setattr(divergence, "MIN_DOCS", 3)
    monkeypatch.setattr(divergence, "ENTRIES", 20)
    rng = random.Random(5)
    words = ["Alpha", "beta", "ÉTÉ", "été", "x1y", "naïve", "a-b", "\x85z", "日本"] + [f"w{chr(97 + i)}" for i in range(12)]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(12))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "S3", "é", None, ""])) for _ in range(150)]
    rows += [(None, "en", "quiet"), ("", "xx", "only"), ("rare", "xx", "other"), ("Beta " * 30_000, "en", "s1"), rows[0], rows[0]]
    # extra columns with clashing names
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "text string, lang string, source string, count int, term int, n int")
    got = sorted(tuple(r) for r in divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == divergence_by_hand(rows, 3)
    assert divergence.audit(df.limit(0)).count() == 0


def trie_by_hand(rows):
    """rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            own[conv_id].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), (role, text)))
    said = {c: [t for _, _, t in sorted(turns)] for c, turns in own.items()}
    head = lambda c: c - (abs(c) % 100) * (1 if c >= 0 else -1)
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in said}
    built = {c: tuple(said.get(head(c), [])[: h[c]] + said[c][h[c] :]) for c in said}
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saves = Counter(), Counter()
    for k, who in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saves[k[:d]] += (len(who) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, who in members.items():
        ends = ",".join(str(c) for c in who if built[c] == k)
        out.append((who[0], len(k), members[k[:-1]][0] if k else None, len(who), kids[k], leaves[k], saves[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, a string, depth int")


@pytest.mark.parametrize("segment", [1024, 3])
def test_trie(spark, monkeypatch, segment):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "PIECE", 5)
    rng = random.Random(segment)
    rows = []
    for c in [*range(0, 40), 100, 103, 117, 250, 251, 299, -7, -100, -101]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, turn if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "ünï", "", None])))
    rows += [(None, 0, "user", "lost"), *[(317, t, "user", str(t % 2)) for t in range(23)], *[(318, t, "user", str(t % 2)) for t in range(23)], (5, 1, "user", "a"), (5, 1, "user", "a")]
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(conversations(spark, rows)).collect()), key=repr)
    assert got == trie_by_hand(rows)


def test_trie_of_snapshots_nests_deeply(spark):
    # every conversation is the one before it and one turn more; each is its own head
    ids = range(0, 3000, 100)
    rows = [(c, t, "user", str(t)) for k, c in enumerate(ids) for t in range(k + 1)]
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(conversations(spark, rows)).collect()), key=repr)
    assert got == trie_by_hand(rows) and len(got) == 31


def test_trie_without_turns(spark):
    assert prefix_trie.prefix_trie(conversations(spark, [(0, 0, "user", "a")]).limit(0)).count() == 0
    lost = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    got = [tuple(r) for r in prefix_trie.prefix_trie(conversations(spark, [(lost, 0, "user", "a")])).collect()]
    assert got == [(lost, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lost).encode()).hexdigest())]


def test_stock_packs_all_tokens_without_padding(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(cutting_stock, "IN_BLOCK", 7)
    path = cutting_stock.tokenizer_file("byte_bpe_50k.json")
    rng = random.Random(2)
    texts = [None, "", "a", "a", *[" ".join(rng.choices(["lorem", "ipsum", "dolor", "été", "1234"], k=rng.choice([3, 40, 400, 900]))) for _ in range(120)], "long text " * 9000]
    rows = [(i // 2 if i % 10 else None, t, 1, 2) for i, t in enumerate(texts)]
    got = cutting_stock.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length int, row int")).toPandas()
    whole = Tokenizer.from_file(path)
    ids = Counter()
    for doc_id, text, *_ in rows:
        ids[doc_id, np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    # every token lies in exactly one piece, and pieces are what they say
    assert got["length"].sum() == sum(len(b) // 4 * n for (_, b), n in ids.items())
    pieces = Counter((None if d != d else int(d), int(s), int(n), int(c), int(t)) for d, s, n, c, t in zip(got.doc_id, got.start, got.length, got.ids_crc32, got.doc_tokens))
    for (doc_id, b), times in ids.items():
        mine = [p for p in pieces if p[0] == doc_id and p[4] == len(b) // 4 and zlib.crc32(b[4 * p[1] : 4 * (p[1] + p[2])]) == p[3]]
        assert sum(p[2] * pieces[p] for p in mine) >= times * (len(b) // 4)
    lengths = got.groupby("sequence_id")["length"].sum()
    assert (lengths <= 2048).all() and all(n == 2048 or n & (n - 1) == 0 for n in lengths)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]]
    assert cutting_stock.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stock_patterns_are_near_the_bound():
    rng = np.random.default_rng(1)
    sizes, demand = np.unique(rng.integers(1, 257, 4000), return_counts=True)
    chosen, uses = cutting_stock.patterns(sizes, demand, 256)
    assert (sizes @ chosen <= 256).all()
    # places of a size or more are enough for the pieces of that size or more
    assert (np.cumsum((chosen @ uses)[::-1]) >= np.cumsum(demand[::-1]) - 1e-3).all()
    assert uses.sum() <= sizes @ demand / 256 * 1.01 + 1
    worth, pattern = cutting_stock.price(np.array([3, 5]), np.array([0.4, 0.7]), 10)
    assert worth == pytest.approx(1.4) and pattern.tolist() == [0, 2]
    plan = cutting_stock.Plan({int(s): (int(n), int(8 * s * n)) for s, n in zip(sizes, demand)})
    used = Counter()
    for s, n in zip(sizes.tolist(), demand.tolist()):
        held = plan.held[s]
        if held:
            for q in plan.sequences(s, np.arange(held)).tolist():
                used[q] += s
    assert max(used.values()) <= 256 and max(used) < plan.count
