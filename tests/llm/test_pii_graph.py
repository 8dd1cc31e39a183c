"""The pattern-instance graph against plain loops; offsets of very many matches."""

import math
import random
import re
import time
from collections import defaultdict

from quillstream.llm import pii


def plain(instances):
    edges = defaultdict(float)
    for value, pattern, seed in instances:
        edges[pattern, value] = max(edges[pattern, value], seed)
    score = dict(edges)
    for k in range(pii.ROUNDS):
        members = defaultdict(list)
        for (p, v), s in score.items():
            members[p].append(s)
        confidence = {p: sum(x) / (len(x) + 1) for p, x in members.items()}
        context = {p: p.startswith(("before ", "after ")) for p in members}
        trusted = {p for p in members if confidence[p] >= (pii.CONTEXT_CONFIDENCE if context[p] else pii.CONFIDENCE) and len(members[p]) >= (pii.CONTEXT_SUPPORT if context[p] else pii.SUPPORT)}
        if k == pii.ROUNDS - 1:
            return trusted
        doubt = defaultdict(float)
        for p, v in edges:
            if not context[p] or p in trusted:
                doubt[v] += math.log1p(-min(confidence[p], 0.999999))
        score = {(p, v): max(s, 1 - math.exp(doubt[v]) if v in doubt else 0.0) for (p, v), s in edges.items()}


def test_trusted_patterns_equal_plain_rounds(spark):
    rng = random.Random(2)
    rows = []
    for v in range(400):
        seed = rng.choice([0.0] * 6 + [0.9, 1.0])
        for _ in range(rng.randint(1, 5)):
            p = rng.choice([f"label l{rng.randint(0, 30)} =", f"shape s{rng.randint(0, 9)}", f"before b{rng.randint(0, 20)} c", "label hot ="])
            rows.append((f"v{v}", p, seed if rng.random() < 0.8 else 0.0))
    rows += [(f"w{v}", f"label good{v % 3} =", 1.0 if v % 4 else 0.0) for v in range(60)] + [(f"w{v}", "before my key", 1.0) for v in range(30)]
    got = {r["pattern"] for r in pii.trusted_patterns(spark.createDataFrame(rows, "value string, pattern string, seed double")).collect()}
    want = plain(rows)
    assert got == want and 4 < len(want) < 60, len(want)


def test_offsets_of_very_many_matches(spark):
    text = "é 10.0.0.1 x" * 3000
    start = time.time()
    got = pii.find(spark.createDataFrame([(1, text), (2, "1.2.3.4 " * 257), (3, "9.9.9.9")], "doc_id bigint, text string")).collect()
    took = time.time() - start
    for r, t in zip(sorted(got, key=lambda r: r["doc_id"]), (text, "1.2.3.4 " * 257, "9.9.9.9")):
        want = [(m.start(), m.end()) for m in re.finditer(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", t)]
        spans = [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.startswith("ip:")]
        assert r["n_ip"] == len(want) and spans == want
    assert took < 120
