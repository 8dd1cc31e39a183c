"""Each stage of the pipeline, on what the stage before kept, against plain Python."""

import importlib.util
import math
import pathlib
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillstream.llm import packing, pii, quality_rules
from quillstream.llm.encoder import Encoder, tokenizer_file

sys.path.insert(0, str(pathlib.Path(__file__).parent))
from test_decontaminate import plain as plain_hits  # noqa: E402

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def good(rows):
    """Rows that the quality rules keep."""
    facts = []
    for r in rows:
        t, w = r["text"] or "", words_of(r["text"])
        lines = [x for x in t.split("\n") if words_of(x)]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often = Counter(grams)
        repeat = len({i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)})
        n, letters = max(len(w), 1), sum(c.isascii() and c.isalpha() for c in t)
        over = lambda v: (
            sum(c in "#*$%&|<>" for c in t) > v["symbols_per_word"] * n  # noqa: B023
            or len(lines) - len(set(lines)) > v["dup_line_share"] * max(len(lines), 1)  # noqa: B023
            or sum("A" <= c <= "Z" for c in t) > v["upper_share"] * max(letters, 1)  # noqa: B023
            or sum(c in "!?" for c in t) > v["marks_per_word"] * n  # noqa: B023
            or sum(map(len, w)) > v["max_word_chars"] * n  # noqa: B023
        )
        base = len(w) < 10 or 100 * repeat > 20 * len(w)
        facts.append((r["source"], base, *(over(quality_rules.LIMITS[k]) for k in ("normal", "strict"))))
    hosts = defaultdict(list)
    for host, base, normal, _ in facts:
        hosts[host].append(base or normal)
    rates = [sum(x) / len(x) for x in hosts.values()]
    m = sum(rates) / len(rates)
    a, b = quality_rules.beta_prior(m, sum((x - m) ** 2 for x in rates) / len(rates), sum(1 / len(x) for x in hosts.values()) / len(hosts))
    pooled = sum(map(sum, hosts.values())) / len(rows)
    strict = set()
    for host, x in hosts.items():
        rate = (sum(x) + a) / (len(x) + a + b)
        if rate - 1.645 * math.sqrt(rate * (1 - rate) / (len(x) + a + b + 1)) > 1.5 * pooled:
            strict.add(host)
    return [r for r, (host, base, normal, tight) in zip(rows, facts) if not base and not (tight if host in strict else normal)]


def one_of_each(rows):
    """One row of each group of near duplicates: (ids of the group, texts' set)."""
    sets = []
    for r in rows:
        w = words_of((r["text"] or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))})
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    best = {}
    for r, g in zip(rows, group):
        rank = (r["doc_id"] is None, r["doc_id"] or 0)
        if g not in best or rank < best[g]:
            best[g] = rank
    return best.values()


def test_every_stage(spark, docs, tmp_path):
    import corpus_pipeline

    items = [(i, f"the {i}th question of item number {i} asks what item{i} is? it is answer{i} of all") for i in range(12)]
    sf = f"file://{tmp_path}"
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    extra = [(300 + i, " ".join(f"pad{i}x{k}" for k in range(30)) + " " + items[i][1] + " " + " ".join(f"end{i}x{k}" for k in range(30))) for i in range(5)]
    extra += [(400 + i, f"write to user{i}@mail.example.org or call +49 30 55500{i}0 about " + " ".join(f"case{i}x{k}" for k in range(20))) for i in range(6)]
    start = docs.select("doc_id", "text", "lang", "source", "n_chars")
    start = start.unionByName(spark.createDataFrame([(i, t, "en", "s1", len(t)) for i, t in extra], start.schema))
    start.write.parquet(f"{sf}/documents.parquet")
    state, order = spark.read.parquet(f"{sf}/documents.parquet"), [n for n, _ in corpus_pipeline.STAGES]
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    for name, stage in corpus_pipeline.STAGES:
        before = state.collect()
        out = stage(spark, state, sf)
        out.write.parquet(f"{sf}/{name}")
        state = spark.read.parquet(f"{sf}/{name}")
        after = state.collect()
        if name != order[-1]:
            assert state.columns == start.columns
        if name == "quality_rules":
            assert Counter(after) == Counter(good(before)) and len(after) < len(before)
        elif name == "ngram_jaccard_join":
            assert sorted(map(key, after)) == sorted(one_of_each(before)) and len(after) < len(before)
            assert not Counter(after) - Counter(before)
        elif name == "benchmark_decontamination":
            hit = {k[0] for k in plain_hits([(r["doc_id"], r["text"]) for r in before], items)}
            assert Counter(after) == Counter(r for r in before if r["doc_id"] not in hit) and {300, 304} <= hit
        elif name == "pii":
            found = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(before, state.schema)).collect()}
            want = Counter()
            for r in before:
                text, at, new = r["text"], 0, ""
                for kind, lo, hi in (x.split(":") for x in found[r["doc_id"]].split(",") if x):
                    if int(lo) >= at:
                        new, at = new + text[at : int(lo)] + f"[{kind.upper()}]", int(hi)
                    else:
                        at = max(at, int(hi))
                want[(r["doc_id"], new + text[at:] if text is not None else None, r["lang"], r["source"], r["n_chars"])] += 1
            assert Counter(map(tuple, after)) == want
            assert sum("[EMAIL]" in r["text"] and "[PHONE]" in r["text"] for r in after) >= 6
        else:
            enc = Encoder(tokenizer_file("word_bpe_49k.json"))
            pieces, bins = Counter(), defaultdict(list)
            for r in after:
                pieces[r["doc_id"], r["piece"], r["start"], r["length"]] += 1
                bins[r["sequence_id"]].append((r["offset"], r["length"]))
            want = Counter()
            for r in before:
                n = len(enc.whole(r["text"] or "")) // 4 + 1
                for k, at in enumerate(range(0, n, 4096)):
                    want[r["doc_id"], k, at, min(4096, n - at)] += 1
            assert pieces == want
            for places in bins.values():
                end = 0
                for offset, length in sorted(places):
                    assert offset == end
                    end += length
                assert end <= 4096
            assert len(bins) == packing.lower_bound(*np.unique([k[3] for k in want.elements()], return_counts=True))
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, whole.select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == sorted(map(str, state.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
