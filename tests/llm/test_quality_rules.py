import re
from collections import Counter

from pyspark.sql import functions as F

from quillstream.llm import quality_rules as q


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures_and_base_verdict(docs, rows):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, *[r[k] for k in q.MEASURES[:5]], r["base_failed"]) for r in q.judge(docs).collect())
    want = []
    for doc_id, text, *_ in rows:
        m = measures(text)
        want.append((doc_id is None, doc_id or 0, *m, m[0] < 10 or 100 * m[4] > 20 * m[0]))
    assert got == sorted(want)


def test_keep_good_agrees_with_judge_and_keeps_columns(docs):
    kept = q.keep_good(docs)
    assert kept.columns == docs.columns
    judged = Counter(r["doc_id"] for r in q.judge(docs).collect() if r["kept"])
    assert Counter(r["doc_id"] for r in kept.collect()) == judged
    assert judged[0] == 1 and judged[77] == 0 and judged[70] == 0


def test_strict_host_holds_documents_to_tighter_limits(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    some = clean + " # # #"  # beyond the strict limit of symbols, not beyond the normal one
    junk = "go on " * 30
    rows = [(i, junk if i < 15 else some if i == 15 else clean, "bad") for i in range(20)]
    rows += [(100 + i, some if i == 0 else clean, "good") for i in range(20)] + [(200 + i, clean, f"h{i % 5}") for i in range(50)]
    got = {r["doc_id"]: r for r in q.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert got[15]["host_verdict"] == "strict" and not got[15]["kept"]
    assert got[100]["host_verdict"] == "normal" and got[100]["kept"]
    assert got[16]["kept"] and not got[0]["kept"]


def test_hosts_of_addresses_and_doubt(spark):
    clean, junk = " ".join(f"word{i}" for i in range(40)), "go on " * 30
    some = clean + " # # #"
    url = lambda h, i: f"https://user@{h.upper()}:8080/p/{i}?q=1#x"
    # many hosts fail one in ten; one fails nine in ten of 60, one both of its two
    rows = [(i, junk if i % 10 == 0 else clean, url(f"h{i // 20}.example", i)) for i in range(400)]
    rows += [(1000 + i, some if i % 10 == 0 else junk, url("bad.example", i)) for i in range(60)] + [(2000, junk, url("tiny.example", 0)), (2001, some, url("tiny.example", 1)), (3000, some, None), (3001, some, "no address")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, url string")
    got = {r["doc_id"]: r for r in q.judge(docs, q.url_host(F.col("url"))).collect()}
    assert got[0]["host"] == "=h0.example" and got[3000]["host"] == got[3001]["host"] == ""
    assert {r["host"] for r in got.values() if r["host_verdict"] == "strict"} == {"=bad.example"}
    # the same text is rejected where the host is surely bad, kept where it isn't
    assert not got[1000]["kept"] and got[2001]["kept"] and got[3000]["kept"]
    assert {r["doc_id"] for r in q.keep_good(docs, q.url_host(F.col("url"))).collect()} == {i for i, r in got.items() if r["kept"]}


def test_prior_shrinks_small_hosts():
    a, b = q.beta_prior(0.1, 0.02, 0.01)
    assert abs(a / (a + b) - 0.1) < 1e-9 and (1 + a) / (1 + a + b) < 0.6


def test_empty(empty):
    assert q.judge(empty).count() == 0 and q.keep_good(empty).count() == 0
