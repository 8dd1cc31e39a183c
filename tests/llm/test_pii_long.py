"""One text with very many finds; spans that overlap, meet and follow one another."""

import random
import re
import time

from pyspark.sql import functions as F
from quillstream.llm import pii


def test_very_many_finds_in_one_text(spark):
    text = " ".join(f"{i % 256}.{i // 256 % 256}.3.4 é😀" for i in range(50_000))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    pii.find(docs.filter("doc_id > 1")).collect()  # what is compiled once is no part of the time
    start = time.time()
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert time.time() - start < 60
    want = [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]+\.[0-9]+\.3\.4", text)]
    assert got[1]["n_ip"] == 50_000 and got[1]["spans"].split(",") == want
    start = time.time()
    red = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert time.time() - start < 60
    assert red == {1: re.sub(r"[0-9]+\.[0-9]+\.3\.4", "[IP]", text), 2: None, 3: ""}


def plainly(text, spans):
    out, at = "", 0
    for start, _, kind, end in spans:
        if start >= at:
            out, at = f"{out}{text[at:start]}[{kind.upper()}]", end
        at = max(at, end)
    return out + text[at:]


def test_replaced_equals_a_plain_loop(spark):
    rng, rows = random.Random(4), []
    for n in [0, 1, 2, 3, 9, 40, 255, 256, 257, 700]:
        for wide in (1, 6, 60):
            text = "".join(rng.choice("ab é日😀") for _ in range(3 * n + 5))
            spans = [(a, k, pii.KINDS[k], min(len(text), a + rng.randint(1, wide))) for a, k in ((rng.randrange(len(text)), rng.randrange(4)) for _ in range(n))]
            rows.append((text, sorted(spans)))
    df = spark.createDataFrame(rows, f"text string, spans array<{pii.SPAN}>")
    got = df.select("text", "spans", pii.replaced(F.col("text"), F.col("spans")).alias("new")).collect()
    assert [r["new"] for r in got] == [plainly(r["text"], r["spans"]) for r in got]


def test_instances_that_a_find_covers_are_not_free(spark):
    text = "user = bob.smith@mail.example.com x1y2z3w4 key: abcdef99 +49 30 1234567 host=10.0.0.1/abc é ticket A1234567@x"
    df = spark.createDataFrame([(1, text), (2, "key = abcdef99"), (3, "nothing")], "doc_id bigint, text string")
    seen = set()
    for r in pii.with_instances(pii.with_base(df, df["text"]), df["text"]).collect():
        for x in r["instances"]:
            assert x["free"] == (not any(b["start"] < x["end"] and x["start"] < b["end"] for b in r["base"]))
            seen.add(x["free"])
    assert seen == {True, False}
