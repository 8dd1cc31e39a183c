"""PII, decontamination, scoring, language and quality: against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillstream.llm import decontaminate, langid, lm_score, pii, quality_model
from quillstream.llm.textnum import text_buffer

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    return sum(n if i % 2 == 0 else n * 2 - 9 * (n > 4) for i, n in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            v, d = m.group(), re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in v.split(".")):
                continue
            if (kind == "card" and not (12 <= len(d) <= 19 and luhn(d))) or (kind == "phone" and not 9 <= len(d) <= 15):
                continue
            out.append((m.start(), k, kind, m.end()))
    return sorted(out)


TRICKY = [
    "a@b.c%x@y.z and ..@a-b.c-d.e, x@y, @a.b, a@b..c",
    "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.01 1.2.3 999999999999.1.1.1",
    "4111111111111111 4111-1111-1111-1111 4111 1111 1111 1112 " + "4" * 25,
    "+1 (918) 555-4124. +12 +1--------2 +123456789 ++49 170 1234567",
    "😀 é 10.0.0.1 ü a@b.de 😀 +49 (0) 170 1234567",
    "0" * 20000,
    "x" * 20000 + "@",
]


def test_pii_base_spans(spark, docs, rows):
    more = [(1000 + i, t) for i, t in enumerate(TRICKY)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    got = Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.find(every).collect())
    want = Counter()
    for doc_id, text in [r[:2] for r in rows] + more:
        spans = base_spans(text)
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        want[doc_id, *(sum(s[2] == k for s in spans) for k, _ in PATTERNS), hashlib.sha256(joined.encode()).hexdigest()] += 1
    assert got == want


def test_pii_discovers_by_context_and_leaves_clean_text(spark):
    secret = [(i, f"word number {i} secret = a{i * 7919:07d}bcdef{i:05d}xy and more") for i in range(12)]
    rows = secret + [(50, "here secret = plainvalue ends"), (51, "time = nothing special"), (52, "clean words only, license 2.0")]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[50] == "secret:14:24"  # no rule knows it: its label does
    assert got[51] == got[52] == ""
    red = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows + [(60, "mail a@b.co now")], "doc_id bigint, text string")).collect()}
    assert red[50] == "here secret = [SECRET] ends" and red[52] == rows[-1][1] and red[60] == "mail [EMAIL] now"


def test_redact_keeps_rows_and_columns(docs, rows, empty):
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[79] == "Mail [EMAIL] or [PHONE], host [IP], card [CARD]." and got[70] is None and got[0] == rows[0][1]
    assert pii.redact(empty).count() == 0 and pii.find(empty).count() == 0


ITEMS = [(i, " ".join(f"item{i}word{k}" for k in range(12)) + ". " + " ".join(f"item{i}end{k}" for k in range(5))) for i in range(20)]


def test_decontaminate_finds_copies_and_near_copies(spark):
    filler = " ".join(f"fill{k % 90}" for k in range(300))
    near = ITEMS[3][1].replace("item3word5", "changed")
    docs = [(1, filler + " " + ITEMS[0][1] + " " + filler), (2, filler), (3, near.upper()), (4, " ".join(ITEMS[5][1].split()[:8])), (5, None), (6, ""), (7, ITEMS[1][1] + "\n" + ITEMS[2][1]), (None, ITEMS[4][1])]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS + [(99, None), (98, " ")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.search(docs, items).collect()}
    assert got == {(1, 0), (3, 3), (7, 1), (7, 2), (None, 4)}
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, items).collect()) == [2, 4, 5, 6]
    assert decontaminate.search(docs, items.limit(0)).count() == 0


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def test_scores_equal_a_plain_model(docs, rows, monkeypatch):
    learned = {}
    learn = lm_score.learn_weights
    monkeypatch.setattr(lm_score, "learn_weights", lambda *a, **k: learned.setdefault("w", learn(*a, **k)))
    got = Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in lm_score.score(docs).drop("n_new", "new_share").collect())
    weights = learned["w"]
    c1, c2, c3, docs_in = Counter(), Counter(), Counter(), 0
    for doc_id, text, *_ in rows:
        if lm_score.fold(doc_id) != lm_score.HELD_OUT:
            w = ["<s>", "<s>", *words_of(text), "</s>"]
            docs_in += 1
            c1.update(w[2:])
            c2.update(zip(w[1:], w[2:]))
            c3.update(zip(w, w[1:], w[2:]))
    n, v = sum(c1.values()), len(c1)
    want = Counter()
    for doc_id, text, *_ in rows:
        w = ["<s>", "<s>", *words_of(text), "</s>"]
        base = score = 0.0
        for a, b, c in zip(w, w[1:], w[2:]):
            cv = docs_in if b == "<s>" else c1[b]
            cuv = docs_in if (a, b) == ("<s>", "<s>") else c2[a, b]
            k = weights[int(lm_score.bucket(np.array([cuv]), np.array([cv]))[0])]
            p = k[0] / (v + 1) + k[1] * c1[c] / n + k[2] * c2[b, c] / max(cv, 1) + k[3] * c3[a, b, c] / max(cuv, 1)
            base += math.log10((c1[c] + 1) / (n + v + 1))
            score += math.log10(p)
        want[doc_id, lm_score.fold(doc_id) == lm_score.HELD_OUT, len(w) - 2, sum(c1[x] > 0 for x in w[2:]), n, round(base, 6), round(score, 6)] += 1
    assert got == want
    assert np.allclose(weights.sum(axis=1), 1) and (weights[21:, 3] == 0).all()


def test_weights_follow_what_predicts():
    rows = [(5, -20, -6, -1, 900), (5, -20, -6, lm_score._FLOOR, 100), (2, -20, -6, lm_score._FLOOR, 1000)]
    w = lm_score.learn_weights(rows, 1000)
    assert w[5, 3] > 0.7 and w[2, 3] < 0.05 and w[2, 2] > 0.8


def test_language_of_held_out_text(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("".join(rng.choice(list("abcde" if i % 2 else "vwxyzö"), 4)) for _ in range(40)), "one" if i % 2 else "two") for i in range(240)]
    rows += [(500, None, "one"), (501, "123 !!", "two"), (502, "", None), (None, "abcd abcd", "one")]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    held = [r for r in rows[:240] if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r["held_out"] and i is not None and i < 240} == {r[0] for r in held}
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in held]) > 0.97
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (500, 501, 502))
    assert not got[None]["held_out"] and all(0 <= r["score"] <= 1 for r in got.values())


def test_language_without_labels(spark, empty):
    got = langid.identify(spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")).collect()
    assert got[0]["lang_pred"] == "und"
    assert langid.identify(empty).count() == 0


def test_gradients():
    net = langid.Network(3, 4)
    x = langid.segments(*text_buffer(pa.array(["hello world", "abc" * 30])))[0][:2]
    y = np.array([0, 2])
    for i, p in enumerate(net.parameters()):
        g = net.gradients(x, y)[1][i]
        k = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, e = p[k], 1e-2
        p[k] = old + e
        up = net.gradients(x, y)[0]
        p[k] = old - e
        down = net.gradients(x, y)[0]
        p[k] = old
        assert g[k] == pytest.approx((up - down) / 2 / e, rel=0.02)


def test_reading_equals_training_forward():
    net = langid.Network(2, 4)
    x = langid.segments(*text_buffer(pa.array(["some text of more than a segment " * 4])))[0]
    p = net.positions(x)
    loss, _ = net.gradients(x, np.zeros(len(x), int))
    real = x.T != langid.PAD
    assert -(np.log(p[:, :, 0]) * real).sum() / real.sum() == pytest.approx(loss, rel=1e-3)


def test_quality_limits_by_language(spark, docs, empty):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(50)]
    rows = [(i, " ".join(rng.choice(words, 60)), "en") for i in range(200)] + [(900 + i, " ".join(f"j{i}x{k}" for k in range(60)), "en") for i in range(10)] + [(990, None, "en"), (991, "", None)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(i, 0, 0) for i in range(900, 910)], "doc_id bigint, quality int, toxic int")
    got = defaultdict(list)
    for r in quality_model.classify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), labels).collect():
        got[r["doc_id"]].append(r)
    assert all(len(v) == 1 for v in got.values()) and len(got) == len(rows)
    assert np.mean([got[i][0]["kept"] for i in range(200)]) > 0.97
    assert not any(got[i][0]["kept"] for i in [*range(900, 910), 990, 991])
    assert quality_model.classify(empty, labels).count() == 0
    assert quality_model.classify(docs, labels.limit(0)).count() == docs.count()


def test_new_tokens_are_those_of_no_other_training_document(docs, rows):
    grams = []
    for doc_id, text, *_ in rows:
        w = ["<s>", "<s>", *words_of(text), "</s>"]
        grams.append((lm_score.fold(doc_id) != lm_score.HELD_OUT, list(zip(w, w[1:], w[2:]))))
    trained = Counter(g for train, x in grams if train for g in set(x))
    want = Counter()
    for (doc_id, *_), (train, x) in zip(rows, grams):
        n = sum(trained[g] - train == 0 for g in x)
        want[doc_id, n, round(n / len(x), 9)] += 1
    assert Counter((r["doc_id"], r["n_new"], round(r["new_share"], 9)) for r in lm_score.score(docs).collect()) == want
    assert any(n == 0 for _, n, _ in want) and any(n > 20 for _, n, _ in want)
