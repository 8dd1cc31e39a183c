"""Token counts and the recurrent network against slow, plain forms."""

import json
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillstream.llm import langid, token_counts
from quillstream.llm.encoder import tokenizer_file
from quillstream.llm.textnum import text_buffer

BYTE = tokenizer_file("byte_bpe_50k.json")


def bytes_of_letters():
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain_counts(tokenizer, names, letters, text, rule):
    """(section, start, end, tokens) of a text's lines, token by token and byte by byte."""
    chars_of_byte = [k for k, c in enumerate(text) for _ in c.encode()]
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, min(at + len(line) + 1, len(text))))
        at += len(line) + 1
    lines = [x for x in lines if x[0] < x[1]] or [(0, 0)]
    counts, byte = Counter(), 0
    for token in tokenizer.encode(text, add_special_tokens=False).ids:
        size = len(bytes(letters[c] for c in names[token]))
        chars = sorted(set(chars_of_byte[byte : byte + size]))
        byte += size
        if rule == "first":
            home = next(k for k, (a, b) in enumerate(lines) if a <= chars[0] < b)
        else:
            held = [sum(a <= c < b for c in chars) for a, b in lines]
            home = held.index(max(held))
        counts[home] += 1
    assert byte == len(text.encode())
    return [(k, a, b, counts[k]) for k, (a, b) in enumerate(lines)]


@pytest.mark.parametrize("rule", ["first", "most"])
def test_token_counts_equal_plain_attribution(spark, docs, rows, rule):
    tokenizer = Tokenizer.from_file(BYTE)
    tokenizer.encode_special_tokens = True
    names = {k: t for t, k in json.loads(tokenizer.to_str())["model"]["vocab"].items()}
    odd = [(900, "a\n\n\n  \n b"), (901, "\n"), (902, "日本\n語😀\n\n😀"), (903, "x \n y\n"), (904, "\n\n\n\nword\n\n\n")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id bigint, text string"))
    got = Counter((r["doc_id"], r["section"], r["start"], r["end"], r["n_tokens"], r["doc_tokens"]) for r in token_counts.count(df, rule=rule).collect())
    want, letters = Counter(), bytes_of_letters()
    for doc_id, text in [(r[0], r[1]) for r in rows] + odd:
        found = plain_counts(tokenizer, names, letters, text or "", rule)
        for x in found:
            want[doc_id, *x, sum(n for *_, n in found)] += 1
    assert got == want


def test_reading_equals_a_plain_recurrent_network():
    net = langid.Network(3, 4)
    rng = np.random.default_rng(5)
    net.b[:] = rng.normal(size=3)
    texts = ["Grüße, 世界", "a", "one two three four five six seven eight nine ten eleven twelve thirteen" * 2]
    got = net.documents(*text_buffer(pa.array(texts)))
    gate = lambda x: min(max(x + 0.5, 0.0), 1.0)
    for text, p in zip(texts, got):
        data, total = text.encode(), np.zeros(3)
        for at in range(0, len(data), langid.SEGMENT):
            part = data[at : at + langid.SEGMENT]
            states = [[], []]
            for d in (0, 1):
                h = [0.0] * 4
                for byte in part if d == 0 else part[::-1]:
                    mul = lambda k, h=h, d=d: [sum(h[i] * float(net.u[d, k, i, j]) for i in range(4)) for j in range(4)]
                    z = [gate(float(net.table[d, 0, byte, j]) + x) for j, x in enumerate(mul(0))]
                    r = [gate(float(net.table[d, 1, byte, j]) + x) for j, x in enumerate(mul(1))]
                    e = [float(net.table[d, 2, byte, j]) + r[j] * x for j, x in enumerate(mul(2))]
                    h = [e[j] / (1 + abs(e[j])) * (1 - z[j]) + z[j] * h[j] for j in range(4)]
                    states[d].append(h)
            for f, b in zip(states[0], states[1][::-1]):
                logits = [float(net.b[c]) + sum(f[j] * float(net.v[0, j, c]) + b[j] * float(net.v[1, j, c]) for j in range(4)) for c in range(3)]
                e = np.exp(logits)
                total += e / e.sum()
        assert p == pytest.approx(total / len(data), rel=2e-4)


def test_very_long_and_empty_texts(spark):
    rows = [(i, ("abcde " if i % 2 else "vwxyz ") * 60, "one" if i % 2 else "two") for i in range(40)] + [(100, "abcde " * 200_000, None), (101, "", None), (102, None, "one")]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert got[100] == "one" and got[101] == got[102] == "und"
