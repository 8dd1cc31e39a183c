"""Token counts attributed to sections by character offsets.

A document is encoded whole, once.  A byte-level vocabulary is lossless, so the
lengths of its tokens' bytes give every token's byte span, and the counts of
characters begun up to there its character span [start, end).  Sections are
character spans that tile or lie in the text; tokens and sections are both in
order, so they are joined by position, not by pairs.

A token that crosses a boundary goes

* ``first`` (default): to the section that holds its first character;
* ``most``: to the section that holds most of its characters, the earlier of equals.

By default the sections are the text's lines, a line break belonging to the line
it ends.  Counts of a document's sections, and of what lies in no section,
add up to its tokens.

Defined cases: null text is empty; an empty text has one empty section without
tokens; a null ``doc_id`` is carried; repeated rows are counted each for itself;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoder import Encoder, _byte_letters, encoder, shrinking, tokenizer_file

RULES = ("first", "most")
RESULT = "doc_id bigint, section int, start bigint, end bigint, n_tokens bigint, doc_tokens bigint"


def token_bytes(enc: Encoder) -> np.ndarray:
    """Bytes of each id of a byte-level vocabulary; special tokens by their text."""
    letters = set(_byte_letters().values())
    lengths = np.zeros(enc.tokenizer.get_vocab_size(), np.int64)
    for token, k in json.loads(enc.tokenizer.to_str())["model"]["vocab"].items():
        lengths[k] = len(token) if set(token) <= letters else len(token.encode())
    return lengths


def token_spans(ids: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of the tokens of a text (UTF-8 ``data``): from the character
    that holds a token's first byte to the one after that of its last byte."""
    ends = np.cumsum(lengths[ids])
    if len(ids) and ends[-1] != len(data):
        raise ValueError("the vocabulary is not lossless on this text")
    begun = np.cumsum((data & 0xC0) != 0x80)  # characters begun up to and with each byte
    return begun[ends - lengths[ids]] - 1, begun[ends - 1]


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Section of each token (-1: none); ``bounds`` k x 2, ascending, disjoint character spans."""
    if not len(bounds):
        return np.full(len(starts), -1)
    k = np.searchsorted(bounds[:, 0], starts, side="right") - 1
    if rule == "most":
        # a token meets few sections: follow it to the right while it gains
        best, most = np.full(len(starts), -1), np.zeros(len(starts), np.int64)
        at = np.maximum(k, 0)
        live = np.arange(len(starts))
        while len(live):
            s = at[live]
            both = np.minimum(ends[live], bounds[s, 1]) - np.maximum(starts[live], bounds[s, 0])
            gain = both > most[live]
            best[live[gain]], most[live[gain]] = s[gain], both[gain]
            at[live] += 1
            live = live[(at[live] < len(bounds)) & (bounds[np.minimum(at[live], len(bounds) - 1), 0] < ends[live])]
        return best
    inside = (k >= 0) & (starts < bounds[np.maximum(k, 0), 1])
    return np.where(inside, k, -1)


def line_sections(data: np.ndarray) -> np.ndarray:
    """Character spans of the lines of UTF-8 ``data``, breaks included."""
    begun = (data & 0xC0) != 0x80
    total = np.cumsum(begun)
    breaks = total[np.flatnonzero(data == 10)] if len(data) else np.zeros(0, np.int64)
    n = int(total[-1]) if len(data) else 0
    edges = np.unique(np.concatenate([[0], breaks, [n]]))
    return np.stack([edges[:-1], edges[1:]], axis=1) if len(edges) > 1 else np.array([[0, 0]])


def count(docs: DataFrame, tokenizer: str | None = None, rule: str = "first", sections: str | None = None) -> DataFrame:
    """RESULT: a row for each section of every row of ``docs`` (doc_id, text, and,
    if named, ``sections``: array<struct<start, end>> of ascending, disjoint
    character spans).  Section -1 holds tokens outside all sections, if there are any."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = tokenizer or tokenizer_file("byte_bpe_50k.json")
    lengths_of: dict[str, np.ndarray] = {}

    @shrinking
    def run(batches):
        enc = encoder(path)
        if path not in lengths_of:
            lengths_of[path] = token_bytes(enc)
        lengths = lengths_of[path]
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            given = batch.column(2).to_pylist() if sections else None
            for r, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                data = np.frombuffer((text or "").encode(), np.uint8)
                ids = np.frombuffer(enc.encode(text), "<u4").astype(np.int64)
                bounds = line_sections(data) if given is None else np.array([(s["start"], s["end"]) for s in given[r] or []], np.int64).reshape(-1, 2)
                k = attribute(*token_spans(ids, lengths, data), bounds, rule)
                n = np.bincount(k + 1, minlength=len(bounds) + 1)
                at = range(-1 if n[0] else 0, len(bounds))
                spans = np.concatenate([[[0, 0]], bounds])
                out[0] += [doc_id] * len(at)
                out[1] += at
                out[2] += spans[at.start + 1 :, 0].tolist()
                out[3] += spans[at.start + 1 :, 1].tolist()
                out[4] += n[at.start + 1 :].tolist()
                out[5] += [len(ids)] * len(at)
            kinds = [pa.int64(), pa.int32()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [c.split()[0] for c in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.col(sections)] if sections else [])).mapInArrow(run, RESULT)


def query(spark, sf_dir):
    """op7_token_counts: tokens of every line of every document."""
    return count(spark.read.parquet(f"{sf_dir}/documents.parquet"))
