"""Documents as packed blocks of token hashes, written once.

A block holds the tokens of some documents (about ``BLOCK`` of them): the sorted
distinct token hashes, every token's place among them, and each document's
number of tokens.  Tokens are lower-cased words, each document closed by
``END``.  N-gram models exchange blocks' distinct n-gram keys with shards of
their counts; since blocks are a written table, a task that is run again meets
the same blocks.

Hashes have 64 bits: n-grams whose hashes are equal are taken for one.
"""

from __future__ import annotations

import struct
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import saved
from .textnum import U, mix, words_by_run

BLOCK = 1_200_000
END, BOS = U(0x7F4A7C15F39CC061), U(0x2545F4914F6CDD1D)
_MULS = [U(0x9FB21C651E98DF25), U(0xD6E8FEB86659FD93), U(0xC2B2AE3D27D4EB4F)]


def token_runs(column):
    """(first row, last row + 1, tokens of each row, tokens) of a text column, about a megabyte at a time."""
    for a, b, w in words_by_run(column, lower=True):
        n = np.diff(w.first)
        tokens = np.full(len(w.hashes) + len(n), END, U)
        tokens[np.arange(len(w.hashes)) + np.repeat(np.arange(len(n)), n)] = w.hashes
        yield a, b, n + 1, tokens


def key(*words) -> np.ndarray:
    """The n-gram key of words given last word first."""
    h = sum((w * m for w, m in zip(words[1:], _MULS[1:])), words[0] * _MULS[0])
    return mix(h + U(len(words)))


def before(values: np.ndarray, starts: np.ndarray, first) -> np.ndarray:
    """For each token the value of the token before it, ``first`` at a document's first."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[starts] = first
    return out


def squeeze(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x), codec="zstd", asbytes=True) if x.size else b""


def unsqueeze(data: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def squeeze_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as the bytes of their differences, by significance: the low
    ones, which differences of their size fill evenly, as they are, the others compressed."""
    if not len(keys):
        return b""
    step = np.diff(keys.astype("<u8"), prepend=np.zeros(1, "<u8"))
    even = max(int(int(keys[-1]) // len(keys)).bit_length() - 2, 0) // 8
    planes = np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T)
    return struct.pack("<BQ", even, len(keys)) + planes[:even].tobytes() + squeeze(planes[even:])


def unsqueeze_keys(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, U)
    even, n = struct.unpack_from("<BQ", data)
    at = struct.calcsize("<BQ")
    low = np.frombuffer(data, np.uint8, even * n, at)
    high = unsqueeze(data[at + even * n :], "u1", (8 - even) * n)
    step = np.ascontiguousarray(np.concatenate([low, high]).reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(step, dtype=U)


class _Held:
    """Rows of a group that wait for their block."""

    def __init__(self):
        self.meta, self.sizes, self.tokens, self.total = [], [], [], 0

    def add(self, meta: list, sizes: np.ndarray, tokens: np.ndarray):
        self.meta.append(meta)
        self.sizes.append(sizes)
        self.tokens.append(tokens)
        self.total += len(tokens)

    def columns(self) -> list:
        sizes = np.concatenate(self.sizes)
        words, place = np.unique(np.concatenate(self.tokens), return_inverse=True)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.concat_arrays(c)) for c in zip(*self.meta)]
        kind = "<u2" if len(words) <= 1 << 16 else "<u4"
        return [*lists, *(pa.array([x], pa.binary()) for x in (sizes.astype("<u4").tobytes(), squeeze_keys(words), squeeze(place.astype(kind))))]


def packed(rows: DataFrame, name: str = "blocks", size: int = BLOCK) -> DataFrame:
    """Blocks of ``rows`` (group, further columns, text), as a written table: block,
    n_tokens, the group's column, a list for each further column, sizes, words, tokens.

    A block has documents of one group only."""
    group, *meta, text = rows.columns
    lists = [T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in meta]
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("n_tokens", T.LongType()), rows.schema[group], *lists, *(T.StructField(c, T.BinaryType()) for c in ("sizes", "words", "tokens"))])

    def run(batches):
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), count(), {}

        def flush(g):
            h = held.pop(g)
            cols = [pa.array([(part << 32) + next(number)]), pa.array([h.total]), pa.array([g], kind), *h.columns()]
            return pa.RecordBatch.from_arrays(cols, schema.names)

        for batch in batches:
            kind, groups = batch.column(0).type, batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, sizes, tokens in token_runs(batch.column(batch.num_columns - 1)):
                for g in np.unique(groups[a:b]).tolist():
                    mine = groups[a:b] == g
                    at = pa.array(np.flatnonzero(mine) + a)
                    h = held.setdefault(g, _Held())
                    h.add([c.take(at) for c in batch.columns[1:-1]], sizes[mine], tokens[np.repeat(mine, sizes)])
                    if h.total >= size:
                        yield flush(g)
        for g in list(held):
            yield flush(g)

    return saved(rows.mapInArrow(run, schema), name)


class Block:
    """Tokens of some documents, and each document's number of them."""

    def __init__(self, sizes: np.ndarray, tokens: np.ndarray):
        self.sizes, self.tokens = sizes, tokens
        self.starts = np.cumsum(sizes) - sizes

    @classmethod
    def read(cls, sizes: bytes, words: bytes, tokens: bytes) -> Block:
        """Of a row of ``packed``."""
        sizes, words = np.frombuffer(sizes, "<u4").astype(np.int64), unsqueeze_keys(words)
        return cls(sizes, words[unsqueeze(tokens, "<u2" if len(words) <= 1 << 16 else "<u4", int(sizes.sum()))])

    def grams(self, order: int) -> np.ndarray:
        """The key of every token's n-gram; BOS stands before a document."""
        w = [self.tokens]
        for _ in range(order - 1):
            w.append(before(w[-1], self.starts, BOS))
        return key(*w)


def blocks_of(batch: pa.RecordBatch):
    """(row as a dictionary without the tokens, Block) of a batch of ``packed``."""
    for row in batch.to_pylist():
        yield row, Block.read(row.pop("sizes"), row.pop("words"), row.pop("tokens"))
