"""Deleted-interpolation n-gram scoring of every document.

Counts of words, pairs and triples are taken over all training documents:
blocks of about a million tokens (a written table) send their distinct n-grams,
as sorted packed keys with counts, to ranges of the key space; each range sums
them and answers every block with the totals of the keys that it sent, in the
same order, so an answer is nothing but counts.  A block and its answers meet
again to be scored.

    p(w | u v) = l3 c(uvw)/c(uv) + l2 c(vw)/c(v) + l1 c(w)/N + l0 / (V + 1)

The weights depend on how often the context occurred (powers of two of c(uv),
or of c(v) where the pair is new).  They are learned by expectation-maximisation
on one block of the training documents (crc32 mod FOLDS = DELETED), with the
block's own counts deleted from every total.  The tuples of the block's tokens
are summed in a grid of half octaves, so that what the driver iterates over has
a fixed bound however large the corpus is; the grid only shapes the weights,
scores use exact counts.

A training document is scored with counts that include its own, as the contract
has it (V and N are of all training tokens); held-out documents are not.  What the
rest of the corpus says of a document is beside the score: ``n_new`` tokens (their
share is ``new_share``) end a triple that no other training document has; a
document that occurs twice has next to none.

Defined cases: null text is empty and consists of its end alone; a null
``doc_id`` counts as crc32 0; repeated rows count and score each for itself; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, before, blocks_of, packed, squeeze, squeeze_keys, unsqueeze, unsqueeze_keys
from .shared import release, saved, tidy
from .textnum import U

FOLDS, HELD_OUT, DELETED = 7, 2, 3
#: Distinct keys in a range, about.
RANGE = 4_000_000
KEY_BITS = 40
ORDERS = 3


def fold(doc_id) -> int:
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % FOLDS


def _edges(ranges: int) -> np.ndarray:
    return np.array([(r << 64) // ranges for r in range(ranges)], dtype=U)


def _pack(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as compressed single bytes after their number, and those from 255 on as (place, count)."""
    big = np.flatnonzero(counts >= 255)
    small = struct.pack("<Q", len(counts)) + squeeze(np.minimum(counts, 255).astype(np.uint8))
    return small, np.concatenate([big, counts[big]]).astype("<i8").tobytes()


def _unpack(small: bytes, big: bytes) -> np.ndarray:
    out = unsqueeze(small[8:], "u1", struct.unpack_from("<Q", small)[0]).astype(np.int64) if small else np.zeros(0, np.int64)
    pairs = np.frombuffer(big, "<i8")
    out[pairs[: len(pairs) // 2]] = pairs[len(pairs) // 2 :]
    return out


ASKED = "key bigint, block bigint, deleted boolean, keys binary, small binary, big binary"


def _ask(ranges: int):
    edges, shift = _edges(ranges), U(max(0, 64 - KEY_BITS - int(np.log2(ranges))))

    def run(batches):
        for row, b in (x for batch in batches for x in blocks_of(batch)):
            rows, name, deleted = [], row["block"], row["deleted"]
            held = np.array(row["held_out"], bool)
            trains = np.repeat(~held, b.sizes)
            for order in range(1, ORDERS + 1):
                keys, place = np.unique(b.grams(order), return_inverse=True)
                counts = np.bincount(place[trains], minlength=len(keys))
                cut = np.append(np.searchsorted(keys, edges), len(keys))
                for r in np.flatnonzero(np.diff(cut)):
                    k = (keys[cut[r] : cut[r + 1]] - edges[r]) >> shift
                    rows.append((order * ranges + int(r), name, deleted, squeeze_keys(k), *_pack(counts[cut[r] : cut[r + 1]])))
            # the block's documents and tokens, under a key of no order
            rows.append((name % ranges, name, deleted, b"", *_pack(np.array([(~held).sum(), trains.sum()]))))
            kinds = [pa.int64(), pa.int64(), pa.bool_()] + [pa.binary()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in ASKED.split(", ")])

    return run


ANSWERS = "block bigint, key bigint, small binary, big binary, own_small binary, own_big binary, docs bigint, own_docs bigint, tokens bigint, own_tokens bigint, words bigint"


def _answer(ranges: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        key = rows[0]["key"]
        out = []
        nothing = dict.fromkeys(("docs", "own_docs", "tokens", "own_tokens", "words"), 0)
        if key < ranges:
            for r in rows:
                docs, tokens = _unpack(r["small"], r["big"]).tolist()
                own = r["deleted"]
                out.append({"block": r["block"], "key": key, "small": b"", "big": b"", "own_small": b"", "own_big": b""} | nothing | {"docs": docs, "tokens": tokens, "own_docs": docs * own, "own_tokens": tokens * own})
        else:
            keys = [unsqueeze_keys(r["keys"]) for r in rows]
            distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
            counts = np.concatenate([_unpack(r["small"], r["big"]) for r in rows])
            own = counts * np.repeat([r["deleted"] for r in rows], [len(k) for k in keys])
            # sums stay below 2^53
            total = np.bincount(place, counts, len(distinct)).astype(np.int64)
            deleted = np.bincount(place, own, len(distinct)).astype(np.int64)
            at = 0
            for r, k in zip(rows, keys):
                p = place[at : at + len(k)]
                at += len(k)
                small, big = _pack(total[p])
                own_small, own_big = _pack(deleted[p]) if r["deleted"] else (b"", b"")
                out.append({"block": r["block"], "key": key, "small": small, "big": big, "own_small": own_small, "own_big": own_big} | nothing)
            if key // ranges == 1:
                out[0]["words"] = int((total > 0).sum())
        return pa.Table.from_pylist(out, pa.schema([(x.split()[0], {"binary": pa.binary(), "bigint": pa.int64()}[x.split()[1]]) for x in ANSWERS.split(", ")]))

    return run


def bucket(pair: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Context-frequency bucket: by c(uv), or by c(v) where the pair is new."""
    log = lambda x: np.floor(np.log2(np.maximum(x, 1))).astype(np.int64)
    return np.where(pair > 0, 1 + np.minimum(log(pair), 19), 21 + np.minimum(log(word + 1), 39))


BUCKETS = 61


def _features(b: Block, answers: list[dict], ranges: int, stats: dict, delete: bool):
    """c(w), the three relative frequencies, the bucket, and c(uvw) with the trigram's
    place among the block's, of every token of a block."""
    by_order: dict[int, list] = {k: [] for k in range(1, ORDERS + 1)}
    for r in sorted(answers, key=lambda r: r["key"]):
        if r["key"] >= ranges:
            total = _unpack(r["small"], r["big"])
            by_order[r["key"] // ranges].append(total - _unpack(r["own_small"], r["own_big"]) if delete else total)
    counts = {}
    for order, parts in by_order.items():
        _, place = np.unique(b.grams(order), return_inverse=True)
        counts[order] = np.concatenate(parts)[place]
    docs = stats["docs"] - stats["own_docs"] * delete
    n = stats["tokens"] - stats["own_tokens"] * delete
    word, pair = before(counts[1], b.starts, docs), before(counts[2], b.starts, docs)
    f = [counts[1] / max(n, 1), counts[2] / np.maximum(word, 1), counts[3] / np.maximum(pair, 1)]
    return counts[1], f, bucket(pair, word), counts[3], place


_STEP, _FLOOR = 2.0, -60


def _grid(f: np.ndarray) -> np.ndarray:
    """A relative frequency in half octaves; _FLOOR: none."""
    return np.where(f > 0, np.maximum(np.round(np.log2(np.maximum(f, 1e-30)) * _STEP), _FLOOR + 1), _FLOOR).astype(np.int64)


def learn_weights(rows: list[tuple[int, int, int, int, int]], words: int, rounds: int = 40) -> np.ndarray:
    """BUCKETS x 4 weights (uniform, word, pair, triple) from (bucket, three grid
    values, count) by expectation-maximisation; the uniform weight keeps at least 1e-6."""
    start = np.tile([0.05, 0.55, 0.3, 0.1], (BUCKETS, 1))
    # where the context is new its frequencies are no distribution: no weight
    start[21:, 3] = 0
    start[21, 2] = 0
    start /= start.sum(axis=1, keepdims=True)
    weights = start
    if not rows:
        return weights
    a = np.array(rows, np.int64)
    f = np.stack([np.full(len(a), 1 / (words + 1)), *(np.where(a[:, k] > _FLOOR, 2.0 ** (a[:, k] / _STEP), 0.0) for k in (1, 2, 3))], axis=1)
    for _ in range(rounds):
        part = weights[a[:, 0]] * f
        part *= (a[:, 4] / part.sum(axis=1))[:, None]
        # a little of the start's shape smooths buckets with few tokens
        sums = start.copy()
        for k in range(4):
            sums[:, k] += np.bincount(a[:, 0], part[:, k], BUCKETS)
        weights = np.where(start > 0, np.maximum(sums / sums.sum(axis=1, keepdims=True), 1e-6), 0)
        weights /= weights.sum(axis=1, keepdims=True)
    return weights


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_new bigint, new_share double"


@tidy
def score(docs: DataFrame) -> DataFrame:
    """SCORES for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    remainder = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % FOLDS
    rows = docs.select((remainder == DELETED).alias("deleted"), F.col("doc_id").cast("long").alias("doc_id"), (remainder == HELD_OUT).alias("held_out"), "text")
    blocks = packed(rows, "lm-blocks")
    ranges = max(1, -(-2 * (blocks.agg(F.sum("n_tokens")).first()[0] or 0) // RANGE))
    asked = blocks.mapInArrow(_ask(ranges), ASKED)
    answers = saved(asked.groupBy("key").applyInArrow(_answer(ranges), ANSWERS), "answers")
    release(spark)
    sums = ("docs", "own_docs", "tokens", "own_tokens", "words")
    stats = {k: v or 0 for k, v in answers.agg(*[F.sum(k).alias(k) for k in sums]).first().asDict().items()}
    n, words = stats["tokens"], stats["words"]
    answers = answers.filter(F.col("key") >= ranges).drop(*sums)

    def tally(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = np.zeros((0, 5), np.int64)
        for _, b in blocks_of(right):
            _, f, k, _, _ = _features(b, left.to_pylist(), ranges, stats, True)
            tuples = np.stack([k, *map(_grid, f)], axis=1)
            distinct, counts = np.unique(tuples, axis=0, return_counts=True)
            rows = np.concatenate([distinct, counts[:, None]], axis=1)
        return pa.table(list(rows.T), ["bucket", "f1", "f2", "f3", "n"])

    own = blocks.filter("deleted").select("block", "sizes", "words", "tokens")
    tallies = answers.filter(F.length("own_small") > 0).groupBy("block").cogroup(own.groupBy("block")).applyInArrow(tally, "bucket bigint, f1 bigint, f2 bigint, f3 bigint, n bigint")
    # a grid of fixed size, however many tokens it sums
    weights = learn_weights([tuple(r) for r in tallies.groupBy("bucket", "f1", "f2", "f3").agg(F.sum("n")).collect()], words)
    release(spark)

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        cols = [pa.array([], t) for t in (pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2, pa.int64(), pa.float64())]
        for row, b in blocks_of(right):
            c, f, k, triples, place = _features(b, left.to_pylist(), ranges, stats, False)
            w = weights[k]
            p = w[:, 0] / (words + 1) + w[:, 1] * f[0] + w[:, 2] * f[1] + w[:, 3] * f[2]
            base = np.log10(c + 1) - np.log10(n + words + 1)
            total = lambda x: np.add.reduceat(x, b.starts)  # noqa: E731, B023
            # tokens whose trigram occurs in no training document but this one
            doc = np.repeat(np.arange(len(b.sizes)), b.sizes)
            _, at, own = np.unique(doc * (int(place.max()) + 1) + place, return_inverse=True, return_counts=True)
            new = total((triples == own[at] * ~np.array(row["held_out"], bool)[doc]).astype(np.int64))
            cols = [pa.array(row["doc_id"], pa.int64()), pa.array(row["held_out"], pa.bool_()), pa.array(b.sizes), pa.array(total((c > 0).astype(np.int64))), pa.array(np.full(len(b.sizes), n)), pa.array(total(base)), pa.array(total(np.log10(p))), pa.array(new), pa.array(new / b.sizes)]
        return pa.table(cols, [x.split()[0] for x in SCORES.split(", ")])

    scored = blocks.select("block", "doc_id", "held_out", "sizes", "words", "tokens")
    return answers.select("block", "key", "small", "big").groupBy("block").cogroup(scored.groupBy("block")).applyInArrow(rate, SCORES)


def query(spark, sf_dir):
    """op10_lm_scoring: see the contract."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
