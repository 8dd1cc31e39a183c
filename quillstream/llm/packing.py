"""Bound-certified best-fit packing of token sequences.

Documents are encoded whole and cut only where they exceed the capacity.  The
pieces are dealt by hash into partitions of a bounded number of pieces; each is
packed by best-fit decreasing and its number of bins is compared with a lower
bound from dual-feasible functions.  A partition that meets its bound is
certified and gives up only its emptiest bin; one with a gap gives up every bin
that is not full.  What was given up is dealt anew, into fewer partitions, and
packed again, until the total meets the bound of the whole, one partition is
left, or, after ``ROUNDS`` rounds (a parameter), a round no longer lowers the total; the log tells how
far from the bound it ends.

Defined cases: null text is empty and still gives its end id; repeated rows are
packed each for itself; null ``doc_id`` is carried as it is; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import logging
import zlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoder import encoder, shrinking, tokenizer_file
from .shared import saved, tidy

log = logging.getLogger(__name__)

CAPACITY = 4096
#: Pieces in a partition of the packing, about.
PER_PARTITION = 3000
#: Rounds of exchange before one that gains nothing ends it; each shrinks the pieces
#: in play to the loose bins.
ROUNDS = 6

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = f"{PIECES}, sequence_id bigint, offset bigint, bins bigint, bound bigint, loose boolean"


def encode_pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian unsigned
    32-bit, if asked for) of every row of ``docs`` (doc_id, text)."""
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    @shrinking
    def run(batches):
        encode = encoder(path).encode
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    row = (doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece), piece)
                    for column, value in zip(out, row):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, PIECES + ", ids binary" * with_ids)


def lower_bound(size: np.ndarray, count: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that ``count`` pieces of each ``size`` (ascending) need at least: the
    best of the dual-feasible functions u(k) for k up to 20 and U(e) for every e."""
    if not len(size):
        return 0
    best = -(-int((size * count).sum()) // capacity)
    for k in range(1, 21):
        up = (k + 1) * size
        # in units of 1 / (k * capacity), so that all is whole
        value = np.where(up % capacity == 0, size * k, up // capacity * capacity)
        best = max(best, -(-int((value * count).sum()) // (k * capacity)))
    # U(e): sizes above capacity - e count as whole bins, those below e as none
    total = np.concatenate([[0], np.cumsum(size * count)])
    above = np.concatenate([np.cumsum(count[::-1])[::-1], [0]])
    e = size[size <= capacity // 2]
    lo, hi = np.searchsorted(size, e), np.searchsorted(size, capacity - e, side="right")
    if len(e):
        best = max(best, int((-(-(total[hi] - total[lo]) // capacity) + above[hi]).max()))
    return max(best, int(count[2 * size > capacity].sum()))


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length (given in descending order), and the room left in each bin.

    Bins with equal room stand in one stack; a mask with a bit for each room
    that occurs gives the tightest fit without a search.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        fits = mask >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, n
            n += 1
        bins[i], offsets[i] = b, capacity - room
        if room > length:
            if not stacks[room - length]:
                mask |= 1 << (room - length)
            stacks[room - length].append(b)
    rooms = np.zeros(n, np.int64)
    for room, stack in enumerate(stacks):
        rooms[stack] = room
    return bins, offsets, rooms


def _pack_partition(capacity: int, number: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("start", "ascending")])
        lengths = table.column("length").to_numpy()
        bins, offsets, rooms = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(*np.unique(lengths, return_counts=True), capacity)
        loose = rooms > 0 if len(rooms) > bound else rooms == rooms.max()
        loose &= rooms > 0
        part = table.column("part")[0].as_py()
        cols = [table.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        cols += [pa.array((number << 52) + (part << 24) + bins), pa.array(offsets), pa.array(np.full(len(bins), len(rooms))), pa.array(np.full(len(bins), bound)), pa.array(loose[bins])]
        return pa.table(cols, [x.split()[0] for x in PLACED.split(", ")])

    return run


@tidy
def pack(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION, rounds: int | None = None) -> DataFrame:
    """``pieces`` (as of ``encode_pieces``, a written table) with sequence_id, offset, and bins and
    bound of the partition that placed them last."""
    left, done = pieces, []
    histogram = sorted(tuple(r) for r in left.groupBy("length").count().collect())  # as many rows as the capacity at most
    n = sum(k for _, k in histogram)
    whole = lower_bound(*map(np.array, zip(*histogram)), capacity) if n else 0
    settled, before = 0, None
    for number in count():
        parts = max(1, -(-n // per_partition))
        # by place in the written table: repeated rows are dealt like any others
        dealt = left.withColumn("part", F.pmod(F.xxhash64(F.lit(number), F.monotonically_increasing_id()), F.lit(parts)))
        placed = saved(dealt.groupBy("part").applyInArrow(_pack_partition(capacity, number), PLACED), "packed")
        sums = placed.agg(F.count_distinct(F.when(~F.col("loose"), F.col("sequence_id"))).alias("kept"), F.count_distinct("sequence_id").alias("all"), F.sum(F.col("loose").cast("long")).alias("n")).first()
        n = sums["n"] or 0
        total = settled + sums["all"]
        gained = before is None or total < before
        if parts == 1 or not n or total <= whole or (number >= (ROUNDS if rounds is None else rounds) - 1 and not gained):
            done.append(placed)
            log.info("%d sequences, the lower bound is %d", total, whole)
            break
        settled, before = settled + sums["kept"], total
        done.append(placed.filter(~F.col("loose")))
        left = placed.filter("loose").select(*pieces.columns)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("loose")


@tidy
def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and pack them: one row for each piece."""
    pieces = encode_pieces(docs, tokenizer or tokenizer_file("word_bpe_49k.json"), end_id, capacity)
    return pack(saved(pieces, "pieces"), capacity)


def query(spark, sf_dir):
    """op2_best_fit_packing: see the contract."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
