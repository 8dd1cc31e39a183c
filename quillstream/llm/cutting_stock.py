"""Packing by cutting-stock column generation.

Documents are encoded whole.  Every full ``CAPACITY`` tokens of a long document are a
sequence of their own; what remains of it, and every shorter document, is a piece.  The
pieces' lengths, in classes of ``GRAIN`` tokens, make a histogram of at most
CAPACITY / GRAIN rows.  Over it a linear program chooses how often to use each pattern
(a multiset of classes that fits a sequence); a knapsack by dynamic programming prices
new patterns with the program's duals until none improves it.  The solution is rounded
up, so that there is a place for every piece; pieces are ranked within their class, and a
rank is a place of that size, or of a larger one that is left, in a copy of a pattern.

Classes round lengths up, so patterns leave some room.  As documents may be cut freely,
as many sequences are taken away at the end of the list as make the rest exactly large
enough, and their pieces (remainders of long documents first) are cut to fill the
room of the others.  What is left is less than a sequence; it goes to sequences of the
powers of two that add up to it, so nothing is padded at all.  Few documents besides the
long ones are cut: about the share of the patterns' room.

The driver holds the histogram and the patterns, whose number is bounded by the classes.
Ranks and running sums are counted in blocks of ``IN_BLOCK`` rows with carried totals; ids
are kept for pieces only and read again for those that are cut.

Defined cases: null text is empty and still has its end id; repeated rows are packed each
for itself; null ``doc_id`` is carried as it is; texts of any length are encoded whole;
equal lengths are ranked by a hash of their place; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .encoder import encoder, shrinking, tokenizer_file
from .shared import saved, tidy

CAPACITY, GRAIN = 2048, 8
#: Share of the sequences by which the linear program may miss its optimum.
SLACK = 0.001
#: Rows in a block of a ranking or a running sum, about.
IN_BLOCK = 5000

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [c.split()[0] for c in _PLACED.split(", ")]


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """_PIECES of every row of ``docs`` (doc_id, text); ``ids`` (little-endian unsigned
    32-bit) only of what is shorter than ``capacity``."""
    end = np.array([end_id], "<u4").tobytes()
    kinds = [pa.int64()] * 5 + [pa.binary()]
    names = [c.split()[0] for c in _PIECES.split(", ")]

    @shrinking
    def run(batches):
        encode = encoder(path).encode
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                for at in range(0, len(ids), 4 * capacity):
                    piece = ids[at : at + 4 * capacity]
                    rows.append((doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece if len(piece) < 4 * capacity else None))
                    size += len(piece)
                if size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, _PIECES)


def price(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of ``sizes`` (ascending) that fits ``capacity`` and is worth most."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fit = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fit[c]:
            value = worth[: fit[c]] + best[c - sizes[: fit[c]]]
            k = int(value.argmax())
            if value[k] > best[c]:
                best[c], last[c] = value[k], k
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= sizes[last[c]]
    return float(best[capacity]), pattern


def _inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse, by elimination row by row: the driver's threads that numpy's linear
    algebra would start get in the way of the JVM's."""
    m = len(matrix)
    both = np.hstack([matrix, np.eye(m)])
    for k in range(m):
        at = k + int(np.abs(both[k:, k]).argmax())
        both[[k, at]] = both[[at, k]]
        both[k] /= both[k, k]
        others = both[:, k].copy()
        others[k] = 0
        both -= others[:, None] * both[k]
    return both[:, m:]


def patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a column each) and how often the linear program uses them, least room first.

    A place for one size may be taken by a smaller one, so the program also has
    columns that turn a place for a size into one for the next smaller size, at no
    cost; they keep the duals in the order of the sizes and make pricing rare.  Revised
    simplex method from a basis of single-size patterns.  A pattern's worth bounds
    the optimum from below, as the sum of all sizes does; it stops where no pattern is
    worth more than 1, or where less than ``SLACK`` of the sequences is left to gain."""
    m = len(sizes)
    bound = (sizes * demand).sum() / capacity
    times = lambda matrix, vector: (matrix * vector).sum(axis=1)
    # slightly uneven, so that no two rows leave at once
    wanted = demand * (1 + 1e-7 * np.random.default_rng(0).random(m))
    basis = np.diag(capacity // sizes).astype(float)
    cost, inverse = np.ones(m), np.diag(1 / np.diag(basis))
    uses = times(inverse, wanted)
    for step in range(1, 200 * m):
        dual = times(inverse.T, cost)
        falls = dual - np.append(dual[1:], np.inf)
        k = int(falls.argmax())
        column, price_of = np.zeros(m), 0
        if falls[k] > 1e-9:
            column[[k, k + 1]] = 1, -1
        elif dual[0] < -1e-9:
            column[0] = -1
        else:
            worth, pattern = price(sizes, dual, capacity)
            total = uses[cost > 0].sum()
            bound = max(bound, total / worth)
            if worth <= 1 + 1e-9 or total - bound < max(0.5, SLACK * total):
                break
            column[:], price_of = pattern, 1
        change = times(inverse, column)
        ratio = np.where(change > 1e-9, uses / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out], cost[out] = column, price_of
        if step % 200 == 0:
            inverse = _inverted(basis)
            uses = np.maximum(times(inverse, wanted), 0)
        else:
            row, moved = inverse[out] / change[out], ratio[out]
            uses = np.maximum(uses - change * moved, 0)
            uses[out] = moved
            inverse -= change[:, None] * row
            inverse[out] = row
    real = cost > 0
    chosen, uses = basis[:, real].round().astype(np.int64), uses[real]
    order = np.argsort(capacity - times(chosen.T, sizes), kind="stable")
    return chosen[:, order], uses[order]


class Plan:
    """Places for ranked pieces: ``count`` sequences of patterns, and the sizes of those after them.

    ``histogram``: class -> (count, tokens)."""

    def __init__(self, histogram: dict[int, tuple[int, int]], capacity: int = CAPACITY, grain: int = GRAIN):
        sizes = np.array(sorted(histogram), np.int64)
        demand = np.array([histogram[s][0] for s in sizes.tolist()], np.int64)
        total = sum(t for _, t in histogram.values())
        chosen, uses = patterns(sizes, demand, capacity // grain)
        copies = np.ceil(uses - 1e-6).astype(np.int64)
        # every piece has a place of its size or more, even where rounding is short by a hair
        at_least = lambda x: np.cumsum(x[::-1])[::-1]
        short = at_least(demand) - at_least(chosen @ copies)
        if (short > 0).any():
            largest = np.zeros((len(sizes), 1), np.int64)
            largest[-1] = capacity // grain // sizes[-1]
            chosen, copies = np.hstack([chosen, largest]), np.append(copies, -(-short.max() // largest[-1, 0]))
        first = np.concatenate([[0], np.cumsum(copies)])[:-1]
        #: as many as the tokens fill; pieces of the others are cut to fill the room of these
        self.count = min(int(copies.sum()), total // capacity)
        rest = total - self.count * capacity
        self.after = [capacity] * (rest // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if rest % capacity >> b & 1]
        kept = np.clip(self.count - first, 0, copies)
        #: class -> runs of ranks: (first rank, first place, places a sequence, first sequence)
        self.runs: dict[int, list[tuple[int, int, int, int]]] = {}
        self.held: dict[int, int] = {}
        free: list[list[int]] = []  # places left: (count, first place, places a sequence, first sequence)
        for k in reversed(range(len(sizes))):
            free += [[int(chosen[k, p] * kept[p]), 0, int(chosen[k, p]), int(first[p])] for p in reversed(np.flatnonzero((chosen[k] > 0) & (kept > 0)))]
            rank, n, runs = 0, int(demand[k]), []
            while rank < n and free:
                left, place, each, sequence = free[-1]
                take = min(left, n - rank)
                runs.append((rank, place, each, sequence))
                rank += take
                if take == left:
                    free.pop()
                else:
                    free[-1][:2] = left - take, place + take
            self.runs[int(sizes[k])], self.held[int(sizes[k])] = runs, rank

    def sequences(self, size: int, rank: np.ndarray) -> np.ndarray:
        """The sequence of each rank below ``held[size]``."""
        begin, place, each, sequence = np.array(self.runs[size], np.int64).T
        k = np.searchsorted(begin, rank, side="right") - 1
        return sequence[k] + (rank - begin[k] + place[k]) // each[k]


def _blocked(df: DataFrame, within: list[str], block: Column, order: list, value: Column) -> DataFrame:
    """``df`` (a written table) with ``before``: the sum of ``value`` over the rows that come earlier in the order
    of (block, ``order``) among equal ``within``; a block is one task's, blocks are added up."""
    cut = df.withColumns({"_block": block, "_value": value})
    inside = Window.partitionBy(*within, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(*within).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.groupBy(*within, "_block").agg(F.sum("_value").alias("_sum")).withColumn("_carried", F.coalesce(F.sum("_sum").over(across), F.lit(0).cast("long"))).drop("_sum")
    rows = cut.withColumn("before", F.sum("_value").over(inside) - F.col("_value"))
    return rows.join(carried, [*within, "_block"]).withColumn("before", F.col("before") + F.col("_carried")).drop("_block", "_value", "_carried")


def _placed(plan: Plan):
    def run(batches):
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("size", "rank"))
            sequence = np.zeros(len(size), np.int64)
            for s in np.unique(size).tolist():
                of = size == s
                sequence[of] = plan.sequences(s, rank[of])
            kept = [batch.column(c) for c in _NAMES[:5]]
            yield pa.RecordBatch.from_arrays([*kept, batch.column("row"), pa.array(sequence)], [*_NAMES[:5], "row", "sequence"])

    return run


@tidy
def pack(cut: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """_PLACED of ``cut`` (as of ``pieces``, a written table with a number ``row`` for each)."""
    spark = cut.sparkSession
    full = cut.filter(F.col("length") == capacity).select(*_NAMES[:5], F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # remainders of long documents are ranked last: they are the first to be cut again
    size, order = F.expr(f"(length + {grain - 1}) div {grain}"), F.struct((F.col("start") > 0).alias("late"), F.xxhash64("row").alias("u"), "row")
    small = cut.filter(F.col("length") < capacity).withColumns({"size": size, "order": order})
    counts = small.groupBy("size").agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).collect()  # as many rows as classes at most
    if not counts:
        return full
    plan = Plan({r["size"]: (r["n"], r["tokens"]) for r in counts}, capacity, grain)

    # ranks: hashes fall evenly into blocks, whose order is that of the hashes
    blocks = F.broadcast(spark.createDataFrame([(r["size"], r["n"] // IN_BLOCK + 1) for r in counts], "size long, blocks long"))
    some = small.drop("ids").join(blocks, "size")
    even = F.floor((F.col("order.u") / F.lit(2.0**64) + 0.5) * F.col("blocks"))
    block = F.when(F.col("order.late"), F.col("blocks") + 1).otherwise(0) + even
    ranked = saved(_blocked(some, ["size"], block, ["order"], F.lit(1).cast("long")).withColumnRenamed("before", "rank").drop("blocks"), "ranked")
    held = F.broadcast(spark.createDataFrame([(r["size"], plan.held[r["size"]]) for r in counts], "size long, held long"))
    by_place = ranked.join(held, "size")

    # pieces with a place
    whole = by_place.filter("rank < held").select(*_NAMES[:5], "row", "size", "rank").mapInArrow(_placed(plan), _PLACED.replace("sequence_id long, offset long", "row long, sequence long"))
    upto = Window.partitionBy("sequence").orderBy(F.desc("length"), "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = saved(whole.withColumn("offset", F.coalesce(F.sum("length").over(upto), F.lit(0).cast("long"))), "placed")

    # the room of every sequence, and of those after them, as one line of tokens
    after = F.array(*[F.lit(v).cast("long") for v in plan.after or [0]])
    sequences = spark.range(plan.count + len(plan.after)).withColumnRenamed("id", "sequence")
    room = F.when(F.col("sequence") < plan.count, capacity).otherwise(F.get(after, (F.col("sequence") - plan.count).cast("int")))
    used = placed.groupBy("sequence").agg(F.sum("length").alias("used"))
    rooms = sequences.join(used, "sequence", "left").fillna(0, "used").withColumn("room", room - F.col("used")).filter("room > 0")
    rooms = _blocked(saved(rooms, "rooms"), [], F.expr(f"sequence div {IN_BLOCK}"), ["sequence"], F.col("room"))

    # the pieces that fill it, as another
    fill = saved(by_place.filter("rank >= held").select(*_NAMES[:5], "row", "size", "order"), "filling")
    n = fill.count()
    line = _blocked(fill.select("row", "length"), [], F.pmod(F.xxhash64("row"), F.lit(n // IN_BLOCK + 1)), ["row"], F.col("length"))
    cells = lambda df, size: df.withColumn("cell", F.explode(F.sequence(F.expr(f"at div {capacity}"), F.expr(f"(at + {size} - 1) div {capacity}"))))
    a = cells(line.withColumnRenamed("before", "at"), "length")
    b = cells(rooms.withColumnRenamed("before", "at"), "room").withColumnRenamed("at", "room_at")
    lo, hi = F.greatest("at", "room_at"), F.least(F.col("at") + F.col("length"), F.col("room_at") + F.col("room"))
    met = a.join(b, "cell").filter((lo < hi) & (F.col("cell") == F.floor(lo / capacity)))
    parts = met.select("row", (lo - F.col("at")).alias("skip"), (hi - lo).alias("part"), "sequence", (F.col("used") + lo - F.col("room_at")).alias("offset"))

    # ids of the pieces to cut: those of a class from a rank on, told by their order
    starts = ranked.join(held, "size").filter("rank = held").select("size", F.col("order").alias("from"))  # one row a class at most
    texts = small.join(F.broadcast(starts), "size").filter(F.col("order") >= F.col("from")).select(*_NAMES[:5], "row", "ids")
    ids = F.expr("crc32(substring(ids, cast(4 * skip + 1 as int), cast(4 * part as int)))")
    cuts = parts.join(texts, "row").select("doc_id", (F.col("start") + F.col("skip")).alias("start"), F.col("part").alias("length"), ids.alias("ids_crc32"), "doc_tokens", (-1 - F.col("sequence")).alias("sequence_id"), "offset")
    return full.unionByName(placed.select(*_NAMES[:5], (-1 - F.col("sequence")).alias("sequence_id"), "offset")).unionByName(cuts)


@tidy
def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and pack them: one row for each piece."""
    cut = pieces(docs, tokenizer or tokenizer_file("byte_bpe_50k.json"), end_id, capacity)
    return pack(saved(cut.withColumn("row", F.monotonically_increasing_id()), "cut"), capacity)


def query(spark, sf_dir):
    """op13_cutting_stock_packing: see the contract."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
