"""Quality by perplexity under an interpolated modified Kneser-Ney trigram model.

Trusted text is that of documents with ``quality`` 1.  Texts fall into two folds
by their hash; there is a model for each fold, and every document is scored by
the model of the other one, so that no text, nor a copy of it, is judged by its
own counts.  A model is trained on a bounded sample of its fold's trusted texts:
whole distinct texts in the order of their hashes, ``TRUSTED_CHARS`` characters
at most, whatever the size of the trusted text (``sample`` fills it up to the bound).

Trigrams are sorted and counted in the tasks that read them and dealt, packed,
by their middle word; a shard of middle words has all that is counted there:
trigrams, the pairs' continuation counts, both contexts' totals and counts of
counts, and its share of the words' continuation counts.  Counts stand by ranges
of their keys.

    p(w | u v) = [c(uvw) - D]/c(uv) + g(uv) ([n(vw) - D]/n(v) + g(v) p(w))

Every document is scored whole, by joins of its n-grams' keys with the sharded
counts.  A bit table of the model rules most keys out.  Shards that have at most
``BROADCAST_BYTES`` together, as the bound on the sample makes them, are broadcast
one by one, and a task joins the distinct keys of about a megabyte of text with
each shard in turn, so no text moves.  Larger models are joined by a shuffle:
documents are packed into blocks, a block sends its distinct keys to the ranges,
sharded joins answer them, and the answers meet the block again.  Both ways give
the same numbers.
The cross-fitted perplexities of trusted documents set a limit for each language,
their ``QUANTILE`` times ``MARGIN``; documents beyond it are not kept.  The margin is there since
the quantile itself gives up one in a hundred texts that are as good as the trusted ones.

Bounds: a model has at most ``TRUSTED_CHARS`` tokens, so its counts, and the
groups that train it, are bounded; the bit tables have ``TRUSTED_CHARS`` bytes
together at most.

Defined cases: null or empty text has no word: perplexity null, not kept; a null
``lang`` is a language of its own; a language without trusted documents has the
limit of all; repeated rows are scored alike and train once; equal hashes are one text;
without trusted text all is kept that has words; trusted texts that are all longer than the
bound raise an error; very long texts are scored whole; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BOS, Block, before, blocks_of, key, packed, squeeze, squeeze_keys, token_runs, unsqueeze, unsqueeze_keys
from .shared import release, saved, tidy
from .textnum import U

#: Characters of trusted text that a fold's model is trained on, at most.
TRUSTED_CHARS = 6_000_000
QUANTILE, MARGIN = 0.99, 1.25
FOLDS = 2
#: Parts of a range of hashes that are looked at at once; how full a sample is to be; looks at most.
BUCKETS, FILLED, LOOKS = 4096, 0.9, 100
#: Trusted characters for each shard of middle words, and range of keys.
SHARD_CHARS = 1_500_000
#: Blocks that one answering task serves; picked rows that are broadcast.
BLOCKS_AT_ONCE, PICKS_AT_ONCE = 64, 200_000
#: Shards of counts that are broadcast: bytes of keys and counts.
BROADCAST_BYTES = 256 << 20
#: Languages whose limits are broadcast; more are joined by a shuffle.
LANGUAGES_AT_ONCE = 100_000


def _ranges(rows: DataFrame, chars: int) -> tuple[list[tuple[int, int]], int]:
    """Ranges of ``place`` whose texts (place, size) have ``chars`` characters at most, and how many they are.

    Sub-ranges are taken in order while they fit and what doesn't fit is looked at more
    closely, down to single texts; it ends where all is taken or the sample is filled to
    ``FILLED``, or only texts longer than what is left were met ``LOOKS`` times.  Sums of at most
    BUCKETS sub-ranges come to the driver."""
    taken, left, n = [], chars, 0
    todo = [(0, 1 << 63)]
    for _ in range(LOOKS):
        if not todo or left < (1 - FILLED) * chars:
            break
        lo, hi = todo.pop()
        step = max(1, -(-(hi - lo) // BUCKETS))
        inside = rows.filter(F.col("place").between(lo, hi - 1)).groupBy(F.expr(f"(place - {lo}L) div {step}L").alias("b"))
        at = lo
        for bucket, size, count in inside.agg(F.sum("size"), F.count("*")).orderBy("b").collect():
            if size <= left:
                left, n = left - size, n + count
                continue
            first = lo + bucket * step
            taken.append((at, first))
            at = min(first + step, hi)
            # the rest of the range comes after a closer look at this part of it
            if at < hi:
                todo.append((at, hi))
            if count > 1 and step > 1:
                todo.append((first, at))
            break
        else:
            taken.append((at, hi))
    return [r for r in taken if r[0] < r[1]], n


@tidy
def sample(docs: DataFrame, trusted: DataFrame, chars: int) -> DataFrame:
    """fold, text: distinct trusted texts of each fold in the order of their hashes,
    ``chars`` characters at most; a text that doesn't fit any more is passed over.

    A sample that stays empty beside trusted words is an error, not a model."""
    rows = docs.filter("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("size"))
    distinct = rows.join(trusted, "doc_id", "left_semi").groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("size").alias("size"))
    place = F.shiftrightunsigned("h", 1)
    distinct = saved(distinct.select("h", "doc_id", "size", F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold"), place.alias("place")), "trusted-hashes")
    chosen, n = F.lit(False), 0
    for fold in range(FOLDS):
        ranges, count = _ranges(distinct.filter(F.col("fold") == fold).select("place", "size"), chars)
        n += count
        for lo, hi in ranges:
            chosen = chosen | ((F.col("fold") == fold) & F.col("place").between(lo, hi - 1))
    if not n and distinct.limit(1).count():
        raise ValueError(f"no trusted text has at most {chars} characters: nothing to train on")
    picks = distinct.filter(chosen).select("h", "doc_id", "fold")
    picks = F.broadcast(picks) if n <= PICKS_AT_ONCE else picks
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").join(picks, ["doc_id", "h"])
    return saved(texts.dropDuplicates(["fold", "h"]).select("fold", "text"), "trusted")


GRAMS = "fold int, shard int, u binary, v binary, w binary, c binary"


def _trigrams(shards: int):
    """Distinct trigrams of each run of texts, with counts, by shard of the middle word."""

    def run(batches):
        for batch in batches:
            fold = batch.column(0).to_numpy()
            out = []
            for a, b, sizes, w in token_runs(batch.column(1)):
                starts = np.cumsum(sizes) - sizes
                v = before(w, starts, BOS)
                u = before(v, starts, BOS)
                f = np.repeat(fold[a:b], sizes)
                _, first, counts = np.unique(key(w, v, u) ^ f.astype(U), return_index=True, return_counts=True)
                u, v, w, f = u[first], v[first], w[first], f[first]
                place = f * shards + (key(v) % U(shards)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                cut = np.searchsorted(place[order], np.arange(FOLDS * shards + 1))
                for k in np.flatnonzero(np.diff(cut)):
                    at = order[cut[k] : cut[k + 1]]
                    out.append((int(k) // shards, int(k) % shards, u[at].tobytes(), v[at].tobytes(), w[at].tobytes(), counts[at].astype("<u4").tobytes()))
            kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 4
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], [c.split()[0] for c in GRAMS.split(", ")])

    return run


#: A range's keys, ascending, and whole numbers for each: kind ``COUNT`` has the
#: count and its context's total (of words: the shard's share of the count);
#: ``CONTEXT`` total and numbers of continuations seen once, twice, more;
#: ``STATISTIC`` (range -1) counts of counts 1 to 4.
COUNT, CONTEXT, STATISTIC = 0, 1, 2
MODEL = "fold int, ord int, rng int, kind int, keys binary, vals binary"


def _edges(ranges: int) -> np.ndarray:
    return np.array([(r << 64) // ranges for r in range(ranges)], dtype=U)


def _by_range(keys: np.ndarray, ranges: int):
    """(range, slice) of ascending keys."""
    cut = np.append(np.searchsorted(keys, _edges(ranges)), len(keys))
    return [(int(r), slice(cut[r], cut[r + 1])) for r in np.flatnonzero(np.diff(cut))]


def _contexts(place: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """n x 4: total and numbers of continuations with count 1, 2, more."""
    parts = [np.bincount(place, c, n)] + [np.bincount(place, c == k if k < 3 else c >= 3, n) for k in (1, 2, 3)]
    return np.stack(parts, axis=1).astype(np.int64)


def _count(ranges: int):
    """MODEL rows of a shard of middle words."""

    def run(table: pa.Table) -> pa.Table:
        fold = table.column("fold")[0].as_py()
        u, v, w, c = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(n)]) for n, kind in (("u", U), ("v", U), ("w", U), ("c", "<u4")))
        out = []

        def add(order, kind, keys, values):
            for r, s in _by_range(keys, ranges):
                out.append((fold, order, r, kind, keys[s].tobytes(), np.ascontiguousarray(values[s]).astype("<u4").tobytes()))

        def statistic(order, counts):
            out.append((fold, order, -1, STATISTIC, b"", np.bincount(np.minimum(counts, 5), minlength=6)[1:5].astype("<i8").tobytes()))

        triples, first, place = np.unique(key(w, v, u), return_index=True, return_inverse=True)
        c3 = np.bincount(place, c, len(triples)).astype(np.int64)
        u, v, w = u[first], v[first], w[first]
        context, at = np.unique(key(v, u), return_inverse=True)
        facts = _contexts(at, c3, len(context))
        add(3, COUNT, triples, np.stack([c3, facts[at, 0]], axis=1))
        add(2, CONTEXT, context, facts)
        statistic(3, c3)
        pairs, first, at = np.unique(key(w, v), return_index=True, return_inverse=True)
        # nothing stands before a beginning: pairs there count as often as they occur
        c2 = np.bincount(at, np.where(v == BOS, c3, 1), len(pairs)).astype(np.int64)
        v, w = v[first], w[first]
        context, at = np.unique(key(v), return_inverse=True)
        facts = _contexts(at, c2, len(context))
        add(2, COUNT, pairs, np.stack([c2, facts[at, 0]], axis=1))
        add(1, CONTEXT, context, facts)
        statistic(2, c2)
        words, c1 = np.unique(key(w), return_counts=True)
        add(1, COUNT, words, c1[:, None])
        kinds = [pa.int32()] * 4 + [pa.binary()] * 2
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], [x.split()[0] for x in MODEL.split(", ")])

    return run


def _entries(rows: list[dict], order: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys and their numbers from some MODEL rows; words' shares are added up."""
    width = 4 if kind == CONTEXT else 1 if order == 1 else 2
    mine = [r for r in rows if r["kind"] == kind]
    keys = np.concatenate([np.frombuffer(r["keys"], U) for r in mine] + [np.zeros(0, U)])
    values = np.concatenate([np.frombuffer(r["vals"], "<u4").reshape(-1, width) for r in mine] + [np.zeros((0, width), "<u4")]).astype(np.int64)
    if kind == COUNT and order == 1:
        keys, place = np.unique(keys, return_inverse=True)
        return keys, np.bincount(place, values[:, 0], len(keys)).astype(np.int64)[:, None]
    by = np.argsort(keys)
    return keys[by], values[by]


def _statistics(table: pa.Table) -> pa.Table:
    """Counts of counts 1 to 4, sum and number of the counts of a fold and order (words: of a range)."""
    rows = table.to_pylist()
    fold, order = rows[0]["fold"], rows[0]["ord"]
    if order == 1:
        c = _entries(rows, 1, COUNT)[1][:, 0]
        n, total, words = np.bincount(np.minimum(c, 5), minlength=6)[1:5], int(c.sum()), len(c)
    else:
        n, total, words = sum(np.frombuffer(r["vals"], "<i8") for r in rows), 0, 0
    return pa.table([pa.array([x]) for x in (fold, order, *map(int, n), total, words)], ["fold", "ord", "n1", "n2", "n3", "n4", "total", "words"])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ of modified Kneser-Ney, from the counts of counts."""
    n1, n2, n3, n4 = (n or 1 for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


class Model:
    """A trained model: the sharded counts, and what is known of them as a whole."""

    def __init__(self, counts: DataFrame, ranges: int):
        self.counts, self.ranges = counts, ranges
        basis = counts.filter((F.col("kind") == STATISTIC) | ((F.col("ord") == 1) & (F.col("kind") == COUNT)))
        basis = basis.groupBy("fold", "ord", "rng").applyInArrow(_statistics, "fold bigint, ord bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint, total bigint, words bigint")
        sums = basis.groupBy("fold", "ord").agg(*[F.sum(c) for c in ("n1", "n2", "n3", "n4", "total", "words")])
        # a row for each fold and order
        facts = {(r[0], r[1]): r[2:] for r in sums.collect()}
        self.discounts = {k: np.array(discounts(*n[:4])) for k, n in facts.items()}
        self.total, self.unknown = {}, {}
        for f in range(FOLDS):
            n1, n2, n3, _, total, words = facts.get((f, 1), (0, 0, 0, 0, 0, 0))
            self.total[f] = max(total, 1)
            d = self.discounts.get((f, 1), np.zeros(3))
            left = d[0] * n1 + d[1] * n2 + d[2] * (words - n1 - n2)
            self.unknown[f] = (left / total if total else 1.0) / (words + 1)

    def closed(self) -> dict:
        """What tasks need besides the counts."""
        return {"ranges": self.ranges, "discounts": self.discounts, "total": self.total, "unknown": self.unknown}


def train(texts: DataFrame, chars: int = TRUSTED_CHARS) -> Model:
    """The models of all folds from ``texts`` (fold, text)."""
    parts = max(1, -(-chars // SHARD_CHARS))
    grams = texts.mapInArrow(_trigrams(parts), GRAMS)
    return Model(saved(grams.groupBy("fold", "shard").applyInArrow(_count(parts), MODEL), "kneser-ney"), parts)


class Bits:
    """Which keys a model may have: a bit for the high bits of each of its keys."""

    def __init__(self, tables: dict[int, bytes], bits: int):
        self.tables, self.bits = tables, bits

    def may_have(self, fold: int, keys: np.ndarray) -> np.ndarray:
        if fold not in self.tables:
            return np.zeros(len(keys), bool)
        at = (keys >> U(64 - self.bits)).astype(np.int64)
        return (np.frombuffer(self.tables[fold], np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bit_tables(model: Model, chars: int) -> Bits:
    bits = max(16, int(np.ceil(np.log2(max(chars, 1)))) + 2)

    def run(table: pa.Table) -> pa.Table:
        there = np.zeros(1 << bits, bool)
        for keys in table.column("keys"):
            there[(np.frombuffer(keys.as_buffer(), U) >> U(64 - bits)).astype(np.int64)] = True
        return pa.table([table.column("fold")[:1], pa.array([np.packbits(there, bitorder="little").tobytes()])], ["fold", "bits"])

    rows = model.counts.filter(F.col("kind") != STATISTIC).select("fold", "keys").groupBy("fold").applyInArrow(run, "fold int, bits binary").collect()
    return Bits({r["fold"]: bytes(r["bits"]) for r in rows}, bits)


_BEGIN = {1: key(np.array([BOS])), 2: key(np.array([BOS]), np.array([BOS])), 3: np.zeros(0, U)}


def _asked(b: Block, order: int, fold: int, bits: Bits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct keys and the beginning's, whether each is asked for, and every
    token's place among them (after them, the beginning's)."""
    keys, place = np.unique(np.concatenate([b.grams(order), _BEGIN[order]]), return_inverse=True)
    return keys, bits.may_have(fold, keys), place


ASKED = "fold int, ord int, rng int, block bigint, keys binary"
ANSWERS = "block bigint, ord int, rng int, vals binary"


def _prepared(rows: list[dict], fold: int, order: int, facts: dict) -> list[tuple]:
    """From a range's MODEL rows (keys, number, number of other keys): two of them,
    of trigrams one, as they go into p(w | u v)."""
    d = facts["discounts"]
    keys, n = _entries(rows, order, COUNT)
    spare = n[:, 0] - d[fold, order][np.minimum(n[:, 0], 3) - 1] if len(keys) else np.zeros(0)
    if order == 1:
        out = [(keys, spare / facts["total"][fold] + facts["unknown"][fold], facts["unknown"][fold])]
    else:
        out = [(keys, spare / n[:, 1], 0.0)]
    if order < 3:
        keys, n = _entries(rows, order, CONTEXT)
        out.append((keys, n[:, 1:] @ d[fold, order + 1] / n[:, 0] if len(keys) else np.zeros(0), 1.0))
    return [(keys, x.astype("<f4"), np.float32(absent)) for keys, x, absent in out]


def _join(prepared: list[tuple], wanted: np.ndarray) -> list[np.ndarray]:
    """The numbers of ascending keys."""
    out = []
    for keys, x, absent in prepared:
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        out.append(np.where(keys[at] == wanted, x[at], absent) if len(keys) else np.full(len(wanted), absent))
    return out


def _answer(facts: dict):
    """Join a range's counts with the keys that blocks ask for."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asks, out = right.to_pylist(), []
        if asks:
            order = asks[0]["ord"]
            prepared = _prepared(left.to_pylist(), asks[0]["fold"], order, facts)
            for a in asks:
                out.append((a["block"], order, a["rng"], squeeze(np.concatenate(_join(prepared, unsqueeze_keys(a["keys"]))).astype("<f4"))))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], [c.split()[0] for c in ANSWERS.split(", ")])

    return run


def _probabilities(b: Block, fold: int, answer, bits: Bits, facts: dict) -> np.ndarray:
    """log10 of every token's probability; ``answer(order, range, keys)`` joins with the counts."""
    columns = {}
    for order in (1, 2, 3):
        keys, asked, place = _asked(b, order, fold, bits)
        defaults = {1: (facts["unknown"][fold], 1.0), 2: (0.0, 1.0), 3: (0.0,)}[order]
        values = [np.full(len(keys), np.float32(x)) for x in defaults]
        wanted = np.flatnonzero(asked)
        for r, s in _by_range(keys[wanted], facts["ranges"]):
            for x, y in zip(values, answer(order, r, keys[wanted[s]])):
                x[wanted[s]] = y
        columns[order] = [x[place].astype(float) for x in values]
    n = len(b.tokens)
    back2 = before(columns[1][1][:n], b.starts, columns[1][1][-1])
    back3 = before(columns[2][1][:n], b.starts, columns[2][1][-1])
    return np.log10(columns[3][0] + back3 * (columns[2][0][:n] + back2 * columns[1][0][:n]))


SCORES = "doc_id bigint, language string, n_tokens bigint, log10_prob double"


def score(docs: DataFrame, model: Model, bits: Bits, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """SCORES of ``docs`` (doc_id, language, text), each by the other fold's model."""
    other = F.pmod(F.coalesce(F.xxhash64("text"), F.lit(0)) + 1, F.lit(FOLDS)).cast("int")
    rows = docs.select(other.alias("fold"), F.col("doc_id").cast("long").alias("doc_id"), "language", "text")
    size = model.counts.agg(F.sum(F.length("keys") + F.length("vals"))).first()[0] or 0
    return _score_in_place(rows, model, bits) if size <= broadcast_bytes else _score_by_shuffle(rows, model, bits)


def _score_in_place(rows: DataFrame, model: Model, bits: Bits) -> DataFrame:
    spark, facts = rows.sparkSession, model.closed()
    tables, shared = spark.sparkContext.broadcast(bits), []
    for r in range(model.ranges):
        found: dict[tuple, list] = {}
        for x in model.counts.filter((F.col("rng") == r) & (F.col("kind") != STATISTIC)).collect():
            found.setdefault((x["fold"], x["ord"]), []).append(x.asDict())
        shared.append(spark.sparkContext.broadcast({k: _prepared(x, *k, facts) for k, x in found.items()}))

    def run(batches):
        for batch in batches:
            folds = batch.column(0).to_numpy(zero_copy_only=False)
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for a, b, sizes, tokens in token_runs(batch.column(3)):
                for fold in np.unique(folds[a:b]).tolist():
                    mine = folds[a:b] == fold
                    block = Block(sizes[mine], tokens[np.repeat(mine, sizes)])

                    def answer(order, r, keys, fold=fold):
                        prepared = shared[r].value.get((fold, order))
                        return _join(prepared, keys) if prepared else []

                    x = _probabilities(block, fold, answer, tables.value, facts)
                    at = np.flatnonzero(mine) + a
                    n[at], total[at] = block.sizes, np.add.reduceat(x, block.starts)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(n), pa.array(total)], [c.split()[0] for c in SCORES.split(", ")])

    return rows.mapInArrow(run, SCORES)


def _score_by_shuffle(rows: DataFrame, model: Model, bits: Bits) -> DataFrame:
    blocks = packed(rows, "quality-blocks")
    shared, facts = rows.sparkSession.sparkContext.broadcast(bits), model.closed()

    def ask(batches):
        for batch in batches:
            out = []
            for row, b in blocks_of(batch):
                for order in (1, 2, 3):
                    keys, asked, _ = _asked(b, order, row["fold"], shared.value)
                    keys = keys[asked]
                    out += [(row["fold"], order, r, row["block"], squeeze_keys(keys[s])) for r, s in _by_range(keys, facts["ranges"])]
            kinds = [pa.int32()] * 3 + [pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], [c.split()[0] for c in ASKED.split(", ")])

    # a range's counts serve some blocks at a time: they are few beside what is asked
    salts = max(1, -(-blocks.count() // BLOCKS_AT_ONCE))
    by = ["fold", "ord", "rng", "salt"]
    asked = blocks.select("block", "fold", "sizes", "words", "tokens").mapInArrow(ask, ASKED).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    counts = model.counts.filter(F.col("kind") != STATISTIC).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    answers = counts.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(_answer(facts), ANSWERS)

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[] for _ in range(4)]
        for row, b in blocks_of(left):
            found = {(a["ord"], a["rng"]): a["vals"] for a in right.to_pylist()}
            x = _probabilities(b, row["fold"], lambda order, r, keys: unsqueeze(found[order, r], "<f4", len(keys) * (2 if order < 3 else 1)).reshape(-1, len(keys)), shared.value, facts)  # noqa: B023
            for column, values in zip(out, (row["doc_id"], row["language"], b.sizes.tolist(), np.add.reduceat(x, b.starts).tolist())):
                column += values
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds)], [c.split()[0] for c in SCORES.split(", ")])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(rate, SCORES)


@tidy
def classify(docs: DataFrame, labels: DataFrame, chars: int = TRUSTED_CHARS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, lang, n_tokens, log10_prob, perplexity, max_perplexity, kept for
    every row of ``docs`` (doc_id, text, lang); ``labels`` (doc_id, quality)."""
    good = labels.filter("quality = 1").select("doc_id").distinct()
    model = train(sample(docs.select("doc_id", "text"), good, chars), chars)
    bits = bit_tables(model, chars)
    release(docs.sparkSession)
    scored = saved(score(docs.select("doc_id", F.col("lang").alias("language"), "text"), model, bits, broadcast_bytes), "scored")
    release(docs.sparkSession)
    scored = scored.withColumn("perplexity", F.when(F.col("n_tokens") > 1, F.pow(F.lit(10.0), -F.col("log10_prob") / F.col("n_tokens"))))
    k = F.coalesce(F.concat(F.lit("="), "language"), F.lit(""))
    quantile = F.percentile_approx("perplexity", QUANTILE, 100000) * MARGIN
    outside = scored.join(good, "doc_id", "left_semi").filter(F.col("perplexity").isNotNull())
    limits = saved(outside.groupBy(k.alias("k")).agg(quantile.alias("limit")), "limits")
    # a language may have most rows: its limit goes to them
    limits = F.broadcast(limits) if limits.count() <= LANGUAGES_AT_ONCE else limits
    every = outside.agg(quantile).first()[0]
    out = scored.withColumn("k", k).join(limits, "k", "left")
    most = F.coalesce("limit", F.lit(every if every is not None else float("inf")))
    return out.select("doc_id", F.col("language").alias("lang"), "n_tokens", "log10_prob", "perplexity", most.alias("max_perplexity"), F.coalesce(F.col("perplexity") <= most, F.lit(False)).alias("kept"))


def query(spark, sf_dir):
    """op8_quality_classifier: perplexity and verdict of every document."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return classify(read("documents"), read("labels"))
