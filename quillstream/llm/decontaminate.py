"""Benchmark decontamination: BM25 search of test items by every training passage.

The test items are the indexed side: an inverted index of BM25 impacts, each
divided by its item's score for itself, so that a score is the matched share of
an item and one threshold fits all.  Passages are windows of twice the longest
item's words, half a window apart, over whole texts, so that a copied item lies
within one.

The index is built by Spark.  Document frequencies, the number of items, their
mean and longest length are taken over all items; items are dealt by hash into
shards of about ``SHARD_CHARS`` characters, and each shard's index is built, with
those numbers, in a task: scores do not depend on the shards.  Indexes are a
written table.  They are broadcast, ``PASS_BYTES`` of them at a time: more are
searched in further passes over the documents.

A shard's items stand in blocks of ``ITEMS_IN_BLOCK``, and a term keeps its largest
impact in each block.  Block-max WAND, for a megabyte of text at a time:

1. terms of many items count as if all were there: with the most that they add to
   any item of the block; the others' block maxima are summed by half window and
   block, in tiles of ``TILE`` cells; blocks whose bound reaches the threshold are
   the live blocks of a passage;
2. a passage with a live block sets a cursor on each of its terms' postings, which
   are in item order, and takes its live blocks in turn: the cursors in order of
   their items, the first at which the block maxima add up to the threshold is the
   pivot; cursors before it skip to it; an item that all of them have reached is
   scored exactly.  Every item above the threshold is retrieved;
3. retrieved items are verified: their question (all but the last sentence) and
   their answer (the last sentence) must each have half of their word triples
   in the passage.

Defined cases: null or empty texts have no passage and no hit; an item without a
word is no item; repeated items (same id and text) are one; an item with a null
``item_id`` is searched as any other and reported with a null id; a null
``doc_id`` is carried; repeated rows hit alike; an empty benchmark or table gives
no hits; extra columns are ignored by ``search`` and carried through by ``clean``.
"""

from __future__ import annotations

import functools
import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import trimmed
from .shared import join_hot, saved, tidy
from .textnum import PUNCTUATION, U, windows, words_by_run

K1, B = 1.2, 0.75
#: Share of an item's own BM25 score at which it is retrieved; share of triples that verifies.
THRESHOLD, OVERLAP = 0.5, 0.5
ITEMS_IN_BLOCK = 4
#: Terms of more than one in so many of a shard's items are non-essential.
ESSENTIAL = 8
#: Characters of items in a shard, about; bytes of indexes that are broadcast at a time.
SHARD_CHARS, PASS_BYTES = 1 << 20, 128 << 20
#: Keys of texts (16 bytes each) that are broadcast to leave their rows out.
KEYS_AT_ONCE = 1_000_000
#: Cells of a tile of bounds.
TILE = 4 << 20
_SLACK = 1e-9


def _words(texts: list[str]) -> list[np.ndarray]:
    out = []
    for a, b, w in words_by_run(pa.array(texts, pa.string()), lower=True, between=PUNCTUATION):
        out += [w.hashes[w.first[d] : w.first[d + 1]] for d in range(b - a)]
    return out


def triples(words: np.ndarray) -> np.ndarray:
    """Distinct hashes of three words in a row; of all of them where there are fewer."""
    return np.unique(windows(words, min(3, len(words)))) if len(words) else np.zeros(0, U)


def question_answer(text: str) -> tuple[str, str]:
    """All but the last sentence, and the last; the whole text twice where there is one."""
    cut = [m.end() for m in re.finditer(r"[.?!]\s+|\n+", text.strip())]
    return (text.strip()[: cut[-1]], text.strip()[cut[-1] :]) if cut else (text, text)


class Index:
    """Impacts of a shard's items, by term in item order, and by block of items.

    ``df`` gives the number of all items that have a term; ``n``, ``mean`` and
    ``longest`` are of all items as well."""

    def __init__(self, items: list[tuple[int | None, str]], n: int, mean: float, longest: int, df: dict[int, int]):
        words = _words([t for _, t in items])
        keep = [k for k, w in enumerate(words) if len(w)]
        self.ids = [items[k][0] for k in keep]
        words = [words[k] for k in keep]
        parts = [question_answer(items[k][1]) for k in keep]
        self.questions = [triples(w) for w in _words([q for q, _ in parts])]
        self.answers = [triples(w) for w in _words([a for _, a in parts])]
        self.longest, m = longest, len(words)
        item = np.repeat(np.arange(m), [len(w) for w in words])
        pairs, tf = np.unique(np.stack([np.concatenate([*words, np.zeros(0, U)]), item.astype(U)]), axis=1, return_counts=True)
        # postings by term, in item order
        self.terms, term = np.unique(pairs[0], return_inverse=True)
        item = pairs[1].astype(np.int64)
        counts = np.array([df[int(t)] for t in self.terms.view(np.int64)], float)
        idf = np.log1p((n - counts + 0.5) / (counts + 0.5))
        size = np.array([len(w) for w in words], float)
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / mean)) if m else np.zeros(0)
        impact = impact / np.bincount(item, impact, m)[item] if m else impact
        self.items, self.impact = item, impact
        self.width = max(m, 1)
        self.places = term * self.width + item
        self.ends = np.searchsorted(term, np.arange(len(self.terms)), side="right")
        # block maxima by term
        self.blocks = max(-(-m // ITEMS_IN_BLOCK), 1)
        key = term * self.blocks + item // ITEMS_IN_BLOCK
        self.block_keys, place = np.unique(key, return_inverse=True)
        self.block_max = np.zeros(len(self.block_keys))
        np.maximum.at(self.block_max, place, impact)
        self.block_of = self.block_keys % self.blocks
        self.first = np.searchsorted(self.block_keys // self.blocks, np.arange(len(self.terms) + 1))
        # what the non-essential terms can add to an item, at most in each block: below the threshold
        most = max(m, ESSENTIAL) // ESSENTIAL
        here = np.bincount(term, minlength=len(self.terms))
        while True:
            self.essential = here <= most
            rest = np.bincount(item, np.where(self.essential[term], 0.0, impact), m) if m else np.zeros(1)
            self.rest = np.maximum.reduceat(rest, np.arange(0, max(m, 1), ITEMS_IN_BLOCK))
            if self.rest.max() < THRESHOLD / 2:
                break
            most *= 2
        # a table of the low bits of terms tells most other words apart at once
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.terms & U(0xFFFF)).astype(np.int64)] = True

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the terms, -1 for other words."""
        out = np.full(len(hashes), -1, np.int64)
        likely = np.flatnonzero(self.maybe[(hashes & U(0xFFFF)).astype(np.int64)])
        if len(likely):
            at = np.minimum(np.searchsorted(self.terms, hashes[likely]), len(self.terms) - 1)
            hit = self.terms[at] == hashes[likely]
            out[likely[hit]] = at[hit]
        return out

    def _block_maxima(self, terms: np.ndarray, block: int) -> np.ndarray:
        key = terms * self.blocks + block
        at = np.minimum(np.searchsorted(self.block_keys, key), len(self.block_keys) - 1)
        return np.where(self.block_keys[at] == key, self.block_max[at], 0.0)

    def retrieve(self, terms: np.ndarray, live: np.ndarray):
        """(item, score) of the items of the live blocks that a passage's distinct
        terms bring to the threshold, by block-max WAND."""
        for block in live.tolist():
            most = self._block_maxima(terms, block)
            at_work = most > 0
            t, most = terms[at_work], most[at_work]
            beyond = min((block + 1) * ITEMS_IN_BLOCK, self.width)
            cursor = np.searchsorted(self.places, t * self.width + block * ITEMS_IN_BLOCK)
            stop = np.searchsorted(self.places, t * self.width + beyond)
            while True:
                there = np.where(cursor < stop, self.items[np.minimum(cursor, len(self.items) - 1)], beyond)
                order = np.argsort(there, kind="stable")
                pivot = int(np.searchsorted(np.cumsum(most[order]), THRESHOLD - _SLACK))
                if pivot == len(order) or there[order[pivot]] >= beyond:
                    break
                item = int(there[order[pivot]])
                if there[order[0]] < item:
                    behind = there < item
                    cursor[behind] = np.searchsorted(self.places, t[behind] * self.width + item)
                    continue
                mine = there == item
                score = float(self.impact[cursor[mine]].sum())
                if score >= THRESHOLD:
                    yield item, score
                cursor[mine] += 1

    def _live(self, c: np.ndarray, t: np.ndarray, last: np.ndarray):
        """(half windows' numbers, bounds of the passages that begin there, by block)
        in tiles, from the distinct (half window, essential term) pairs in order."""
        rows = max(TILE // self.blocks, 2)
        n = len(last)
        for lo in range(0, n, rows - 1):
            hi = min(lo + rows, n)
            a, b = np.searchsorted(c, (lo, hi))
            size = self.first[t[a:b] + 1] - self.first[t[a:b]]
            place = np.repeat(self.first[t[a:b]] - np.cumsum(size) + size, size) + np.arange(size.sum())
            cell = np.repeat(c[a:b] - lo, size) * self.blocks + self.block_of[place]
            sums = np.bincount(cell, self.block_max[place], (hi - lo) * self.blocks).reshape(hi - lo, self.blocks)
            # the last row only completes the one before it, if there are more
            m = hi - lo if hi == n else hi - lo - 1
            bound = sums[:m] + self.rest
            follows = np.flatnonzero(~last[lo : lo + m])
            bound[follows] += sums[follows + 1]
            yield lo, bound
            if hi == n:
                return

    def hits(self, column):
        """(row, item, passage, score, question and answer overlap), the best passage of each row and item."""
        if not self.ids:
            return
        half = self.longest
        for a, b, w in words_by_run(column, lower=True, between=PUNCTUATION):
            if not len(w.hashes):
                continue
            n_words = np.diff(w.first)
            halves = -(-n_words // half)
            base = np.concatenate([[0], np.cumsum(halves)])
            row = np.repeat(np.arange(b - a), n_words)
            half_of = base[row] + (np.arange(len(w.hashes)) - w.first[row]) // half
            term = self.look_up(w.hashes)
            last = np.zeros(int(base[-1]), bool)
            last[base[1:][halves > 0] - 1] = True
            at = np.flatnonzero(term >= 0)
            at = at[self.essential[term[at]]]
            # a term twice in a half counts once: bounds of repeated text would be far too high
            u = np.unique(half_of[at] * len(self.terms) + term[at])
            best: dict[tuple[int, int], tuple] = {}
            for lo, bound in self._live(u // len(self.terms), u % len(self.terms), last):
                live = bound >= THRESHOLD - _SLACK
                for k in np.flatnonzero(live.any(axis=1)) + lo:
                    d = int(np.searchsorted(base, k, side="right")) - 1
                    begin = w.first[d] + (k - base[d]) * half
                    end = min(begin + 2 * half, w.first[d + 1])
                    terms = np.unique(term[begin:end])
                    found = None
                    for i, score in self.retrieve(terms[terms >= 0], np.flatnonzero(live[k - lo])):
                        if best.get((d, i), (0,))[0] >= score - _SLACK:
                            continue
                        if found is None:
                            found = {m: np.unique(windows(w.hashes[begin:end], m)) for m in (1, 2, 3) if end - begin >= m}
                        q, x = (self._share(part, found) for part in (self.questions[i], self.answers[i]))
                        if q >= OVERLAP and x >= OVERLAP:
                            best[d, i] = (score, int(k - base[d]), q, x)
            for (d, i), (score, passage, q, x) in sorted(best.items()):
                yield a + d, self.ids[i], passage, score, q, x

    @staticmethod
    def _share(part: np.ndarray, found: dict[int, np.ndarray]) -> float:
        """Share of an item part's n-grams in the passage, whatever n they have."""
        if not len(part):
            return 1.0
        return max(float(np.isin(part, grams).mean()) for grams in found.values())


TERMS = "shard int, term bigint, words bigint"


@trimmed
def _terms(batches):
    """For each item (shard, text) its number of words, and its distinct terms."""
    for batch in batches:
        shard = batch.column(0).to_pylist()
        for k, w in zip(shard, _words(batch.column(1).to_pylist())):
            terms = np.unique(w).view(np.int64)
            n = len(terms) + 1
            cols = [pa.array([k] * n, pa.int32()), pa.array([None, *terms.tolist()], pa.int64()), pa.array([len(w)] + [None] * (n - 1), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["shard", "term", "words"])


@tidy
def build(items: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """shard, size, data: the indexes of ``items`` (item_id, text), as a written table."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL").distinct()
    shards = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // shard_chars))
    items = saved(items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int")), "items")
    rows = saved(items.select("shard", "text").mapInArrow(_terms, TERMS), "item-terms")
    # three numbers, whatever the number of items
    n, mean, longest = rows.filter("words > 0").agg(F.count("*"), F.avg("words"), F.max("words")).first()
    terms = rows.filter("term IS NOT NULL")
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    df = terms.select("shard", "term").distinct().join(df, "term")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if right.num_rows:
            left = left.sort_by([("item_id", "ascending"), ("text", "ascending")])
            items = list(zip(left.column("item_id").to_pylist(), left.column("text").to_pylist()))
            index = Index(items, n, mean, longest, dict(zip(right.column("term").to_pylist(), right.column("df").to_pylist())))
            out = [(left.column("shard")[0].as_py(), pickle.dumps(index, protocol=5))]
        return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.array([len(x[1]) for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["shard", "size", "data"])

    return saved(items.groupBy("shard").cogroup(df.groupBy("shard")).applyInArrow(run, "shard int, size bigint, data binary"), "item-index")


def passes(index: DataFrame, pass_bytes: int = PASS_BYTES):
    """Broadcasts of lists of indexes, of so many bytes each; one is held at a time."""
    spark = index.sparkSession
    held, size = [], 0
    sizes = sorted(tuple(r) for r in index.select("shard", "size").collect())
    for k, (shard, n) in enumerate(sizes):
        held.append(shard)
        size += n
        if size >= pass_bytes or k == len(sizes) - 1:
            blobs = [bytes(r["data"]) for r in index.filter(F.col("shard").isin(held)).orderBy("shard").collect()]
            yield spark.sparkContext.broadcast([pickle.loads(x) for x in blobs]), k == len(sizes) - 1
            held, size = [], 0


HITS = "doc_id bigint, item_id bigint, passage bigint, score double, question_overlap double, answer_overlap double"


@tidy
def search(docs: DataFrame, items: DataFrame, shard_chars: int = SHARD_CHARS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """HITS: a row for every document and the items that it contains, with the
    best passage; ``docs`` (doc_id, text), ``items`` (item_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], HITS)
    for shared, last in passes(build(items, shard_chars), pass_bytes):

        @trimmed
        def run(batches, shared=shared):
            for batch in batches:
                found = [x for index in shared.value for x in index.hits(batch.column(1))]
                cols = [list(x) for x in zip(*found)] or [[] for _ in range(6)]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(x, k) for x, k in zip(cols[1:], kinds))], [x.split()[0] for x in HITS.split(", ")])

        part = rows.mapInArrow(run, HITS)
        out = part if last and out.isEmpty() else out.unionByName(part if last else saved(part, "hits"))
        if not last:
            shared.unpersist()
    return out


@tidy
def clean(docs: DataFrame, items: DataFrame, shard_chars: int = SHARD_CHARS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of ``docs`` that contain no test item, with the columns of ``docs``.

    Every pass but the last writes 128-bit keys of the texts that it finds; the last
    leaves their rows out and carries the others on, once."""
    key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), F.col("text")).alias("b"))
    found = []
    for shared, last in passes(build(items, shard_chars), pass_bytes):

        @trimmed
        def run(batches, shared=shared, keep_hits=not last):
            for batch in batches:
                hit = np.zeros(batch.num_rows, bool)
                for index in shared.value:
                    hit[[x[0] for x in index.hits(batch.column(1))]] = True
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit if keep_hits else ~hit))], [batch.schema.names[0]])

        if not last:
            texts = docs.select(key.alias("text_key"), "text")
            found.append(saved(texts.mapInArrow(run, T.StructType([texts.schema["text_key"]])).distinct(), "hit-keys"))
            shared.unpersist()
            continue
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("searched"), key.alias("text_key"))
        if found:
            keys = functools.reduce(DataFrame.unionByName, found).distinct()
            few = keys.count() <= KEYS_AT_ONCE
            rows = rows.join(F.broadcast(keys), "text_key", "left_anti") if few else join_hot(rows, keys, "text_key", "left_anti")
        out = rows.select("row", "searched").mapInArrow(run, T.StructType([T.StructField("row", rows.schema["row"].dataType)]))
        docs = out.select("row.*")
    return docs


def query(spark, sf_dir):
    """op6_benchmark_decontamination: documents that contain items of ``benchmark``."""
    found = search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "passage", F.round("score", 6).alias("score"), F.round("question_overlap", 6).alias("question_overlap"), F.round("answer_overlap", 6).alias("answer_overlap"))


_SPLIT = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def _grams(source: str, words: str, keys: str, n: str) -> str:
    return f"SELECT DISTINCT {keys}, array_to_string(list_slice({words}, i, i + n - 1), ' ') AS g, n FROM (SELECT *, unnest(generate_series(1, len({words}) - n + 1)) AS i FROM (SELECT *, {n} AS n FROM {source}) WHERE len({words}) >= n)"


ORACLE_SQL = rf"""
WITH items AS MATERIALIZED (
  SELECT item_id, t, CASE WHEN regexp_matches(t, '[.?!]\s+|\n+') THEN regexp_extract(t, '(?s)^(.*(?:[.?!]\s+|\n+))', 1) END AS q
  FROM (SELECT item_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM benchmark WHERE text IS NOT NULL)
), parts AS MATERIALIZED (
  SELECT item_id, {_SPLIT.format("t")} AS w, {_SPLIT.format("coalesce(q, t)")} AS qw, {_SPLIT.format("CASE WHEN q IS NULL THEN t ELSE substr(t, length(q) + 1) END")} AS aw FROM items
), tf AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(w) AS term FROM parts) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
size AS (SELECT count(*) AS n, avg(len(w)) AS mean, max(len(w)) AS half FROM parts WHERE len(w) > 0),
raw AS (
  SELECT item_id, term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * {K1 + 1}::DOUBLE / (tf + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * len(w) / mean)) AS x
  FROM tf JOIN df USING (term) JOIN parts USING (item_id), size
), impact AS MATERIALIZED (SELECT item_id, term, x / sum(x) OVER (PARTITION BY item_id) AS x FROM raw),
docs AS (SELECT doc_id, {_SPLIT.format("coalesce(text, '')")} AS w FROM documents),
passages AS MATERIALIZED (
  SELECT doc_id, k AS passage, list_slice(w, k * half + 1, k * half + 2 * half) AS pw
  FROM (SELECT doc_id, w, half, unnest(generate_series(0, (len(w) - 1) // half)) AS k FROM docs, size WHERE len(w) > 0)
), hits AS MATERIALIZED (
  SELECT doc_id, passage, item_id, sum(x) AS score FROM (SELECT DISTINCT doc_id, passage, unnest(pw) AS term FROM passages) JOIN impact USING (term)
  GROUP BY ALL HAVING sum(x) >= {THRESHOLD}
), there AS MATERIALIZED (SELECT DISTINCT doc_id, passage, pw FROM hits JOIN passages USING (doc_id, passage)),
pg AS MATERIALIZED ({" UNION ALL ".join(_grams("there", "pw", "doc_id, passage", str(n)) for n in (1, 2, 3))}),
qg AS ({_grams("parts", "qw", "item_id", "least(3, len(qw))")}),
ag AS ({_grams("parts", "aw", "item_id", "least(3, len(aw))")}),
shares AS (
  SELECT h.doc_id, h.passage, h.item_id, h.score,
    (SELECT count(pg.g)::DOUBLE / count(*) FROM qg LEFT JOIN pg ON pg.doc_id = h.doc_id AND pg.passage = h.passage AND pg.g = qg.g AND pg.n = qg.n WHERE qg.item_id = h.item_id AND qg.n > 0) AS q,
    (SELECT count(pg.g)::DOUBLE / count(*) FROM ag LEFT JOIN pg ON pg.doc_id = h.doc_id AND pg.passage = h.passage AND pg.g = ag.g AND pg.n = ag.n WHERE ag.item_id = h.item_id AND ag.n > 0) AS a
  FROM hits h
)
SELECT doc_id, item_id, passage, round(score, 6) AS score, round(q, 6) AS question_overlap, round(a, 6) AS answer_overlap
FROM shares WHERE q >= {OVERLAP} AND a >= {OVERLAP}
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY round(score, 9) DESC, passage) = 1
"""
