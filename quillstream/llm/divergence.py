"""Source divergence audit: how far the word use of a language's sources lies apart.

Terms are counted where the texts are read; a language keeps the terms of at least
``MIN_DOCS`` of its documents.  Every source, and every language, gives each kept term
a smoothed share, a whole number of billionths.  For two sources the sum over all kept
terms of the difference of shares depends on nothing but which pairs of counts occur
how often, so each pair of sources gets a joint histogram: in tasks that hold a
bounded block of the terms and two bounded blocks of the sources, the distinct
(count, count) combinations are tallied, with a zero where a source lacks the term.
The histograms of the term blocks are added up, terms that neither source has are what
is left of the vocabulary, and the difference is evaluated once for each combination
and multiplied by how often it occurs.

The result of part ``pair`` has a row for each ordered pair of a language's sources
and so grows with the square of their number, as asked; nothing else does in documents.
All arithmetic is of whole numbers, in decimals where a product may exceed a long.

Defined cases: a null text, lang or source is the empty one; a source without terms, or
without kept ones, is a source with count 0 everywhere; where a language keeps no term
its pairs have value 0; texts of any length are counted whole; repeated rows are
documents of their own; equal values are ranked by the item's UTF-8 bytes; an empty
table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved, spread, tidy

#: Documents of its language that a kept term occurs in, at least; terms that are listed for a source.
MIN_DOCS, LISTED = 30, 50
#: Added to every count; shares are billionths.
PLUS, UNITS = 5, 1_000_000_000
#: Entries of a task's counters; beyond, they are passed on and begin anew.
ENTRIES = 400_000
#: Terms and sources in a block of the tally, about.
TERM_BLOCK, SOURCE_BLOCK = 4096, 48

_LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B))
#: Bytes of a text to those of its terms: A-Z in lower case, what is in no term a space.
_TO_TERMS = bytes((b + 32 if b < 0x5B else b) if b in _LETTERS or b >= 0x80 else 0x20 for b in range(256))

_COUNTS = "lang string, source string, term string, count long, docs long"


def _count(batches):
    """(text, lang, source) to _COUNTS, added up within the task.

    A term is a run of bytes that are ASCII letters or part of a longer character."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    entries = 0

    def passed_on():
        for (lang, source), (count, docs) in held.items():
            terms = list(count)
            for at in range(0, len(terms), 50_000):
                some = terms[at : at + 50_000]
                names = [pa.array([v] * len(some), pa.string()) for v in (lang, source)]
                numbers = [pa.array(list(map(c.__getitem__, some)), pa.int64()) for c in (count, docs)]
                yield pa.RecordBatch.from_arrays([*names, pa.array(some, pa.binary()).cast(pa.string()), *numbers], ["lang", "source", "term", "count", "docs"])

    for batch in batches:
        for text, lang, source in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            terms = (text.as_py() or b"").translate(_TO_TERMS).split()
            count, docs = held.setdefault((lang or "", source or ""), (Counter(), Counter()))
            before = len(count)
            count.update(terms)
            docs.update(set(terms))
            entries += len(count) - before
            if entries >= ENTRIES:
                yield from passed_on()
                held.clear()
                entries = 0
    yield from passed_on()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, lang_count, first: the kept terms of each source
    (``first`` marks one row of each term of a language)."""
    raw = spread(docs.select("text", "lang", "source")).mapInArrow(_count, _COUNTS)
    # by language and term at once: what follows needs no other exchange
    counts = raw.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    known = counts.withColumns({"in_docs": F.sum("docs").over(term), "lang_count": F.sum("count").over(term), "first": (F.row_number().over(term.orderBy("source")) == 1).cast("long")})
    return known.filter(F.col("in_docs") >= MIN_DOCS).select("lang", "source", "term", "count", "lang_count", "first")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNITS * (count + PLUS) / (total + PLUS * kept)), exactly; null where nothing is kept."""
    whole = lambda c: c.cast("decimal(20,0)")
    over, under = F.lit(UNITS).cast("decimal(10,0)") * (whole(count) + PLUS), F.nullif(whole(total) + whole(kept) * PLUS, F.lit(0).cast("decimal(20,0)"))
    return F.call_function("div", over, under) + 1


_TALLY = "lang string, source_1 string, source_2 string, n_1 long, n_2 long, kept long, count_1 long, count_2 long, terms long"


def _tally(table: pa.Table) -> pa.Table:
    """Joint histograms of the pairs of two source blocks over a block of terms."""
    names, of_source = np.unique(table.column("source").to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
    term = table.column("term").combine_chunks().dictionary_encode()
    real = term.is_valid().to_numpy(zero_copy_only=False)
    counts = np.zeros((len(names), len(term.dictionary)), np.int64)
    counts[of_source[real], term.indices.filter(pa.array(real)).to_numpy(zero_copy_only=False)] = table.column("count").to_numpy()[real]
    n, block = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    n[of_source], block[of_source] = table.column("n").to_numpy(), table.column("block").to_numpy()
    x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
    values = [np.unique(row, return_inverse=True) for row in counts]
    pairs, tallied = [], []
    for i in range(len(names)):
        for j in range(i + 1, len(names)) if x == y else np.flatnonzero(block == y) if block[i] == x else ():
            (vi, ci), (vj, cj) = values[i], values[j]
            code, times = np.unique(ci.astype(np.int64) * max(len(vj), 1) + cj, return_counts=True)
            a, b = vi[code // max(len(vj), 1)], vj[code % max(len(vj), 1)]
            seen = (a > 0) | (b > 0)
            # a pair without any count still has its row
            pairs.append((i, j, int(seen.sum()) + 1))
            tallied.append(np.stack([np.append(a[seen], 0), np.append(b[seen], 0), np.append(times[seen], 0)]))
    i, j, rows = np.array(pairs, np.int64).reshape(-1, 3).T
    i, j = np.repeat(i, rows), np.repeat(j, rows)
    a, b, times = np.concatenate(tallied, axis=1) if tallied else np.zeros((3, 0), np.int64)
    same = lambda c, kind: pa.array([table.column(c)[0].as_py()] * len(i), kind)
    cols = [same("lang", pa.string()), pa.array(names[i], pa.string()), pa.array(names[j], pa.string()), pa.array(n[i]), pa.array(n[j]), same("kept", pa.int64()), pa.array(a), pa.array(b), pa.array(times)]
    return pa.table(cols, [c.split()[0] for c in _TALLY.split(", ")])


def joint_histograms(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """_TALLY: for each pair of a language's sources the distinct combinations of
    counts and how many terms have them, but for terms that neither has.

    ``sizes`` has a row for each source (lang, source, n, kept, sources)."""
    blocks = {
        "block": F.pmod(F.xxhash64(F.lit(11), "source"), F.ceil(F.col("sources") / SOURCE_BLOCK)),
        "other": F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("sources") / SOURCE_BLOCK) - 1)),
        "term_blocks": F.greatest(F.ceil(F.col("kept") / TERM_BLOCK), F.lit(1).cast("long")),
    }
    placed = sizes
    for name, column in blocks.items():
        placed = placed.withColumn(name, column)
    placed = placed.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).select("lang", "source", "n", "kept", "block", "x", "y", "term_blocks")
    cells = kept.select("lang", "source", "term", "count").join(placed, ["lang", "source"]).withColumn("part", F.pmod(F.xxhash64("term"), "term_blocks"))
    # every task knows all sources of its blocks, also those without any of its terms
    there = placed.withColumns({"term": F.lit(None).cast("string"), "count": F.lit(0).cast("long"), "part": F.explode(F.sequence(F.lit(0).cast("long"), F.col("term_blocks") - 1))})
    rows = cells.select(*(c := ["lang", "source", "term", "count", "n", "kept", "block", "x", "y", "part"])).unionByName(there.select(*c))
    tallied = rows.groupBy("lang", "x", "y", "part").applyInArrow(_tally, _TALLY)
    key = [c.split()[0] for c in _TALLY.split(", ")][:-1]
    return tallied.groupBy(*key).agg(F.sum("terms").alias("terms"))


@tidy
def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: see the contract of op11."""
    kept = saved(term_counts(docs), "kept-terms")
    names = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    langs = kept.groupBy("lang").agg(F.sum("first").alias("kept"), F.sum("count").alias("total"))
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    known = names.join(own, ["lang", "source"], "left").join(langs, "lang", "left").join(names.groupBy("lang").agg(F.count("*").alias("sources")), "lang")
    sizes = saved(known.select("lang", "source", zero("n"), zero("kept"), zero("total"), "sources"), "sources")

    # a source's own terms
    rows = kept.join(sizes.drop("sources"), ["lang", "source"])
    rows = rows.withColumns({"p": share(F.col("count"), F.col("n"), F.col("kept")), "q": share(F.col("lang_count"), F.col("total"), F.col("kept"))}).filter("count > 0 AND p > q")
    terms = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    # pairs of sources
    f = lambda a, b: F.abs(share(a, F.col("n_1"), F.col("kept")) - share(b, F.col("n_2"), F.col("kept")))
    joint = joint_histograms(kept, sizes).withColumn("value", f(F.col("count_1"), F.col("count_2")) * F.col("terms"))
    sums = joint.groupBy("lang", "source_1", "source_2", "n_1", "n_2", "kept").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    nothing = F.lit(0).cast("long")
    value = F.coalesce(F.col("value") + (F.col("kept") - F.col("terms")) * f(nothing, nothing), nothing)
    both = F.array(F.struct(F.col("source_1").alias("source"), F.col("source_2").alias("item")), F.struct(F.col("source_2").alias("source"), F.col("source_1").alias("item")))
    pairs = sums.select("lang", value.alias("value"), F.explode(both).alias("e")).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).filter(F.col("rank") <= LISTED))


def query(spark, sf_dir):
    """op11_source_divergence: see the contract."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), w AS (
  SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), n AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM w GROUP BY ALL),
terms AS MATERIALIZED (SELECT lang, term, count(*) AS lc FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 30),
v AS (SELECT lang, count(*) AS v, sum(lc)::HUGEINT AS total FROM terms GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
cells AS (
  SELECT g.lang, g.source, terms.term, coalesce(c, 0) AS c, lc FROM g JOIN terms USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = terms.term
), shares AS MATERIALIZED (
  SELECT lang, source, term, c, (1 + 1000000000::HUGEINT * (c + 5) // (sum(c) OVER (PARTITION BY lang, source)::HUGEINT + 5 * v))::BIGINT AS p,
    (1 + 1000000000::HUGEINT * (lc + 5) // (total + 5 * v))::BIGINT AS q FROM cells JOIN v USING (lang)
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang AS l, x.source AS s, y.source AS t, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) ON l = a.lang AND s = a.source AND t = b.source
), listed AS (
  SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank
  FROM (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE c > 0 AND p > q)
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL SELECT lang, source, part, item, value, rank::INT FROM listed WHERE rank <= 50"""
