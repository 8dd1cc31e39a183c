"""Host-level quality rules.

Every document is measured by a few rules.  Failures are summed by host (the
``source`` column by default, or any column, such as ``url_host`` of an address;
null is a host of its own), the host's failure rate is shrunk towards the mean
of all hosts with a beta prior that is fitted to them by moments, and the host's
verdict is joined back to its documents: documents of a ``strict`` host must keep
to tighter limits.  A host is strict when its posterior leaves no doubt that its
rate is beyond ``STRICT_TIMES`` the rate of all documents: the posterior's mean
less ``CERTAIN`` of its standard deviations (the beta's, taken as normal) is.

Verdict of a document: rejected if it fails a base rule, or if one of its
measures is beyond the limit that its host's verdict selects.

Defined cases: null or empty text has no words and fails the base rule; a null
``source`` is one host; repeated rows are judged alike, each for itself; an
empty table gives an empty result; extra columns, whatever their names, are
carried through ``keep_good`` unchanged and ignored by ``measure``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import trimmed
from .shared import saved, tidy
from .textnum import U, mix, text_buffer, windows, words_by_run

#: Limits of a document's measures by its host's verdict.
LIMITS = {
    "normal": {"symbols_per_word": 0.1, "dup_line_share": 0.5, "upper_share": 0.5, "marks_per_word": 0.3, "max_word_chars": 12.0},
    "strict": {"symbols_per_word": 0.05, "dup_line_share": 0.3, "upper_share": 0.3, "marks_per_word": 0.15, "max_word_chars": 10.0},
}
#: A host is strict when its rate is beyond so many times the rate of all
#: documents, with so many standard deviations to spare (0.95 of a normal).
STRICT_TIMES, CERTAIN = 1.5, 1.645
#: Salts of the join with hosts: a host's rows go to so many places.
SALTS = 32

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_POINT = np.ones(256, np.int64)
_POINT[0x80:0xC0] = 0
_POINT[[9, 10, 11, 12, 13, 32]] = 0
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LETTER = _UPPER.copy()
_LETTER[97:123] = 1
_MARK = np.zeros(256, np.int64)
_MARK[ord("!")] = _MARK[ord("?")] = 1

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks"]
_SPACES = b" \t\n\r\x0b\x0c"


def _repeated(grams: np.ndarray, n: int) -> int:
    """Words covered by windows of 5 that occur at least twice."""
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    s = grams[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(step, at, 1)
    np.add.at(step, at + 5, -1)
    return int((np.cumsum(step[:n]) > 0).sum())


def _dup_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line; lines with a word."""
    if b"\n" not in text:
        return 0, int(bool(text.strip(_SPACES)))
    lines = [x for x in text.split(b"\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines)), len(lines)


def measures_of(column) -> dict[str, np.ndarray]:
    """The measures of every text of an Arrow string column."""
    data, offsets = text_buffer(column)
    n = len(offsets) - 1
    out = {k: np.zeros(n, np.int64) for k in MEASURES}
    for a, b, w in words_by_run(column, lower=False):
        grams = windows(w.hashes, 5)
        count = np.diff(w.first)
        out["n_words"][a:b] = count
        for name, table in (("word_chars", _POINT), ("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_letters", _LETTER), ("n_marks", _MARK)):
            total = np.concatenate([[0], np.cumsum(table[w.data])])
            out[name][a:b] = np.diff(total[w.offsets])
        raw = w.data.tobytes()
        for d in range(b - a):
            out["n_dup_lines"][a + d], out["n_lines"][a + d] = _dup_lines(raw[w.offsets[d] : w.offsets[d + 1]])
            if count[d] >= 6:
                out["n_repeat_words"][a + d] = _repeated(grams[w.first[d] : w.first[d + 1] - 4], int(count[d]))
    return out


@trimmed
def _measure(batches):
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        found = measures_of(text)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(found[k]) for k in MEASURES)], [*batch.schema.names[:-1], *MEASURES])


def measured(df: DataFrame, text: str) -> DataFrame:
    """Columns of ``df`` but ``text``, then the measures of ``text``."""
    df = df.select(*[c for c in df.columns if c != text], text)
    return df.mapInArrow(_measure, T.StructType([*df.schema.fields[:-1], *(T.StructField(k, T.LongType()) for k in MEASURES)]))


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def over(verdict: str):
    """Whether a document's measures are beyond the limits of a host with that verdict."""
    x = LIMITS[verdict]
    n = F.greatest(F.col("n_words"), F.lit(1))
    return (
        (F.col("n_symbols") > x["symbols_per_word"] * n)
        | (F.col("n_dup_lines") > x["dup_line_share"] * F.greatest(F.col("n_lines"), F.lit(1)))
        | (F.col("n_upper") > x["upper_share"] * F.greatest(F.col("n_letters"), F.lit(1)))
        | (F.col("n_marks") > x["marks_per_word"] * n)
        | (F.col("word_chars") > x["max_word_chars"] * n)
    )


def host_rates(stats: DataFrame) -> DataFrame:
    """host, n_docs, n_failed, prior_a, prior_b, rate (shrunk), verdict.

    ``stats``: one row per document with ``host`` and ``failed``.  The beta
    prior has the mean m of the hosts' rates and the strength that explains
    their variance beyond sampling: s = m(1-m)/v - 1, from 1 to 1e6.
    """
    hosts = saved(stats.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")), "hosts")
    raw = F.col("n_failed") / F.col("n_docs")
    # four numbers, whatever the number of hosts
    m, v, inv, pooled = hosts.agg(F.avg(raw), F.var_pop(raw), F.avg(1.0 / F.col("n_docs")), F.sum("n_failed") / F.sum("n_docs")).first()
    prior_a, prior_b = beta_prior(m or 0.0, v or 0.0, inv or 0.0)
    rate = (F.col("n_failed") + F.lit(prior_a)) / (F.col("n_docs") + F.lit(prior_a + prior_b))
    surely = F.col("rate") - CERTAIN * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n_docs") + F.lit(prior_a + prior_b + 1)))
    return hosts.withColumns({"prior_a": F.lit(prior_a), "prior_b": F.lit(prior_b), "rate": rate}).withColumn("verdict", F.when(surely > F.lit(STRICT_TIMES * (pooled or 0.0)), "strict").otherwise("normal"))


def beta_prior(m: float, v: float, inv: float) -> tuple[float, float]:
    """Moments of the hosts' raw rates (mean, variance, mean of 1 / documents) to a beta prior."""
    spread = m * (1 - m)
    between = v - spread * inv
    strength = 1e6 if between * 1e6 <= spread else max(spread / between - 1, 1.0)
    return m * strength, (1 - m) * strength


def _with_verdict(rows: DataFrame, hosts: DataFrame, key: str) -> DataFrame:
    """Join ``rows.host`` with the hosts' verdicts; each host is spread over
    SALTS places, so that a host with a third of all rows is no hot key."""
    salted = hosts.select("host", "rate", "verdict").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")


def url_host(url):
    """The host of an address; null if there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def _host(host):
    return F.coalesce(F.concat(F.lit("="), F.col("source") if host is None else host), F.lit(""))


@tidy
def judge(docs: DataFrame, host=None) -> DataFrame:
    """doc_id, the measures, base_failed, host, host_rate, host_verdict, kept for
    every row of ``docs`` (doc_id, text, and source, or what the column ``host`` reads)."""
    rows = docs.select(F.col("doc_id"), _host(host).alias("host"), F.col("text"))
    stats = saved(measured(rows, "text"), "quality").withColumn("base_failed", base_failed())
    hosts = host_rates(stats.select("host", (F.col("base_failed") | over("normal")).alias("failed")))
    out = _with_verdict(stats, hosts, "doc_id")
    beyond = F.when(F.col("verdict") == "strict", over("strict")).otherwise(over("normal"))
    return out.withColumn("kept", ~F.col("base_failed") & ~beyond).withColumnRenamed("rate", "host_rate").withColumnRenamed("verdict", "host_verdict")


@tidy
def keep_good(docs: DataFrame, host=None) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``.

    Two passes over the texts: the first measures narrow rows for the hosts'
    rates, the second carries each row with its measures to its host's verdict.
    """
    host = _host(host)
    narrow = measured(docs.select(host.alias("host"), F.col("text")), "text")
    hosts = host_rates(narrow.select("host", (base_failed() | over("normal")).alias("failed")))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), host.alias("host"), F.xxhash64(F.col("doc_id")).alias("k"), F.col("text").alias("measured_text"))
    rows = measured(packed, "measured_text").filter(~base_failed() & ~over("normal"))
    # kept by every host's limits: no need to wait for the verdict
    out = _with_verdict(rows, hosts.filter(F.col("verdict") == "strict"), "k")
    return out.filter(F.col("verdict").isNull() | ~over("strict")).select("row.*")


def query(spark, sf_dir):
    """op1_quality_rules: see the contract; measures, base verdict and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 9).alias("host_rate"), "host_verdict"
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM twice, (SELECT unnest(generate_series(0, 4)) AS k) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, source, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, len(ln) AS n_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
    length(regexp_replace(text, '[^!?]', '', 'g')) AS n_marks
  FROM d LEFT JOIN rep USING (doc_id)
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_symbols > 0.1::DOUBLE * greatest(n_words, 1) OR n_dup_lines > 0.5::DOUBLE * greatest(n_lines, 1)
      OR n_upper > 0.5::DOUBLE * greatest(n_letters, 1) OR n_marks > 0.3::DOUBLE * greatest(n_words, 1)
      OR word_chars > 12.0::DOUBLE * greatest(n_words, 1) AS over_normal,
    n_symbols > 0.05::DOUBLE * greatest(n_words, 1) OR n_dup_lines > 0.3::DOUBLE * greatest(n_lines, 1)
      OR n_upper > 0.3::DOUBLE * greatest(n_letters, 1) OR n_marks > 0.15::DOUBLE * greatest(n_words, 1)
      OR word_chars > 10.0::DOUBLE * greatest(n_words, 1) AS over_strict
  FROM m
), h AS (
  SELECT source, count(*) AS n, sum((base_failed OR over_normal)::INT)::DOUBLE AS k FROM f GROUP BY source
), p AS (
  SELECT avg(k / n) AS m, var_pop(k / n) - avg(k / n) * (1 - avg(k / n)) * avg(1.0::DOUBLE / n) AS v FROM h
), q AS (
  SELECT m, CASE WHEN v * 1e6 <= m * (1 - m) THEN 1e6 ELSE greatest(m * (1 - m) / v - 1, 1.0) END AS s FROM p
), r AS (
  SELECT source, rate, rate - 1.645::DOUBLE * sqrt(rate * (1 - rate) / (n + s + 1)) > 1.5::DOUBLE * pooled AS strict
  FROM (SELECT source, n, s, (k + m * s) / (n + s) AS rate, pooled FROM h, q, (SELECT sum(k) / sum(n) AS pooled FROM h))
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (CASE WHEN strict THEN over_strict ELSE over_normal END) AS kept,
  round(rate, 9) AS host_rate, CASE WHEN strict THEN 'strict' ELSE 'normal' END AS host_verdict
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""
