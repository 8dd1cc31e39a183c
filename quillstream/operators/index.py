"""Chunk store: row normaliser, BM25 statistics, vector table, written sinks."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import non_empty, strip, words
from ..store import current, saved

# The scoring library's defaults.
K1, B, EPSILON = 1.5, 0.75, 0.25
# End of fixed values.


def normalized_chunks(df: DataFrame) -> DataFrame:
    """chunk_id, text, page_number from rows of any of the shapes (text | page_content,
    page_number | page, id); blank texts go, ids are deterministic."""
    have = set(df.columns)
    pick = lambda *names: [F.col(c) for c in names if c in have]
    text = strip(non_empty(*pick("text", "page_content")))
    page = F.coalesce(*pick("page_number", "page"), F.lit(1)).cast("int")
    key = F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in ("session_id", "file_ord", "chunk_ord") if c in have], page.cast("string"), text), 256)
    ids = F.coalesce(*pick("id", "chunk_id"), key) if pick("id", "chunk_id") else key
    rest = [c for c in df.columns if c not in ("text", "page_content", "page_number", "page", "id", "chunk_id")]
    return df.select(*rest, ids.alias("chunk_id"), text.alias("text"), page.alias("page_number")).filter((F.col("text") != "") & F.col("text").isNotNull())


def with_session(rows: DataFrame) -> DataFrame:
    """``rows`` with session_id, the collection they belong to: the empty one where there is no such column."""
    return rows if "session_id" in rows.columns else rows.withColumn("session_id", F.lit(""))


#: Chunks in a block of postings; folders of terms by their hash; blocks that a writing task takes of a folder.
BLOCK, FOLDERS, BLOCKS_AT_ONCE = 2048, 64, 64
_ENTRIES = "session_id string, term string, block long, base long, gaps array<int>, tfs array<int>, dls array<int>, top_tf int, least_dl int"


#: Bytes of texts whose words a task holds at a time, or one text's.
BYTES_AT_ONCE = 4 << 20


def slices(batch: pa.RecordBatch, text: int):
    """Parts of a batch of at most about BYTES_AT_ONCE of its column ``text``, a row at least."""
    ends = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + BYTES_AT_ONCE, "right")))
        yield batch.slice(at, to - at)
        at = to


def tokens(lowered: pa.Array):
    """``functions.text.words`` of texts that ``lower`` was called on: the row of each word, the
    words as a dictionary array, and how many each row has."""
    text = pc.utf8_trim_whitespace(lowered.fill_null(""))
    filled = pc.binary_length(text).to_numpy(zero_copy_only=False) > 0
    listed = pc.utf8_split_whitespace(text.filter(pa.array(filled)))
    n = np.zeros(len(text), np.int64)
    n[filled] = listed.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(text)), n), listed.flatten().dictionary_encode(), n


def _entries(batches):
    """(session_id, chunk_ord, lowered text) to _ENTRIES, a row for each term of each block that a slice has chunks of.

    Slices end where the block changes or, where chunks come in no order, after BLOCK chunks."""
    for batch in (part for whole in batches for part in slices(whole, 2)):
        edges = np.flatnonzero(np.diff(batch.column(1).to_numpy() // BLOCK)) + 1
        if len(edges) > batch.num_rows // 64:
            edges = np.arange(BLOCK, batch.num_rows, BLOCK)
        for at, to in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            if to > at:
                yield _listed(batch.slice(at, to - at))


def _listed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """_ENTRIES of a slice.  The empty term, which no text has, lists all its chunks."""
    of_word, coded, dl = tokens(batch.column(2))
    session = batch.column(0).dictionary_encode()
    names = pa.concat_arrays([pa.array([""], pa.string()), coded.dictionary.cast(pa.string())])
    # one token of the empty term for each chunk
    row = np.concatenate([np.arange(len(dl)), of_word])
    term = np.concatenate([np.zeros(len(dl), np.int64), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1])
    pair, tf = np.unique(row * len(names) + term, return_counts=True)
    row, term = pair // len(names), pair % len(names)
    number, of = batch.column(1).to_numpy(), session.indices.to_numpy(zero_copy_only=False)[row]
    order = np.lexsort((number[row], number[row] // BLOCK, term, of))
    row, term, of, tf = row[order], term[order], of[order], tf[order].astype(np.int32)
    ords, length = number[row], dl[row].astype(np.int32)
    new = np.ones(len(row), bool)
    new[1:] = (of[1:] != of[:-1]) | (term[1:] != term[:-1]) | (ords[1:] // BLOCK != ords[:-1] // BLOCK)
    start = np.flatnonzero(new)
    ends = pa.array(np.append(start, len(row)), pa.int32())
    gaps = np.where(new, 0, np.diff(ords, prepend=ords[:1])).astype(np.int32)
    listed = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (gaps, tf, length)]
    return pa.RecordBatch.from_arrays(
        [session.dictionary.take(pa.array(of[start])), names.take(pa.array(term[start])), pa.array(ords[start] // BLOCK), pa.array(ords[start]), *listed, pa.array(np.maximum.reduceat(tf, start)), pa.array(np.minimum.reduceat(length, start))],
        [c.split()[0] for c in _ENTRIES.split(", ")],
    )


def folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def entries_of(chunks: DataFrame) -> DataFrame:
    """_ENTRIES and folder: for each term and block of chunks the chunks that have
    it, as gaps, with how often and how long they are, and bounds on both."""
    rows = with_session(chunks).select("session_id", F.col("chunk_ord").cast("long").alias("chunk_ord"), F.lower("text").alias("text"))
    return rows.mapInArrow(_entries, _ENTRIES).withColumn("folder", folder(F.col("term")))


def postings(chunks: DataFrame) -> DataFrame:
    """``entries_of`` dealt to folders and sorted."""
    # a frequent term's blocks are several tasks' work
    dealt = entries_of(chunks).repartition("folder", F.expr(f"block div {BLOCKS_AT_ONCE}"))
    return dealt.sortWithinPartitions("folder", "term", "session_id", "block")


def tallies(entries: DataFrame) -> DataFrame:
    """session_id, term, df, words: parts of the ``vocabulary``, to be summed."""
    total = F.aggregate("dls", F.lit(0).cast("long"), lambda a, x: a + x)
    listed = entries.select("session_id", "term", F.size("gaps").cast("long").alias("df"), F.lit(None).cast("long").alias("words"))
    # lengths are read in the empty term's folder alone
    every = entries.filter((F.col("folder") == folder(F.lit(""))) & (F.col("term") == ""))
    return listed.unionByName(every.select("session_id", "term", F.lit(0).cast("long").alias("df"), total.alias("words")))


def summed(parts: DataFrame) -> DataFrame:
    """The vocabulary of its parts."""
    return parts.groupBy("session_id", "term").agg(F.sum("df").alias("df"), F.sum("words").alias("words"))


def vocabulary(entries: DataFrame) -> DataFrame:
    """session_id, term, df, words: chunks that have the term; all chunks and all their words for the empty term."""
    return summed(tallies(entries))


def by_collection(batch: pa.RecordBatch):
    """(session, its rows) of a batch whose first column is the session."""
    session = batch.column(0).dictionary_encode()
    if len(session.dictionary) == 1 and not session.null_count:
        yield session.dictionary[0].as_py(), batch
        return
    for k, name in enumerate(session.dictionary.to_pylist()):
        yield name, batch.filter(pc.equal(session.indices, k))


def _counted(batches):
    """(session_id, lowered text) to parts of the vocabulary, a row for each term of a slice."""
    for batch in batches:
        for part in slices(batch, 1):
            for session, rows in by_collection(part):
                row, coded, n = tokens(rows.column(1))
                pairs = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(n) + row)
                df = np.bincount(pairs // len(n), minlength=len(coded.dictionary))
                names = pa.concat_arrays([pa.array([""], pa.string()), coded.dictionary.cast(pa.string())])
                total = pa.concat_arrays([pa.array([int(n.sum())], pa.int64()), pa.nulls(len(df), pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(session, pa.string()), len(names)), names, pa.array(np.append(len(n), df)), total], ["session_id", "term", "df", "words"])


def counted(chunks: DataFrame) -> DataFrame:
    """The ``vocabulary`` of chunks without their postings: words are counted where the texts are read."""
    rows = with_session(chunks).select("session_id", F.lower("text").alias("text"))
    return summed(rows.mapInArrow(_counted, "session_id string, term string, df long, words long"))


def _raw_idf(n: Column) -> Column:
    return F.log(n.cast("double") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def impact(idf, tf, dl, avgdl):
    """Of columns or of arrays; grows with tf and falls with dl where idf is positive."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


#: The term of chunks that are no longer there; no text has it, as it holds white space.
GONE = " gone"


class Index:
    """BM25 tables of chunks (chunk_ord, text, page_number, embedding and, where
    collections are several, session_id; chunk_ord tells all chunks apart).

    ``entries`` are the stored postings, in folders by the term's hash and sorted by
    term: a question reads the folders and blocks of its words.  Statistics are each
    session's own: ``sizes`` (session_id, n, words, avgdl, mean_raw) and ``terms``
    (session_id, term, df, idf).  ``entries`` and ``counted`` given from elsewhere (a
    stored collection) are used as they are.  ``texts``: the chunks without their vectors,
    where those are joined from another table that texts needn't be moved for.

    What is made is made when it is first asked for: sessions that a task can hold are
    searched and counted without postings (``by_session``); ``rest`` indexes the others.
    Statistics alone need no postings either, and few questions are asked of the texts
    (``retrieval.keyword_ranks``): postings of every word are for many questions."""

    def __init__(self, chunks: DataFrame, entries: DataFrame | None = None, counted: DataFrame | None = None, texts: DataFrame | None = None, whole: bool = False):
        self.by_session = "session_id" in chunks.columns and not whole
        self.chunks = with_session(chunks)
        self.texts = self.chunks if texts is None else with_session(texts)
        self.stored = entries is not None
        # what is made later, in another call, lives as long as what is made here
        made_in = current()
        self._scope = [] if made_in is None else made_in
        self._given = entries, counted

    def _saved(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        return saved(df, name, by, self._scope)

    @cached_property
    def entries(self) -> DataFrame:
        return self._saved(postings(self.texts), "postings", "folder") if self._given[0] is None else self._given[0]

    @property
    def listed(self) -> bool:
        """Whether the postings are there already."""
        return self.stored or "entries" in self.__dict__

    @cached_property
    def _known(self) -> tuple[DataFrame, DataFrame]:
        counts = self._given[1]
        if counts is None:
            counts = self._saved(vocabulary(self.entries) if self.listed else counted(self.texts), "vocabulary")
        sizes = counts.filter("term = ''").select("session_id", F.col("df").alias("n"), "words", (F.col("words") / F.col("df")).alias("avgdl"))
        known = counts.filter("term <> ''").select("session_id", "term", "df").join(sizes.select("session_id", "n"), "session_id").withColumn("raw", _raw_idf(F.col("n")))
        means = known.groupBy("session_id").agg(F.avg("raw").alias("mean_raw"))
        return known, self._saved(sizes.join(means, "session_id", "left"), "sizes")

    @property
    def sizes(self) -> DataFrame:
        return self._known[1]

    @cached_property
    def counted_terms(self) -> DataFrame:
        """``terms`` from the vocabulary."""
        known, sizes = self._known
        # a negative idf becomes EPSILON times the mean of all raw ones
        idf = F.when(F.col("raw") < 0, F.col("mean_raw") * EPSILON).otherwise(F.col("raw"))
        return known.join(sizes.select("session_id", "mean_raw"), "session_id").select("session_id", "term", "df", idf.alias("idf"))

    @cached_property
    def large(self) -> DataFrame | None:
        """session_id of the sessions that no task is to hold; None if there is none."""
        from .by_session import large_sessions

        large = self._saved(large_sessions(self.texts), "large")
        return None if large.isEmpty() else large

    @cached_property
    def rest(self) -> Index:
        """The index of the sessions that no task is to hold."""
        if self.stored:
            return self
        keep = lambda rows: rows.join(F.broadcast(self.large), "session_id", "left_semi")
        out = Index(keep(self.chunks), texts=keep(self.texts), whole=True)
        out._scope = self._scope
        return out

    @cached_property
    def terms(self) -> DataFrame:
        from .by_session import terms

        if self.stored or not self.by_session:
            return self.counted_terms
        if self.large is None:
            return terms(self.texts)
        return terms(self.texts.join(F.broadcast(self.large), "session_id", "left_anti")).unionByName(self.rest.counted_terms)

    @cached_property
    def _total(self):
        return self.sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()

    @property
    def n(self) -> int:
        return self._total[0]

    @property
    def avgdl(self) -> float:
        return self._total[1] / (self.n or 1)

    def asked(self, questions: DataFrame) -> DataFrame:
        """query_id, session_id, term, folder, weight, avgdl: the words of questions that
        their session has; a word counts as often as the question has it."""
        rows = with_session(questions).select("query_id", "session_id", F.explode(words(F.col("question"))).alias("term")).groupBy("query_id", "session_id", "term").agg(F.count("*").alias("times"))
        known = rows.join(self.counted_terms, ["session_id", "term"]).join(self.sizes.select("session_id", "avgdl"), "session_id")
        return known.select("query_id", "session_id", "term", folder(F.col("term")).alias("folder"), (F.col("times") * F.col("idf")).alias("weight"), "avgdl")

    def scores(self, questions: DataFrame) -> DataFrame:
        """query_id, chunk_ord, score of every chunk that shares a word with a question: one row for
        each, so for few questions only; ``retrieval.keyword_ranks`` keeps the best."""
        numbered = F.posexplode(F.arrays_zip("gaps", "tfs", "dls"))
        running = F.aggregate(F.slice("gaps", F.lit(1), F.col("pos") + 1), F.lit(0).cast("long"), lambda a, g: a + g)
        rows = self.asked(questions).join(self.entries.drop("folder"), ["session_id", "term"]).select("*", numbered)
        part = impact(F.col("weight"), F.col("col.tfs"), F.col("col.dls"), F.col("avgdl"))
        return rows.select("query_id", (F.col("base") + running).alias("chunk_ord"), part.alias("part")).groupBy("query_id", "chunk_ord").agg(F.sum("part").alias("score"))


def write_vectors(chunks: DataFrame, path: str, encoder=None, session: str = "session_id", mode: str = "append") -> None:
    """Append chunks with their vectors, by session; ``encoder``: pandas function
    of texts to arrays of floats, where the chunks have no ``embedding`` yet."""
    if encoder is not None:
        chunks = chunks.withColumn("embedding", encoder("text"))
    unit = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    chunks = chunks.withColumn("embedding", F.transform("embedding", lambda x: (x / unit).cast("float")))
    chunks.write.mode(mode).partitionBy(session).parquet(path)


def count_vectors(spark, path: str, session: str = "session_id") -> DataFrame:
    """session, n: chunks that a vector table holds, by session."""
    return spark.read.parquet(path).groupBy(F.col(session).cast("string").alias(session)).agg(F.count("*").alias("n"))


def reset_session(spark, path: str, chunks: DataFrame, session: str = "session_id") -> None:
    """Replace the sessions that ``chunks`` has and leave the others."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(session).parquet(path)


def collection_name(filename: Column, prefix: str = "doc_", empty: str = "file") -> Column:
    """A collection's name from a file's: last extension dropped, other characters
    than letters, digits, dot, underscore and dash replaced, at least three long."""
    base = F.when(filename.contains("."), F.regexp_replace(filename, r"(?s)\.[^.]*\z", "")).otherwise(filename)
    clean = F.regexp_replace(F.regexp_replace(base, r"[^a-zA-Z0-9._-]", "_"), r"^[._-]+|[._-]+\z", "")
    return F.when(F.length(clean) < 3, F.concat(F.lit(prefix), F.when(clean == "", F.lit(empty)).otherwise(clean))).otherwise(clean)
