"""Rankings within sessions, each of which one task holds: work grows with chunks and questions.

A session of at most ``SESSION_CHUNKS`` chunks and ``SESSION_CHARS`` characters is dealt
to a task with its questions; its chunks come first and are held, its questions pass one by
one.  Statistics are taken from the chunks there, so nothing is stored and no word is moved but
within its text.  Larger sessions are searched by ``retrieval`` with all tasks.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from .index import EPSILON, impact

#: Chunks and characters that a task holds of a session.
SESSION_CHUNKS, SESSION_CHARS = 2048, 8_000_000
#: Rows of results that a task gathers.
ROWS_AT_ONCE = 50_000


def large_sessions(texts: DataFrame) -> DataFrame:
    """session_id of those that no task is to hold: at most one in SESSION_CHUNKS chunks, or in SESSION_CHARS characters."""
    sizes = texts.groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))
    return sizes.filter((F.col("n") > SESSION_CHUNKS) | (F.col("chars") > SESSION_CHARS)).select("session_id")


class _Words:
    """A session's chunks by their words."""

    def __init__(self, number: np.ndarray, texts: list):
        self.number = number
        self.tfs = [Counter(t or ()) for t in texts]
        self.dl = np.array([len(t or ()) for t in texts], float)
        self.avgdl = self.dl.sum() / len(texts)
        self.df: Counter = Counter()
        for tf in self.tfs:
            self.df.update(tf.keys())
        n, many = len(texts), Counter(self.df.values())
        raw = {d: np.log(n - d + 0.5) - np.log(d + 0.5) for d in many}
        mean = sum(raw[d] * m for d, m in many.items()) / max(len(self.df), 1)
        self.idf = {d: r if r >= 0 else mean * EPSILON for d, r in raw.items()}
        self.listed: dict = {}

    def best(self, question: list | None, width: int) -> np.ndarray:
        """Places of the ``width`` best chunks; a chunk that shares no word has score 0."""
        total = np.zeros(len(self.number))
        for term, times in Counter(question or ()).items():
            df = self.df.get(term)
            if df:
                if term not in self.listed:
                    at = np.array([i for i, tf in enumerate(self.tfs) if term in tf])
                    self.listed[term] = at, impact(1.0, np.array([self.tfs[i][term] for i in at], float), self.dl[at], self.avgdl)
                at, part = self.listed[term]
                total[at] += times * self.idf[df] * part
        return np.lexsort((self.number, -np.round(total, 9)))[:width]


class _Vectors:
    """A session's chunks by their vectors."""

    def __init__(self, number: np.ndarray, vectors: list):
        some = [i for i, v in enumerate(vectors) if v is not None]
        self.number = number[some]
        self.vectors = np.array([vectors[i] for i in some], float).reshape(len(some), -1)

    def best(self, vector: list, width: int) -> np.ndarray:
        if not len(self.number):
            return np.zeros(0, np.int64)
        return np.lexsort((self.number, -np.round(self.vectors @ np.array(vector, float), 9)))[:width]


def _runs(batches):
    """(session, kind, rows) of rows that are sorted by both."""
    for batch in batches:
        if batch.num_rows:
            session = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            kind = batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(session) != 0) | (np.diff(kind) != 0)) + 1
            for at, to in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                yield batch.column(0)[at].as_py(), kind[at], batch.slice(at, to - at)


def _held(parts: list[pa.RecordBatch], make):
    return make(np.concatenate([p.column(3).to_numpy() for p in parts]), [x for p in parts for x in p.column(4).to_pylist()])


def _ranked(make, width: int, rank: str):
    def run(batches):
        key, parts, held = None, [], None
        ids, number, ranks, n = [], [], [], 0

        def rows():
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(np.concatenate(number)), pa.array(np.concatenate(ranks).astype(np.int32))], ["query_id", "chunk_ord", rank])

        for session, kind, part in _runs(batches):
            if session != key:
                key, parts, held = session, [], None
            if kind == 0:
                parts.append(part)
                continue
            if held is None and parts:
                held, parts = _held(parts, make), []
            if held is None:
                continue
            found = [held.best(q, width) for q in part.column(4).to_pylist()]
            sizes = [len(f) for f in found]
            ids.append(part.column(2).take(pa.array(np.repeat(np.arange(len(found)), sizes))))
            number += [held.number[f] for f in found]
            ranks += [np.arange(k) for k in sizes]
            n += sum(sizes)
            if n >= ROWS_AT_ONCE:
                yield rows()
                ids, number, ranks, n = [], [], [], 0
        if n:
            yield rows()

    return run


def _dealt(rows: DataFrame, payload) -> DataFrame:
    by = ["session_id", "kind"]
    return rows.repartition("session_id").sortWithinPartitions(*by).select(*by, "query_id", "chunk_ord", payload)


def _both(chunks: DataFrame, questions: DataFrame, of_chunk, of_question) -> DataFrame:
    id_type = questions.schema["query_id"].dataType
    a = chunks.select("session_id", F.lit(0).alias("kind"), F.lit(None).cast(id_type).alias("query_id"), F.col("chunk_ord").cast("long").alias("chunk_ord"), of_chunk.alias("x"))
    b = questions.select("session_id", F.lit(1).alias("kind"), "query_id", F.lit(-1).cast("long").alias("chunk_ord"), of_question.alias("x"))
    return a.unionByName(b).filter("session_id IS NOT NULL")


def _result(questions: DataFrame, rank: str) -> str:
    return f"query_id {questions.schema['query_id'].dataType.simpleString()}, chunk_ord long, {rank} int"


def keyword(texts: DataFrame, questions: DataFrame, width: int) -> DataFrame:
    """query_id, chunk_ord, keyword_rank; words are split where texts arrive."""
    rows = _both(texts, questions, F.col("text"), F.col("question"))
    return _dealt(rows, words(F.col("x")).alias("x")).mapInArrow(_ranked(_Words, width, "keyword_rank"), _result(questions, "keyword_rank"))


def semantic(chunks: DataFrame, questions: DataFrame, width: int) -> DataFrame:
    """query_id, chunk_ord, semantic_rank by products of vectors."""
    vector = lambda c: F.col(c).cast("array<double>")
    rows = _both(chunks, questions, vector("embedding"), vector("vector"))
    return _dealt(rows, F.col("x")).mapInArrow(_ranked(_Vectors, width, "semantic_rank"), _result(questions, "semantic_rank"))


def _listed(batches):
    """session_id, term, df, idf of sessions that come one after the other."""
    sessions, sizes, terms, dfs, idfs = [], [], [], [], []

    def add(key, parts):
        held = _held(parts, _Words)
        sessions.append(key)
        sizes.append(len(held.df))
        terms.extend(held.df.keys())
        df = list(held.df.values())
        dfs.extend(df)
        idfs.extend(map(held.idf.__getitem__, df))

    def rows():
        names = pa.array(sessions, pa.string()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        out = pa.RecordBatch.from_arrays([names, pa.array(terms, pa.string()), pa.array(dfs, pa.int64()), pa.array(idfs, pa.float64())], ["session_id", "term", "df", "idf"])
        for x in (sessions, sizes, terms, dfs, idfs):
            x.clear()
        return out

    key, parts = None, []
    for session, _, part in _runs(batches):
        if session != key and parts:
            add(key, parts)
            parts = []
            if len(terms) >= ROWS_AT_ONCE:
                yield rows()
        key = session
        parts.append(part)
    if parts:
        add(key, parts)
    if terms:
        yield rows()


def terms(texts: DataFrame) -> DataFrame:
    """session_id, term, df, idf of each session's words."""
    rows = texts.filter("session_id IS NOT NULL").select("session_id", F.lit(0).alias("kind"), F.lit(0).alias("query_id"), F.lit(0).cast("long").alias("chunk_ord"), F.col("text").alias("x"))
    return _dealt(rows, words(F.col("x")).alias("x")).mapInArrow(_listed, "session_id string, term string, df long, idf double")
