"""Hybrid retrieval: exact vector search, BM25, weighted reciprocal rank fusion.

Questions are rows (query_id, question, vector); one or a million take one plan.
Where chunks and questions have a session_id, a question searches its session's
chunks alone, with that session's statistics; without one they are one collection.
Scores are rounded before they rank, so that a different order of summation does
not decide between equals; ties go to the earlier chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import saved, tidy
from . import by_session
from .index import BLOCK, GONE, Index, by_collection, folder, impact, slices, tokens, with_session

RRF, SEMANTIC_WEIGHT = 60, 0.6
#: Questions' vectors that are broadcast at a time: a bound on what every task holds.
QUESTIONS_AT_ONCE = 4096
#: Hashes of found texts that are broadcast to look their pages up; more are joined by a shuffle.
TEXTS_AT_ONCE = 500_000
#: Ranked rows that are broadcast to fetch their texts; more are joined by a shuffle.
RANKED_AT_ONCE = 1_000_000


def fetch_width(k: int) -> int:
    """Rows that each channel fetches for k results."""
    return max(3 * k, 20)


def ranked(scored: DataFrame, width: int, rank: str) -> DataFrame:
    """The ``width`` best rows of each query with 0-based ``rank``; the limit is
    stated on the row number, so each task cuts its own rows before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_ord")
    return scored.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= width).withColumn(rank, F.col("rn") - 1).drop("rn")


#: Vectors of chunks that are scored at a time, against a block of questions.
VECTORS_AT_ONCE = 1024


class _Best:
    """A task's ``width`` best chunks for each of some questions, by (score, earlier chunk)."""

    def __init__(self, n: int, width: int):
        self.width = width
        self.score, self.number = np.full((n, width), -np.inf), np.full((n, width), np.iinfo(np.int64).max)

    def offer(self, of: np.ndarray, score: np.ndarray, number: np.ndarray) -> None:
        """Scores (a row for each question ``of``) of the chunks ``number``; minus infinity is none."""
        # what cannot enter a list is left out before anything is sorted
        row, col = np.nonzero((score >= self.score[of, -1][:, None]) & (score > -np.inf))
        some, row = np.unique(row, return_inverse=True)
        if not len(some):
            return
        of = of[some]
        group = np.concatenate([np.repeat(np.arange(len(of)), self.width), row])
        number = np.concatenate([self.number[of].ravel(), number[col]])
        score = np.concatenate([self.score[of].ravel(), score[some[row], col]])
        order = np.lexsort((number, -score, group))
        top = order[np.searchsorted(group[order], np.arange(len(of)))[:, None] + np.arange(self.width)]
        self.score[of], self.number[of] = score[top], number[top]

    def rows(self, ids: pa.Array):
        of, k = np.nonzero(self.score > -np.inf)
        if len(of):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pa.array(self.number[of, k]), pa.array(self.score[of, k])], ["query_id", "chunk_ord", "score"])


def _by_value(values: list) -> dict:
    """Places of each distinct value."""
    out: dict = {}
    for i, v in enumerate(values):
        out.setdefault(v, []).append(i)
    return {v: np.array(i) for v, i in out.items()}


def nearest(ids: pa.Array, questions: dict, vectors: np.ndarray, width: int):
    """A task's function: of its chunks (key, chunk_ord, embedding) the ``width`` best for
    each question, as (query_id, chunk_ord, score); ``questions``: key (a session, or a
    list of one) -> places in ``ids`` of those that search it."""

    def run(batches):
        best = _Best(len(ids), width)
        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())
            for at in range(0, batch.num_rows, VECTORS_AT_ONCE):
                part = batch.slice(at, VECTORS_AT_ONCE)
                e = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
                number = part.column(1).to_numpy()
                for session, rows in _by_value(part.column(0).to_pylist()).items():
                    of = questions.get(session)
                    if of is not None:
                        best.offer(of, np.round(vectors[of] @ e[rows].T, 9), number[rows])
        yield from best.rows(ids)

    return run


def in_blocks(questions: DataFrame) -> list[DataFrame]:
    """Questions in blocks of at most about QUESTIONS_AT_ONCE."""
    blocks = -(-questions.count() // QUESTIONS_AT_ONCE)
    return [questions] if blocks <= 1 else [questions.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k) for k in range(blocks)]


def _apart(rows: DataFrame, large: DataFrame | None, how: str) -> DataFrame:
    """``rows`` of the ``large`` sessions (left_semi) or of the others (left_anti)."""
    return rows if large is None else rows.join(F.broadcast(large), "session_id", how)


@tidy
def semantic_ranks(chunks: DataFrame, questions: DataFrame, width: int, texts: DataFrame | None = None, index: Index | None = None, keys: bool = False) -> DataFrame:
    """query_id, chunk_ord, session_id, text, page_number, semantic_rank by cosine of unit vectors.

    Exact: every chunk meets every question of its session, as products of matrices in the
    chunks' own tasks, which keep ``width`` rows a question; only those are shuffled.
    Questions come in blocks of a bounded number of vectors.  Where the ``index`` has
    sessions, those that a task can hold meet their questions there.  ``texts``: see
    ``Index``; ``keys``: see ``with_chunks``."""
    chunks, asked = with_session(chunks), with_session(questions).filter("vector IS NOT NULL").select("query_id", "session_id", "vector")
    out, blocks, rows = None, None, chunks.select("session_id", F.col("chunk_ord").cast("long").alias("chunk_ord"), "embedding")
    if index is not None and index.by_session:
        out = by_session.semantic(_apart(rows, index.large, "left_anti"), _apart(asked, index.large, "left_anti"), width)
        blocks = [] if index.large is None else in_blocks(_apart(asked, index.large, "left_semi"))
        rows = _apart(rows, index.large, "left_semi")
    for block in in_blocks(asked) if blocks is None else blocks:
        held = block.toArrow()
        vectors = np.array(held.column("vector").to_pylist(), float).reshape(held.num_rows, -1)
        ids = held.column("query_id").combine_chunks()
        found = rows.mapInArrow(nearest(ids, _by_value(held.column("session_id").to_pylist()), vectors, width), f"query_id {asked.schema['query_id'].dataType.simpleString()}, chunk_ord long, score double")
        part = ranked(found, width, "semantic_rank").select("query_id", "chunk_ord", "semantic_rank")
        out = part if out is None else out.unionByName(part)
    return with_chunks(out, chunks if texts is None else with_session(texts), "semantic_rank", keys)


def text_keys() -> dict:
    """Two hashes that tell texts apart, so that no text is moved to compare it."""
    return {"h1": F.xxhash64("text"), "h2": F.when(F.col("text").isNotNull(), F.hash("text", F.length("text")))}


def with_chunks(top: DataFrame, chunks: DataFrame, rank: str, keys: bool = False) -> DataFrame:
    """Ranked rows with the text (``keys``: its ``text_keys`` instead) and page of their chunk.  Where
    the ranked rows are few they go to the chunks, so that other chunks' texts stay where they are."""
    what = ["text"]
    top = saved(top.select("query_id", "chunk_ord", rank), "ranked")
    few = top.count() <= RANKED_AT_ONCE
    if keys:
        what = ["h1", "h2"]
        # where ranked rows go to the chunks, only the texts that they find are hashed
        chunks = chunks if few else chunks.withColumns(text_keys())
    top = F.broadcast(top) if few else top
    found = chunks.select("chunk_ord", "session_id", *(["text"] if few else what), "page_number").join(top, "chunk_ord")
    found = found.withColumns(text_keys()) if keys and few else found
    return found.select("query_id", "chunk_ord", "session_id", *what, "page_number", rank)


#: Questions that are scored at a time, against a block of chunks.
SCORED_AT_ONCE = 256


class _Scorer:
    """A task's ``width`` best chunks for each question by BM25.

    ``asked``: session -> (avgdl, term -> (questions, weights)).  A question meets a block of
    chunks only if the block's bounds on its words allow a score that its ``width`` best so far
    don't beat.  With ``every``, chunks without a score take part, as some scores may be negative."""

    def __init__(self, ids: pa.Array, asked: dict, width: int, every: bool):
        self.ids, self.asked, self.every, self.best = ids, asked, every, _Best(len(ids), width)

    def score(self, session, number: np.ndarray, rows: list[dict], gone: np.ndarray | bool = False) -> None:
        """``rows``: of each term the places ``at`` in ``number`` of the chunks that have it, their
        ``tfs`` and ``dls``, and bounds on both."""
        avgdl, terms = self.asked[session]
        rows = [(r, *terms[r["term"]]) for r in rows if r["term"] in terms]
        n = len(self.ids)
        bound = np.full(n, 0.0 if self.every else -np.inf)
        for r, of, weight in rows:
            most = impact(weight, r["top_tf"], r["least_dl"], avgdl)
            bound[of] = np.where(np.isinf(bound[of]), 0, bound[of]) + np.maximum(most, 0)
        # as sums are rounded, a bound that is short by a rounding still counts
        alive = np.flatnonzero((bound + 1e-8 >= self.best.score[:, -1]) & (bound > -np.inf))
        place = np.full(n, -1)
        for at in range(0, len(alive), SCORED_AT_ONCE):
            some = alive[at : at + SCORED_AT_ONCE]
            place[:] = -1
            place[some] = np.arange(len(some))
            total, met = np.zeros((len(some), len(number))), np.full((len(some), len(number)), self.every)
            for r, of, weight in rows:
                here = place[of] >= 0
                if here.any():
                    where = np.ix_(place[of][here], r["at"])
                    total[where] += weight[here][:, None] * impact(1.0, r["tfs"].astype(float), r["dls"], avgdl)
                    met[where] = True
            self.best.offer(some, np.where(met & ~np.asarray(gone), np.round(total, 9), -np.inf), number)


def _best_of_blocks(ids: pa.Array, asked: dict, width: int, every: bool):
    """A task's function: of its postings, sorted by session and block, the ``width`` best
    chunks for each question, as (query_id, chunk_ord, score); see ``_Scorer``."""

    def run(batches):
        scorer = _Scorer(ids, asked, width, every)

        def score(session, rows):
            ords = [r["base"] + np.cumsum(r["gaps"]) for r in rows]
            number = np.unique(np.concatenate(ords))
            gone = [o for r, o in zip(rows, ords) if r["term"] == GONE]
            for r, o in zip(rows, ords):
                r["at"] = np.searchsorted(number, o)
            scorer.score(session, number, rows, np.isin(number, np.concatenate(gone)) if gone else False)

        key, rows = None, []
        for batch in batches:
            for session, block, term, base, gaps, tfs, dls, top_tf, least_dl in zip(*(batch.column(i) if 4 <= i <= 6 else batch.column(i).to_pylist() for i in range(9))):
                if (session, block) != key:
                    if rows:
                        score(key[0], rows)
                    key, rows = (session, block), []
                flat = [x.values.to_numpy() for x in (gaps, tfs, dls)]
                rows.append(dict(zip(("term", "base", "gaps", "tfs", "dls", "top_tf", "least_dl"), (term, base, *flat, top_tf, least_dl))))
        if rows:
            score(key[0], rows)
        yield from scorer.best.rows(ids)

    return run


def _best_of_texts(ids: pa.Array, asked: dict, width: int, every: bool):
    """A task's function: of its texts (session_id, chunk_ord, lowered text) the ``width`` best
    chunks for each question, as (query_id, chunk_ord, score); see ``_Scorer``."""
    names = {s: list(terms) for s, (_, terms) in asked.items()}

    def run(batches):
        scorer, known = _Scorer(ids, asked, width, every), {s: pa.array(t, pa.string()) for s, t in names.items()}

        def score(session, chunks):
            row, coded, dl = tokens(chunks.column(2))
            place = pc.index_in(coded.dictionary, value_set=known[session]).fill_null(-1).to_numpy().astype(np.int64)
            word = place[coded.indices.to_numpy(zero_copy_only=False)]
            met = word >= 0
            pair, tf = np.unique(word[met] * len(dl) + row[met], return_counts=True)
            if not len(pair) and not every:
                return
            word, row = np.divmod(pair, len(dl))
            start = np.flatnonzero(np.diff(word, prepend=-1))
            dls = dl[row]
            bounds = (np.maximum.reduceat(tf, start), np.minimum.reduceat(dls, start)) if len(start) else ((), ())
            ends = np.append(start, len(word))[1:]
            rows = [{"term": names[session][word[a]], "at": row[a:b], "tfs": tf[a:b], "dls": dls[a:b], "top_tf": t, "least_dl": d} for a, b, t, d in zip(start, ends, *bounds)]
            scorer.score(session, chunks.column(1).to_numpy(), rows)

        for batch in batches:
            for part in slices(batch, 2):
                for session, chunks in by_collection(part):
                    # more chunks than a block are short ones
                    for at in range(0, chunks.num_rows if session in names else 0, BLOCK):
                        score(session, chunks.slice(at, BLOCK))
        yield from scorer.best.rows(ids)

    return run


@tidy
def keyword_ranks(index: Index, questions: DataFrame, width: int, keys: bool = False) -> DataFrame:
    """query_id, chunk_ord, session_id, text, page_number, keyword_rank by BM25 within the question's session.

    Exact.  A task keeps ``width`` chunks a question, so that no word, however frequent, makes
    rows of (question, chunk).  At most QUESTIONS_AT_ONCE questions meet the texts where those are
    read; for more, or where they are there already, the postings of the questions' words are
    read from their folders and dealt by blocks of chunks.  Chunks without a score are ranked too,
    after the others: the first ``width`` chunks of the session are enough to fill a list.

    Sessions that a task can hold are ranked there (``by_session``), unless their postings are
    stored and the questions few.  ``keys``: see ``with_chunks``."""
    questions = with_session(questions).select("query_id", "session_id", "question")
    if not index.by_session or (index.stored and questions.count() <= QUESTIONS_AT_ONCE):
        return with_chunks(_from_index(index, questions, width), index.texts, "keyword_rank", keys)
    large = index.large
    out = by_session.keyword(_apart(index.texts, large, "left_anti"), _apart(questions, large, "left_anti"), width)
    if large is not None:
        out = out.unionByName(_from_index(index.rest, _apart(questions, large, "left_semi"), width))
    return with_chunks(out, index.texts, "keyword_rank", keys)


def _from_index(index: Index, questions: DataFrame, width: int) -> DataFrame:
    """query_id, chunk_ord, keyword_rank."""
    blocks, out, lists = in_blocks(questions), None, None
    spark = questions.sparkSession
    id_type = questions.schema["query_id"].dataType.simpleString()
    for block in blocks:
        held = index.asked(block).toArrow()  # the words of a bounded number of questions
        listed = pc.unique(held.column("query_id"))
        place = {q: i for i, q in enumerate(listed.to_pylist())}
        asked: dict = {}
        for q, session, term, weight, avgdl in zip(*(held.column(c).to_pylist() for c in ("query_id", "session_id", "term", "weight", "avgdl"))):
            of, weights = asked.setdefault(session, (avgdl, {}))[1].setdefault(term, ([], []))
            of.append(place[q])
            weights.append(weight)
        asked = {s: (avgdl, {t: (np.array(of), np.array(w)) for t, (of, w) in terms.items()}) for s, (avgdl, terms) in asked.items()}
        every = bool(held.num_rows) and pc.min(held.column("weight")).as_py() < 0
        read = _read_postings if index.listed or len(blocks) > 1 else _read_texts
        rows, task = read(index, held, listed, asked, width, every)
        found = rows.mapInArrow(task, f"query_id {id_type}, chunk_ord long, score double")
        out = found if out is None else out.unionByName(found)
        # where every chunk took part, there is nothing to fill up
        open_ = block.select("query_id", "session_id")
        if every:
            open_ = open_.join(F.broadcast(spark.createDataFrame(pa.table([listed], ["query_id"]))), "query_id", "left_anti")
        lists = open_ if lists is None else lists.unionByName(open_)
    place = Window.partitionBy("session_id").orderBy("chunk_ord")
    first = index.texts.select("session_id", F.col("chunk_ord").cast("long").alias("chunk_ord")).withColumn("rn", F.row_number().over(place)).filter(F.col("rn") <= width).drop("rn")
    filler = lists.join(first, "session_id").select("query_id", "chunk_ord", F.lit(0.0).alias("score"))
    # a chunk that has a score, if a negative one, isn't filler
    both = out.unionByName(filler).groupBy("query_id", "chunk_ord").agg(F.max(F.struct(F.col("score") != 0, "score")).alias("s")).select("query_id", "chunk_ord", F.col("s.score").alias("score"))
    return ranked(both, width, "keyword_rank").select("query_id", "chunk_ord", "keyword_rank")


def _read_texts(index: Index, held: pa.Table, listed: pa.Array, asked: dict, width: int, every: bool):
    """The texts and a task's function for them; nothing is shuffled."""
    rows = index.texts.select("session_id", F.col("chunk_ord").cast("long").alias("chunk_ord"), F.lower("text").alias("text"))
    return rows, _best_of_texts(listed, asked, width, every)


def _read_postings(index: Index, held: pa.Table, listed: pa.Array, asked: dict, width: int, every: bool):
    """The questions' words in the postings, dealt by blocks, and a task's function for them."""
    spark = index.texts.sparkSession
    names = [(s, t) for s, (_, terms) in asked.items() for t in [*terms, GONE, *[""] * every]]
    wanted = spark.createDataFrame(pa.table([pa.array([n[i] for n in names], pa.string()) for i in (0, 1)], ["session_id", "term"]))
    beside = spark.range(1).select(folder(F.lit(GONE)), folder(F.lit(""))).first()
    folders = sorted({*held.column("folder").to_pylist(), beside[0], *beside[1:][: int(every)]})
    read = index.entries.filter(F.col("folder").isin(folders)).join(F.broadcast(wanted), ["session_id", "term"], "left_semi")
    by = ["session_id", "block"]
    dealt = read.repartition(*by).sortWithinPartitions(*by).select(*by, "term", "base", "gaps", "tfs", "dls", "top_tf", "least_dl")
    return dealt, _best_of_blocks(listed, asked, width, every)


@tidy
def fuse(semantic: DataFrame, keyword: DataFrame, chunks: DataFrame, k: int, weight: float = SEMANTIC_WEIGHT) -> DataFrame:
    """The k best texts of each query by weighted reciprocal ranks: query_id, text,
    page_number, retrieval_source, semantic_rank, keyword_rank, rrf_score, cand_ord.

    Ranks are of texts: of equal texts in a channel's window the last counts.  A
    channel without the text counts as rank ``fetch_width(k)``; its rank is -1."""
    width = fetch_width(k)
    semantic, keyword, chunks = map(with_session, (semantic, keyword, chunks))
    # texts stay where they are until the k best are known
    semantic, keyword = (r if "h1" in r.columns else r.withColumns(text_keys()).drop("text") for r in (semantic, keyword))
    one = ["query_id", "session_id", "h1", "h2"]
    s = semantic.groupBy(*one).agg(F.max("semantic_rank").alias("semantic_rank"), F.max_by("page_number", "semantic_rank").alias("page_s"), F.min("chunk_ord").alias("ord_s"))
    w = keyword.groupBy(*one).agg(F.max("keyword_rank").alias("keyword_rank"), F.min("chunk_ord").alias("ord_k"))
    both = s.join(w, one, "full")
    share = lambda rank, part: F.lit(part) / (F.lit(RRF) + F.coalesce(rank, F.lit(width)))
    both = both.withColumn("rrf_score", share(F.col("semantic_rank"), weight) + share(F.col("keyword_rank"), 1 - weight)).withColumn("first", F.least("ord_s", "ord_k"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf_score", 12)), "first")
    top = both.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k).withColumn("h2", F.coalesce("h2", F.lit(0)))
    top = saved(top, "fused")
    # a text that only keywords found has the page of its session's first chunk with it
    sought = top.filter("page_s IS NULL").select("session_id", "h1", "h2").distinct()
    sought = F.broadcast(sought) if sought.count() <= TEXTS_AT_ONCE else sought
    same = ["session_id", "h1", "h2"]
    keyed = chunks.withColumns(text_keys()).withColumn("h2", F.coalesce("h2", F.lit(0))).select(*same, "chunk_ord", "page_number")
    pages = keyed.join(sought, same, "left_semi").groupBy(*same).agg(F.min_by("page_number", "chunk_ord").alias("page_k"))
    paged = top.join(pages, same, "left")
    paged = F.broadcast(paged) if top.count() <= RANKED_AT_ONCE else paged
    source = F.when(F.col("semantic_rank").isNull(), "keyword").when(F.col("keyword_rank").isNull(), "semantic").otherwise("hybrid")
    return chunks.select(F.col("chunk_ord").alias("first"), "text").join(paged, "first").select(
        "query_id",
        "text",
        F.coalesce("page_s", "page_k", F.lit(1)).alias("page_number"),
        source.alias("retrieval_source"),
        F.coalesce("semantic_rank", F.lit(-1)).alias("semantic_rank"),
        F.coalesce("keyword_rank", F.lit(-1)).alias("keyword_rank"),
        "rrf_score",
        (F.col("rn") - 1).alias("cand_ord"),
    )


def semantic_query(chunks: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """query_id, text, page_number, semantic_rank of the k nearest chunks."""
    return semantic_ranks(chunks, questions, k).select("query_id", "text", "page_number", "semantic_rank")


@tidy
def hybrid_query(index: Index, questions: DataFrame, k: int = 5, weight: float = SEMANTIC_WEIGHT) -> DataFrame:
    """Fused candidates of each question; an empty collection gives none."""
    width = fetch_width(k)
    return fuse(semantic_ranks(index.chunks, questions, width, index.texts, index, keys=True), keyword_ranks(index, questions, width, keys=True), index.texts, k, weight)
