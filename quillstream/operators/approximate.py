"""Approximate vector search: inverted lists over k-means centroids.

The centroids are trained by Spark's k-means (cosine distance) on a sample of at most
``TRAINED_ON`` vectors, chosen by a hash of the chunk's number; every vector is then put
into the list of its nearest centroid.  A question probes the lists of its nearest
centroids, and the vectors in them are scored exactly, so that scores and ties are
those of ``retrieval.semantic_ranks`` and, with all lists probed, so are the results.
How many lists find a wanted share of the exact results depends on how the vectors
lie; ``tuned`` measures it.

Chunks without a vector are in no list; a session's question only meets its session's
vectors; a collection without vectors has no lists and gives no candidates.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import saved, tidy
from .index import with_session
from .retrieval import in_blocks, nearest, ranked, semantic_ranks, with_chunks

#: Vectors that centroids are trained on at most; lists at most (each task of a search holds their centroids); folders of lists.
TRAINED_ON, LISTS_AT_MOST, FOLDERS = 200_000, 8192, 64
#: Questions that the number of probes is tuned on.
TUNED_ON = 128
#: Share of the lists that a question probes, unless told otherwise.
PROBED = 0.25

_KEY = "\x1f"


class VectorLists:
    """Lists of a chunk collection (chunk_ord, text, page_number, embedding and perhaps session_id)."""

    def __init__(self, chunks: DataFrame, lists: int | None = None, seed: int = 7):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        self.chunks = with_session(chunks)
        rows = self.chunks.filter("embedding IS NOT NULL").select("session_id", F.col("chunk_ord").cast("long").alias("chunk_ord"), "embedding")
        n = rows.count()
        self.lists = min(LISTS_AT_MOST, n, lists or max(1, round(math.sqrt(n))))
        self.centroids, self.stored = np.zeros((0, 0)), None
        if not n:
            return
        vectors = rows.withColumn("features", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))
        sample = vectors.filter(F.pmod(F.xxhash64(F.lit(seed), "chunk_ord"), F.lit(n)) < TRAINED_ON).select("features")
        model = KMeans(k=max(self.lists, 2), seed=seed, maxIter=10, distanceMeasure="cosine").fit(sample)
        self.centroids = np.array(model.clusterCenters())
        self.centroids /= np.linalg.norm(self.centroids, axis=1, keepdims=True)
        self.lists = len(self.centroids)
        placed = model.transform(vectors).select(F.concat_ws(_KEY, "session_id", F.col("prediction").cast("string")).alias("key"), "chunk_ord", "embedding", F.pmod("prediction", F.lit(FOLDERS)).alias("folder"))
        # a list of one session may be large: its vectors are several tasks' work
        self.stored = saved(placed.repartition("folder", F.pmod(F.xxhash64("chunk_ord"), F.lit(n // 1_000_000 + 1))).sortWithinPartitions("folder", "key"), "lists", by="folder")

    def probed(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        """The lists of the nearest centroids of each vector."""
        return np.argsort(-np.einsum("ij,kj->ik", vectors, self.centroids), axis=1, kind="stable")[:, :probes]

    @property
    def probes(self) -> int:
        return max(1, math.ceil(self.lists * PROBED))


@tidy
def approximate_ranks(lists: VectorLists, questions: DataFrame, width: int, probes: int | None = None) -> DataFrame:
    """query_id, chunk_ord, session_id, text, page_number, semantic_rank like
    ``semantic_ranks``, of the chunks in the ``probes`` nearest lists of each question."""
    asked = with_session(questions).filter("vector IS NOT NULL").select("query_id", "session_id", "vector")
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, chunk_ord long, score double"
    spark, out = questions.sparkSession, None
    for block in in_blocks(asked) if lists.stored is not None else []:
        held = block.toArrow()
        if not held.num_rows:
            continue
        vectors = np.array(held.column("vector").to_pylist(), float)
        members: dict[str, list[int]] = {}
        near = lists.probed(vectors, min(probes or lists.probes, lists.lists))
        for i, (session, of) in enumerate(zip(held.column("session_id").to_pylist(), near.tolist())):
            for k in of:
                members.setdefault(f"{session}{_KEY}{k}", []).append(i)
        wanted = spark.createDataFrame([(k,) for k in members], "key string")  # questions in a block x probes at most
        read = lists.stored.filter(F.col("folder").isin(sorted({k % FOLDERS for k in np.unique(near).tolist()}))).join(F.broadcast(wanted), "key", "left_semi")
        found = read.select("key", "chunk_ord", "embedding").mapInArrow(nearest(held.column("query_id").combine_chunks(), {k: np.array(v) for k, v in members.items()}, vectors, width), schema)
        out = found if out is None else out.unionByName(found)
    found = spark.createDataFrame([], schema) if out is None else out
    return with_chunks(ranked(found, width, "semantic_rank"), lists.chunks, "semantic_rank")


@tidy
def tuned(lists: VectorLists, questions: DataFrame, width: int, target: float = 0.95) -> int:
    """Probes that find ``target`` of the exact ``width`` best, measured on at most ``TUNED_ON`` of the questions."""
    asked = with_session(questions).filter("vector IS NOT NULL").select("query_id", "session_id", "vector")
    some = saved(asked.orderBy(F.xxhash64("query_id"), "query_id").limit(TUNED_ON), "tuned-on")
    if lists.stored is None or not some.count():
        return lists.probes
    held = some.toArrow()
    order = lists.probed(np.array(held.column("vector").to_pylist(), float), lists.lists)
    place = dict(zip(held.column("query_id").to_pylist(), np.argsort(order, axis=1)))
    exact = semantic_ranks(lists.chunks, some, width).select("query_id", "chunk_ord")
    # as many rows as sampled questions have results
    found = exact.join(lists.stored.select("chunk_ord", F.substring_index("key", _KEY, -1).cast("int").alias("list")), "chunk_ord").select("query_id", "list").toArrow()
    depth = np.sort([place[q][k] for q, k in zip(found.column("query_id").to_pylist(), found.column("list").to_pylist())])
    return int(depth[min(len(depth) - 1, math.ceil(target * len(depth)))]) + 1 if len(depth) else lists.probes


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """query_id, n, found: rows of the exact ranking and how many of them the other one has."""
    hit = approximate.select("query_id", "chunk_ord", F.lit(1).alias("hit"))
    return exact.select("query_id", "chunk_ord").join(hit, ["query_id", "chunk_ord"], "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count("hit").alias("found"))
