"""Connected components of an edge table: tasks contract their edges, labels propagate between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, hot_keys, join_hot, saved, tidy

#: Edges (16 bytes each) that one task contracts; a graph of no more is one task's work.
EDGES_AT_ONCE = 250_000


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the least node that each reaches by them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        lo, hi = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        if (lo == hi).all():
            return nodes, nodes[label]
        np.minimum.at(label, hi, lo)
        while (label[label] != label).any():
            label = label[label]


def _contract(batches):
    """Edges (a, b) to (node, comp): the same components, with a star for each that the edges held at a time have."""

    def star(held):
        nodes, comp = least_reachable(*(np.concatenate([h.column(i).to_numpy() for h in held]) for i in range(2)))
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(comp)], ["node", "comp"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= EDGES_AT_ONCE:
            yield star(held)
            held, n = [], 0
    if n:
        yield star(held)


@tidy
def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, comp (the smallest node reachable) for every node of ``edges`` (a, b).

    Tasks replace the edges that they hold by stars, EDGES_AT_ONCE at a time; where the
    graph, or what is left of it, is no more than that, one task ends the work.  Otherwise
    each round every node takes the smallest label next to it, hands it to the
    node that its old label names, and then takes its label's label; the labels
    of a path of n nodes settle in about log n rounds.  Labels are a written
    table after each round, and the one before is deleted.  A node with very many
    edges, and a label that very many nodes have, are hot keys: what they join
    with is broadcast (``join_hot``); aggregates combine on the map side.
    """
    edges = edges.select("a", "b")
    few = edges.count() <= EDGES_AT_ONCE
    stars = saved((edges.coalesce(1) if few else edges).mapInArrow(_contract, "node bigint, comp bigint"), "stars")
    if few:
        return stars
    if stars.count() <= EDGES_AT_ONCE:
        edges = stars.select(F.col("node").alias("a"), F.col("comp").alias("b"))
        return saved(edges.coalesce(1).mapInArrow(_contract, "node bigint, comp bigint"), "labels")
    # a node that is alone in its star here is another's there
    both = saved(stars.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(stars.select(F.col("comp").alias("a"), F.col("node").alias("b"))).distinct(), "edges")
    hot = hot_keys(both, "b")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("comp"))
    labels = saved(labels, "labels")
    for _ in range(rounds):
        near = join_hot(both, labels.select(F.col("node").alias("b"), "comp"), "b", hot=hot).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = saved(labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("new")), "step")
        # the root of the old label learns what its members found
        heard = step.groupBy(F.col("comp").alias("node")).agg(F.min("new").alias("heard"))
        told = saved(step.join(heard, "node", "left").select("node", "comp", F.least("new", F.coalesce("heard", "new")).alias("new")), "labels")
        jump = told.select(F.col("node").alias("new"), F.col("new").alias("next"))
        before, labels = labels, saved(join_hot(told, jump, "new", "left").select("node", F.least("new", F.coalesce("next", "new")).alias("comp"), (F.col("new") != F.col("comp")).alias("moved")), "labels")
        forget(before, step, told)
        if labels.filter("moved").isEmpty():
            forget(both, stars)
            return labels.select("node", "comp")
    raise RuntimeError("components did not settle")
