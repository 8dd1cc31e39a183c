"""The exchange goes on while it gains."""

import random

import numpy as np

from quillstream.llm import packing


def test_exchange_goes_on_after_the_rounds_while_it_gains(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROUNDS", 1)
    rng = random.Random(5)
    rows = [(i, 0, 0, rng.randint(20, 60), i) for i in range(1200)]
    out = packing.pack(spark.createDataFrame(rows, packing.PIECES), 100, 30).collect()
    bins: dict = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append(r["length"])
    assert sorted(r["doc_id"] for r in out) == list(range(1200)) and all(sum(b) <= 100 for b in bins.values())
    bound = packing.lower_bound(*np.unique([r[3] for r in rows], return_counts=True), 100)
    assert len(bins) - bound <= 25, (len(bins), bound)  # one round leaves 37
