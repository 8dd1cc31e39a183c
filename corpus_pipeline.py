"""Training-corpus pipeline: stages over ``documents``, each one operator of ``quillstream.llm``.

Each stage takes (spark, docs, sf_dir), where docs is all that its predecessor
kept, and returns the columns of ``documents``; the last returns the packing.
Between stages rows are a written table in the shared folder, so a lost executor
costs one stage's tasks.
"""

from __future__ import annotations

from quillstream.llm import decontaminate, ngram_join, packing, pii, quality_rules
from quillstream.llm.shared import forget, saved


def _quality_rules(spark, docs, sf_dir):
    """Documents that the rules or their host's verdict reject go."""
    return quality_rules.keep_good(docs)


def _ngram_join(spark, docs, sf_dir):
    """One document of each group of near duplicates stays."""
    return ngram_join.one_of_each(docs)


def _decontaminate(spark, docs, sf_dir):
    """Documents that contain a test item of ``benchmark`` go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _pii(spark, docs, sf_dir):
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def _packing(spark, docs, sf_dir):
    """Pieces of the documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", _quality_rules),
    ("ngram_jaccard_join", _ngram_join),
    ("benchmark_decontamination", _decontaminate),
    ("pii", _pii),
    ("best_fit_packing", _packing),
]
#: Encoding, near-duplicate groups and bootstrapping are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(before)  # the documents themselves are no saved table
    return STAGES[-1][1](spark, docs, sf_dir)
