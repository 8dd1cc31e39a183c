"""Reranking of candidates and the relevance gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words

#: Gate for scores of a cross-encoder, and for the offline scorer below.
MODEL_THRESHOLD, LEXICAL_THRESHOLD = -2.0, -4.0


def lexical_score(question: Column, text: Column) -> Column:
    """Stand-in for a cross-encoder, not a model: 8 times the share of the
    question's distinct words that the text has, less 6, so that scores lie
    between -6 and 2."""
    asked = F.array_distinct(words(question))
    shared = F.size(F.array_intersect(asked, words(text)))
    return F.lit(8.0) * shared / F.greatest(F.size(asked), F.lit(1)) - 6.0


#: What stands for a candidate's field that retrieval didn't give.
DEFAULTS = {"retrieval_source": "unknown", "semantic_rank": -1, "keyword_rank": -1, "rrf_score": 0.0}


def with_defaults(candidates: DataFrame) -> DataFrame:
    """``candidates`` with every field of DEFAULTS, null or missing ones filled."""
    return candidates.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in candidates.columns else F.lit(v) for k, v in DEFAULTS.items()})


def rerank(candidates: DataFrame, k: int = 5, scorer=None, question: str = "question") -> DataFrame:
    """The k best candidates of each query with rerank_score and final_ord; ties
    keep the candidates' order.  ``scorer``: function of two columns, native or a
    pandas function over (question, text)."""
    scored = candidates.withColumn("rerank_score", (scorer or lexical_score)(F.col(question), F.col("text")).cast("double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "cand_ord")
    return scored.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k).withColumn("final_ord", F.col("rn") - 1).drop("rn")


def gate(questions: DataFrame, reranked: DataFrame, threshold: float = MODEL_THRESHOLD) -> DataFrame:
    """query_id, best_score, is_relevant for every question; without rows the score
    is minus infinity."""
    best = reranked.groupBy("query_id").agg(F.max_by("rerank_score", -F.col("final_ord")).alias("best_score"))
    out = questions.select("query_id").join(best, "query_id", "left")
    return out.select("query_id", F.coalesce("best_score", F.lit(float("-inf"))).alias("best_score")).withColumn("is_relevant", F.col("best_score") >= threshold)
