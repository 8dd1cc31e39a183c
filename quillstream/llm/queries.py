"""The registered queries over the synthetic tables, and their SQL."""

from __future__ import annotations

import importlib

#: Query name -> module of this subpackage with ``query(spark, sf_dir)`` and
#: perhaps ``ORACLE_SQL``.
MODULES = {
    "op1_quality_rules": "quality_rules",
    "op2_best_fit_packing": "packing",
    "op3_ngram_jaccard_join": "ngram_join",
    "op4_token_store": "token_store",
    "op5_pii": "pii",
    "op6_benchmark_decontamination": "decontaminate",
    "op7_token_counts": "token_counts",
    "op8_quality_classifier": "quality_model",
    "op9_language_id": "langid",
    "op10_lm_scoring": "lm_score",
    "op11_source_divergence": "divergence",
    "op12_conversation_trie": "prefix_trie",
    "op13_cutting_stock_packing": "cutting_stock",
}


def _query(module: str):
    def run(spark, sf_dir):
        return importlib.import_module(f".{module}", __package__).query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _query(module) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f".{module}", __package__), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
