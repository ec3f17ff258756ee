"""Operators for preparing training data; nothing else in the library imports this package."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name -> module that defines ``query(spark, sf_dir)`` and ``ORACLE_SQL`` (None where SQL can't express it).
MODULES = {
    "op2_html_extraction": "html_extract",
    "op7_lm_scoring": "lm_score",
    "op9_toxicity": "toxicity",
    "op8_hilbert_sharding": "sharding",
    "op5_source_mixing": "mixing",
    "op4_minhash_near_dedup": "minhash_dedup",
    "op3_embedding_near_dedup": "embedding_dedup",
    "op6_exact_topk": "topk",
    "op1_token_files": "token_files",
    "op10_packing": "packing",
    "op11_embedding_whitening": "whitening",
    "op12_url_filters": "url_filter",
    "op13_source_divergence": "divergence",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: import_module(f"{__name__}.{mod}").query for name, mod in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: import_module(f"{__name__}.{mod}").ORACLE_SQL for name, mod in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
