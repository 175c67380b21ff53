"""The queries of the numbered operators and of the pipeline, with SQL where it can express them."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from proofmill.llm import oracles, shared

#: Query name to module and function.
NAMES = {
    "op1_token_files": ("token_files", "op1_token_files"),
    "op2_perplexity": ("perplexity", "op2_perplexity"),
    "op3_jaccard_join": ("jaccard", "op3_jaccard_join"),
    "op4_decontaminate": ("decontam", "op4_decontaminate"),
    "op5_token_counts": ("token_counts", "op5_token_counts"),
    "op6_repeats": ("repeats", "op6_repeats"),
    "op7_surrogates": ("pii", "op7_surrogates"),
    "op8_pack": ("packing", "op8_pack"),
    "op9_toxicity": ("toxicity", "op9_toxicity"),
    "op10_shards": ("shards", "op10_shards"),
    "op11_neighbours": ("neighbours", "op11_neighbours"),
    "op12_conversation_repair": ("conversations", "op12_conversation_repair"),
    "op13_fill_in_middle": ("middle", "op13_fill_in_middle"),
}


def _tidy(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, leaving behind only the working tables that its result reads."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        since = shared.made()
        return shared.tidied(query(spark, sf_dir), since)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _tidy(getattr(importlib.import_module(f"proofmill.llm.{module}"), f)) for name, (module, f) in NAMES.items()}
    out["pipeline"] = importlib.import_module("corpus_pipeline").run
    return out


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
