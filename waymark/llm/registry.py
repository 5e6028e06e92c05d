"""The queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import best_fit, chat_format, exact_dedup, lexical, line_dedup, materialise, mixing, near_dedup, packing, quality, spelling, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.query,
        "op2_line_dedup": line_dedup.query,
        "op3_chat_format": chat_format.query,
        "op4_toxicity": toxicity.query,
        "op5_exact_topk": topk.query,
        "op6_quality": quality.query,
        "op7_training_order": materialise.query,
        "op8_packing": packing.query,
        "op9_exact_dedup": exact_dedup.query,
        "op10_near_dedup": near_dedup.query,
        "op11_lexical_search": lexical.query,
        "op12_spelling_variants": spelling.query,
        "op13_best_fit_packing": best_fit.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": mixing.SQL, "op2_line_dedup": line_dedup.SQL, "op3_chat_format": chat_format.SQL, "op5_exact_topk": topk.SQL, "op9_exact_dedup": exact_dedup.SQL,
        "op11_lexical_search": lexical.SQL, "op12_spelling_variants": spelling.SQL,
    }
