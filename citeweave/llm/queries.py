"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, chat, mixing, neardup, packing, pii, quality, repair, simhash, substrings, tokenfile, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": pii.query,
        "op2_chat": chat.query,
        "op3_toxicity": toxicity.query,
        "op4_topk": topk.query,
        "op5_substrings": substrings.query,
        "op6_packing": packing.query,
        "op7_neardup": neardup.query,
        "op8_tokenfile": tokenfile.query,
        "op9_quality": quality.query,
        "op10_mixing": mixing.query,
        "op11_simhash": simhash.query,
        "op12_repair": repair.query,
        "op13_centroids": centroids.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": chat.SQL, "op4_topk": topk.SQL, "op7_neardup": neardup.SQL, "op9_quality": quality.SQL, "op10_mixing": mixing.SQL, "op12_repair": repair.SQL, "op13_centroids": centroids.SQL}
