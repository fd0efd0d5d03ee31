"""The queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, clusters, language, packing, quality, recompression, runs, secrets, simhash, suffix, tokens, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _on(name: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(table(spark, sf_dir, name))


QUERIES: dict[str, Query] = {
    "op1_fingerprints": _on("documents", simhash.op1_fingerprints),
    "op2_suffix_dedup": _on("documents", suffix.op2_suffix_dedup),
    "op3_packing": _on("documents", packing.op3_packing),
    "op4_quality": _on("documents", quality.op4_quality),
    "op5_toxicity": lambda spark, sf_dir: toxicity.op5_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op6_tool_calls": _on("conversations", chat.op6_tool_calls),
    "op7_near_dedup": _on("documents", simhash.op7_near_dedup),
    "op8_sentencepiece": _on("documents", tokens.op8_sentencepiece),
    "op9_secrets": _on("documents", secrets.op9_secrets),
    "op10_language": _on("documents", language.op10_language),
    "op11_periodic_runs": _on("documents", runs.op11_periodic_runs),
    "op12_centroids": _on("embeddings", clusters.op12_centroids),
    "op13_substring_dedup": _on("documents", recompression.op13_substring_dedup),
}

ORACLES: dict[str, str] = {"op4_quality": quality.SQL, "op6_tool_calls": chat.SQL, "op12_centroids": clusters.SQL}
