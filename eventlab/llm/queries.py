"""Registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventlab.llm import (bpe, decontamination, fingerprints, language, language_model, lexical_search, line_dedup, mixing, near_dedup, prefix_trie,
                          suffix_dedup, topk, toxicity)
from eventlab.sources.files import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _on(table: str, op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: op(read_table(spark, sf_dir, table))


QUERIES: dict[str, Query] = {
    "op1_toxicity": lambda spark, sf_dir: toxicity.op1_toxicity(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")),
    "op2_line_dedup": _on("documents", line_dedup.op2_line_dedup),
    "op3_near_dedup": _on("documents", near_dedup.op3_near_dedup),
    "op4_lm_score": _on("documents", language_model.op4_lm_score),
    "op5_suffix_dedup": _on("documents", suffix_dedup.op5_suffix_dedup),
    "op6_bpe": _on("documents", bpe.op6_bpe),
    "op7_language": _on("documents", language.op7_language),
    "op8_source_mixing": _on("documents", mixing.op8_source_mixing),
    "op9_topk_search": _on("embeddings", topk.op9_topk_search),
    "op10_fingerprints": _on("documents", fingerprints.op10_fingerprints),
    "op11_lexical_search": lambda spark, sf_dir: lexical_search.op11_lexical_search(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")),
    "op12_prefix_trie": _on("conversations", prefix_trie.op12_prefix_trie),
    "op13_decontamination": lambda spark, sf_dir: decontamination.op13_decontamination(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")),
}

ORACLES: dict[str, str] = {"op2_line_dedup": line_dedup.OP2_SQL, "op9_topk_search": topk.OP9_SQL,
                           "op11_lexical_search": lexical_search.OP11_SQL,
                           "op12_prefix_trie": prefix_trie.OP12_SQL, "op13_decontamination": decontamination.OP13_SQL}
