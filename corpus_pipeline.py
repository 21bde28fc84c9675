"""Corpus preparation pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents; all but the last
return the columns of documents.

1. language: documents without a letter, or that no learned language explains
   to a share of 0.2, go.
2. lines: lines that an earlier line repeats within one word go, and documents
   that consist of such lines only.
3. near duplicates: of each group linked by a similarity of 0.8 over five-word
   shingles the smallest doc_id stays.
4. mixing: documents are taken as often as the mix of sources asks (0 to 3
   times, as repeated rows).
5. tokens: doc_id, lang, source, n_tokens and the ids of each document.

Every stage learns and decides from all rows of its input. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventlab.llm import bpe, language, line_dedup, mixing, near_dedup
from eventlab.sources.files import read_table, stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.unrepeated_documents(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(docs, ["doc_id", "lang", "source"], ["n_tokens", "ids"])


STAGES = [("language", identify_language), ("lines", dedup_lines), ("near duplicates", dedup_documents),
          ("mixing", mix), ("tokens", encode)]

#: Mixture inference, set similarity joins and dependent rounding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
