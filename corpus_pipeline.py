"""A training corpus from raw documents: five of the operators in cadenza.llm in a row.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import bpe, linededup, mixing, quality, simhash
from cadenza.llm.common import bounded_batches, settled, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    with bounded_batches(spark):
        return quality.good_documents(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat others go; n_chars is that of the text that stays."""
    with bounded_batches(spark):
        left = linededup.dedup_lines(docs)
    return left.selectExpr(*("CAST(char_length(text) AS BIGINT) AS n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    with bounded_batches(spark):
        return simhash.without_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as ids: doc_id, n_tokens, ids_sha256, decoded_sha256, ids; a row for each time
    that the mixture takes a document."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with bounded_batches(spark):
        return stored(bpe.encode_decode(docs, path, public_tokenizers.PATTERN, with_ids=True), "pipeline-ids")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("byte-level BPE", encoding_stage),
]

#: The stages hash, sketch and tokenize in ways that SQL can't express; tests hold each of them
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(functools.partial(stage, spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
