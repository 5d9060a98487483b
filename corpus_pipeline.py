"""A corpus pipeline of five operators: quality rules, near duplicates, PII, mixing, encoding.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the
columns of documents; the last returns token counts and digests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import bpe, mixing, ngram_join, pii, quality
from tracelake.llm.common import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy rejects go."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by 5-word shingles at similarity 0.8 or more."""
    return ngram_join.keep_one(docs, 5, "0.8")


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets."""
    return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the token-prefix that fills each source's budget, in one epoch."""
    return mixing.select_documents(docs, mixing.plan(mixing.with_domain(docs), percent=80, max_epochs=1))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    return bpe.encode_digests(docs, public_tokenizers.path(bpe.RANKS))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", near_duplicates),
    ("pii", mask_pii),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has no byte-level BPE; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None
