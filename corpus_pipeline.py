"""From raw documents to packed training sequences, one stage after the other.

Each stage works on all that the one before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from footfall.llm import language, packing, quality, simhash
from footfall.llm.common import stored

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Words of a shingle and most differing bits of a link, as in op9.
SHINGLE, RADIUS = 3, 2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or unlike all languages that were learned, go."""
    return language.keep_known(docs)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that fail the base rules or lie outside their language's perplexity band go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of at most two differing fingerprint bits connect, the one with the least id stays."""
    return simhash.keep_one(docs, SHINGLE, RADIUS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with the sequence and the place where each lies."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_dedup", drop_near_duplicates),
    ("best_fit_packing", pack_sequences),
]

#: Models and fingerprints can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; what a stage keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
