"""The registered queries of the text operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from footfall.llm import contamination, html_text, language, lm_scores, packing, pieces, prefix_trie, quality, simhash, sketches, toxicity, url_rules, whitening
from footfall.llm.checking_sql import CONVERSATION_TRIE, DECONTAMINATION
from footfall.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {"op11_decontamination": DECONTAMINATION, "op13_conversation_trie": CONVERSATION_TRIE}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir, "doc_id", "text"), corpus_pipeline.TOKENIZER)


@query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", simhash.fingerprint_text().alias("fingerprint"), "component_id")


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.toxicity(documents(spark, sf_dir, "doc_id", "text"), labels)


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir, "doc_id", "text", "lang"))


@query
def op1_paragraph_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprint_versions(documents(spark, sf_dir, "doc_id", "text"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    judged = quality.judge(documents(spark, sf_dir, "doc_id", "text", "lang"), labels, ["doc_id"])
    return judged.select("doc_id", *quality.FEATURES, "base_failed", "kept", "loss", "low", "high")


@query
def op7_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return lm_scores.score_by_labels(documents(spark, sf_dir, "doc_id", "text"), labels)


@query
def op5_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


@query
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


@query
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contamination.digests(contamination.find(documents(spark, sf_dir, "doc_id", "text"), benchmark, ["doc_id"]))


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return found.withColumn("deviation", found["deviation"].cast("long"))


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_trie.trie(prefix_trie.branched(turns))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
