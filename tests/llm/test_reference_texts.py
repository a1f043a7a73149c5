"""The model of the quality rules is counted on every good document that isn't held out."""

from pyspark.sql import functions as F

from footfall.llm import common, quality


def test_no_good_document_is_left_out(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 != 0).cast("int").alias("quality"))
    want = labels.where((F.col("quality") == 1) & ~common.held_out()).count()
    assert want > 20_000 and quality.reference_texts(docs, labels).count() == want
