"""Scores by cross-entropy difference.

Two n-gram models of the same order, smoothing and vocabulary: the target's is counted on the documents
that are known to be good, the background's on all documents. The vocabulary is every character of
the corpus, counted by Spark, and the border; what only a target from elsewhere has counts as the rarest one. A document's score is the mean over its
tokens of the background's loss less the target's: above 0, it reads more like the target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm import ngrams
from footfall.llm.common import held_out, in_tasks, slices, stored

def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every whole text; losses are per token.

    `docs` has doc_id and text, `target` has text. A text's tokens are its characters and the end border; null
    and empty texts have none and score 0. Without a target text all score 0. Repeated rows are counted and
    scored as often as they occur.
    """
    encode = ngrams.speller(ngrams.alphabet(docs))
    mark = lambda df, a, b: df.select("text", F.lit(a).alias("target"), F.lit(b).alias("background"))
    both = [ngrams.counted(mark(df, *m), encode, ["target", "background"]) for df, m in ((docs, (False, True)), (target, (True, False)))]
    counts = stored(both[0].unionByName(both[1]), "ngrams")
    models = [ngrams.model_of(counts, m) for m in ("target", "background")]
    if models[0] is None:
        models = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            sizes, sums = np.array([len(x) + 1 for x in texts], np.int64), [np.zeros(len(texts))] * 2
            if models and texts:
                _, sums = ngrams.text_losses(models, encode(texts))
            tokens = np.where(sizes > 1, sizes, 0)
            target, background = (np.where(tokens > 0, s / np.maximum(sizes, 1), 0.0) for s in sums)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(tokens), pa.array(target), pa.array(background), pa.array(background - target)],
                ["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
            )

    return docs.select("doc_id", "text").transform(in_tasks, run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def good_documents(labels: DataFrame) -> DataFrame:
    """The doc_id of documents that are labelled good and not held out."""
    return labels.where((F.col("quality") == 1) & ~held_out()).select("doc_id").distinct()


def score_by_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores with the documents labelled good, but not held out, as the target."""
    docs = docs.select("doc_id", "text")
    # labels grow with the documents: merged at every size, never broadcast
    return score(docs, docs.join(good_documents(labels).hint("merge"), "doc_id", "left_semi"))
