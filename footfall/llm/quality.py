"""Quality rules with n-gram perplexity.

First the base rules: enough words, not mostly repeated three-word windows. Then a character n-gram model of
documents that are known to be good gives each text its loss per character (the logarithm of its perplexity).
Each language has a band around the median of all its texts, drawn towards the band of all languages as if LEAST_TEXTS more
of its texts lay there; a text above it reads like no good text (tables,
signs, noise), one below like a pattern. The band is WIDTH robust deviations to either side, more for short
texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.llm import ngrams
from footfall.llm.common import held_out, in_tasks, slices, stored

LEAST_WORDS = 50
#: Half the band in robust standard deviations; texts of LENGTH characters get sqrt(2) times as much.
WIDTH, LENGTH = 5.0, 1000
#: The deviation counts as this much at least; a language's band weighs against the common one as its texts against so many.
LEAST_DEVIATION, LEAST_TEXTS = 0.05, 100
_SIGNS = b"#*$%&|<>"
_OTHER_LANGUAGE = ""


def base_features(text: str) -> tuple[int, int, int, int, int]:
    """(words, code points in words, signs, repeated lines, words in three-word windows that occur again)."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    space = sum([raw.count(b) for b in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")])
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n >= 4:
        runs = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(runs)) < len(runs):
            seen = Counter(runs)
            upto = 0
            for i, run in enumerate(runs):
                if seen[run] > 1:
                    repeated += i + 3 - max(upto, i)
                    upto = i + 3
    return n, len(text) - space, len(raw) - len(raw.translate(None, _SIGNS)), len(lines) - len(set(lines)), repeated


FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_ADDED = [*FEATURES, "base_failed", "loss", "low", "high", "kept"]


def reference_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The texts of all documents labelled good and not held out."""
    good = labels.where((F.col("quality") == 1) & ~held_out() & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    # labels grow with the documents: merged at every size, never broadcast
    return docs.select("doc_id", "text").join(good.hint("merge"), "doc_id", "left_semi").select("text")


def train(texts: DataFrame, encode: Callable[[list[str]], list[np.ndarray]]) -> ngrams.KneserNey | None:
    """The model of texts, or None if there is nothing to count."""
    counts = ngrams.counted(texts.withColumn("all", F.lit(True)), encode, ["all"])
    return ngrams.model_of(stored(counts, "ngrams"), "all")


def judge(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` of `docs` (default all) with the base features, base_failed, loss (per character), low, high and kept.

    `docs` has doc_id, text and lang, `labels` doc_id and quality; new columns take the place of ones with the same
    names. Null and empty texts have no word and fail. A null lang is a language of its own. Without a document labelled good the model is that of all documents.
    Repeated rows are judged alike.
    """
    spark = docs.sparkSession
    carried = [c for c in carry or docs.columns if c not in _ADDED]
    encode = ngrams.speller(ngrams.alphabet(docs))
    model = train(reference_texts(docs, labels), encode) or train(docs.select("text"), encode)
    place = {c: f"c{i}" for i, c in enumerate(carried)}  # columns that differ in case only don't clash
    names = list(place)
    plain = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in place.items()], F.col("lang").alias("language"), F.col("text").alias("whole"))
    kept_fields = [x for x in plain.schema.fields if x.name != "whole"]
    more = [T.StructField(f, T.LongType()) for f in FEATURES] + [T.StructField("loss", T.DoubleType())]
    schema = T.StructType([*kept_fields, *more])
    out = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            rows = [x or "" for x in batch.column("whole").to_pylist()]
            features = np.array([base_features(x) for x in rows], np.int64).reshape(-1, len(FEATURES))
            loss = np.zeros(len(rows))
            if model is not None and rows:
                _, (sums,) = ngrams.text_losses([model], encode(rows))
                loss = sums / np.array([len(x) + 1 for x in rows])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *[pa.array(features[:, i]) for i in range(len(FEATURES))], pa.array(loss)],
                out,
            )

    scored = stored(plain.transform(in_tasks, run, schema), "scored")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    scored = scored.withColumn("language", F.coalesce("language", F.lit(_OTHER_LANGUAGE)))
    bands = _bands(scored.where(~F.col("base_failed")).select("language", "loss"))
    if not bands:  # no text passes the base rules
        judged = scored.withColumns({"low": F.lit(0.0), "high": F.lit(0.0), "kept": F.lit(False)})
    else:
        whole = next(b for b in bands if b[0] is None)
        table = F.broadcast(spark.createDataFrame(bands, "language string, middle double, spread double"))  # a row per language
        judged = scored.join(table, "language", "left")
        half = F.lit(WIDTH) * F.coalesce("spread", F.lit(whole[2])) * F.sqrt(1 + F.lit(float(LENGTH)) / F.greatest("word_chars", F.lit(1)))
        middle = F.coalesce("middle", F.lit(whole[1]))
        judged = judged.withColumns({"low": middle - half, "high": middle + half})
        judged = judged.withColumn("kept", ~F.col("base_failed") & F.col("loss").between(F.col("low"), F.col("high")))
    return judged.select(*place.values(), *_ADDED).toDF(*names, *_ADDED)


def _medians(values: DataFrame, value: str) -> dict[str | None, tuple[float, int]]:
    """language: (median in steps of a thousandth, number of texts); exact, so the dealing of rows doesn't matter."""
    rows = values.groupBy("language").agg(F.percentile(F.round(value, 3), 0.5).alias("m"), F.count("*").alias("n")).collect()
    return {r["language"]: (r["m"], r["n"]) for r in rows}


def shrunk(own: float, common: float, n: int) -> float:
    return (n * own + LEAST_TEXTS * common) / (n + LEAST_TEXTS)


def _bands(fair: DataFrame) -> list[tuple[str | None, float, float]]:
    """(language, middle, deviation), and (None, ...) for all texts together."""
    sides = fair.unionByName(fair.select(F.lit(None).cast("string").alias("language"), "loss"))
    found = _medians(sides, "loss")
    if not found:
        return []
    middle = {x: shrunk(m, found[None][0], n) if x is not None else m for x, (m, n) in found.items()}
    table = F.broadcast(fair.sparkSession.createDataFrame(list(middle.items()), "known string, m double"))  # a row per language
    off = sides.join(table, F.col("language").eqNullSafe(F.col("known"))).select("language", F.abs(F.col("loss") - F.col("m")).alias("d"))
    spread = _medians(off, "d")
    return [(x, middle[x], max(1.4826 * (shrunk(d, spread[None][0], n) if x is not None else d), LEAST_DEVIATION)) for x, (d, n) in spread.items()]


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that pass, with their columns."""
    names = docs.columns
    plain = docs.toDF(*[f"d{i}" for i in range(len(names))])
    used = {c: f"d{names.index(c)}" for c in ("doc_id", "text", "lang")}
    plain = plain.withColumns({c: F.col(d) for c, d in used.items()})
    return judge(plain, labels, [f"d{i}" for i in range(len(names))]).where("kept").drop(*_ADDED).toDF(*names)
