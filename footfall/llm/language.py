"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram binds its letters: their vectors, each
permuted (rotated) by its place in the n-gram, are multiplied. A text bundles its n-grams: the sum of their vectors,
each times log(1 + count). A language's prototype is the sum of its training texts' unit vectors. A text gets
the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import held_out, in_tasks, keep_only, slices, worker_cache

DIMENSIONS = 640
GRAM = 3
SEED = 2024
UNKNOWN = "und"
#: Three standard deviations of the cosine of unrelated vectors: below it any text looks like no language.
LEAST_LIKENESS = 3 / DIMENSIONS**0.5
#: Cosines grow with the number of distinct n-grams. A text must also reach this share of the median of learned texts of its
#: language and size (the bits of that number), where there are so many of them.
SHARE, LEAST_TEXTS = 0.5, 20
#: Decimals of the cosines that the median is taken of: equal ones are counted, so a median sees a bounded number of values.
DECIMALS = 5
#: Of fewer n-grams than 2 ** (TELLS - 1), a word or two, the cosine tells nothing: clean texts fall to chance as well, so they stay.
TELLS = 4
_SIZES = 32
#: Letters have codes below this; Latin letters have their own, rarer scripts share the rest.
_CODES = 4096
_UNIT = 1 << 20


class Profiler:
    """Letter codes and vectors, the same in every process."""

    def __init__(self):
        points = np.arange(0x110000)
        letter = np.array([chr(i).isalpha() for i in range(0x110000)])
        folded = np.where(points < 0x250, points, 0x250 + points % (_CODES - 0x250))
        self.code = np.where(letter, folded, 0).astype(np.int64)  # 0: no letter, a word border
        vectors = np.random.default_rng(SEED).integers(0, 2, (_CODES, DIMENSIONS), dtype=np.int8) * 2 - 1
        self.placed = [np.roll(vectors, GRAM - 1 - k, axis=1) for k in range(GRAM)]

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams (one number each) and their counts; runs of other signs are one border."""
        codes = self.code[np.frombuffer(text.lower().encode("utf-32-le"), "<u4")]
        codes = np.concatenate([[0], codes, [0]])
        codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
        if len(codes) < GRAM:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        packed = np.zeros(len(codes) - GRAM + 1, np.int64)
        for k in range(GRAM):
            packed = packed * _CODES + codes[k : len(codes) - GRAM + 1 + k]
        return np.unique(packed, return_counts=True)

    def vector(self, text: str) -> np.ndarray | None:
        """The text's bundle with length one; None if it has no letter."""
        return self.sized(text)[0]

    def sized(self, text: str) -> tuple[np.ndarray | None, int]:
        """The vector and the size: the bits of the number of distinct n-grams."""
        grams, counts = self.grams(text)
        if not len(grams):
            return None, 0
        bundle = np.zeros(DIMENSIONS, np.float32)
        weights = np.log1p(counts).astype(np.float32)
        for at in range(0, len(grams), 4096):  # bounded memory for texts of any length
            part = grams[at : at + 4096]
            bound = None
            for k in range(GRAM):
                x = self.placed[k][part // _CODES ** (GRAM - 1 - k) % _CODES]
                bound = x if bound is None else np.multiply(bound, x, out=bound)
            bundle += weights[at : at + 4096] @ bound.astype(np.float32)
        norm = float(np.linalg.norm(bundle))
        return (bundle / norm if norm else None), min(len(grams).bit_length(), _SIZES - 1)


_PROFILER: dict[str, Profiler] = worker_cache()


def profiler() -> Profiler:
    keep_only(_PROFILER)
    if "profiler" not in _PROFILER:
        _PROFILER["profiler"] = Profiler()
    return _PROFILER["profiler"]


def training_texts(docs: DataFrame) -> DataFrame:
    """(text, lang) of all texts with a lang that aren't held out."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("text", "lang")


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, unit prototypes) from all training texts.

    Tasks send their sums as whole numbers, so the prototypes don't depend on the order of tasks.
    What reaches the driver is one vector per language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, sums = profiler(), {}
        for batch in slices(batches):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                v = tool.vector(text)
                if v is not None:
                    sums.setdefault(lang, np.zeros(DIMENSIONS, np.int64))
                    sums[lang] += np.round(v * _UNIT).astype(np.int64)
        rows = [pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(rows, ["lang", "total"])

    parts = training_texts(docs).transform(in_tasks, run, "lang string, total array<long>").select("lang", F.posexplode("total").alias("at", "x"))
    totals = parts.groupBy("lang", "at").agg(F.sum("x").alias("x")).collect()
    languages = sorted({r["lang"] for r in totals})
    place = {lang: i for i, lang in enumerate(languages)}
    found = np.zeros((len(languages), DIMENSIONS))
    for r in totals:
        found[place[r["lang"]], r["at"]] = r["x"]
    norms = np.linalg.norm(found, axis=1, keepdims=True)
    return languages, found / np.where(norms > 0, norms, 1)


def predict(docs: DataFrame, languages: list[str], prototypes: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text; the score is the cosine, not below 0."""
    prototypes = prototypes.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = profiler()
        for batch in slices(batches):
            names, scores = [], []
            for text in batch.column("text").to_pylist():
                v = tool.vector(text) if text and languages else None
                if v is None:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    near = prototypes @ v
                    best = int(near.argmax())
                    names.append(languages[best])
                    scores.append(min(1.0, max(0.0, float(near[best]))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    return docs.select("doc_id", "text").transform(in_tasks, run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the documents that aren't held out.

    `docs` has doc_id, text and lang; other columns are not looked at. Null texts and texts without a letter are
    `und` with score 0, and so are all texts if there is nothing to learn from. Of equal cosines the first
    language by name wins. Repeated rows give repeated results; a null doc_id is not held out.
    """
    found = predict(docs, *learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def least_likeness(docs: DataFrame, languages: list[str], prototypes: np.ndarray) -> np.ndarray:
    """Per language and size the least cosine of a text that looks like the language, from all training texts; it doesn't fall with the size.

    Sizes with few training texts of a language go by those of all languages, or else by the smaller sizes.
    """
    limits = np.full((len(languages), _SIZES), LEAST_LIKENESS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = profiler()
        for batch in slices(batches):
            found = [(lang, *tool.sized(text)) for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            found = [(lang, size, float((prototypes @ v).max())) for lang, v, size in found if v is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.int32(), pa.float64()))], ["lang", "size", "near"])

    near = training_texts(docs).transform(in_tasks, run, "lang string, size int, near double")
    each = near.groupBy("lang", "size", F.round("near", DECIMALS).alias("near")).agg(F.count("*").alias("n"))
    both = each.unionByName(each.withColumn("lang", F.lit(None).cast("string")))
    middles = both.groupBy("lang", "size").agg(F.sum("n").alias("n"), F.percentile("near", F.lit(0.5), F.col("n")).alias("middle"))
    rows = middles.where(F.col("n") >= LEAST_TEXTS).collect()
    middle = {(r["lang"], r["size"]): r["middle"] for r in rows}
    for i, lang in enumerate(languages):
        for size in range(_SIZES):
            usual = middle.get((lang, size), middle.get((None, size), 0.0))
            limits[i, size] = max(limits[i, max(0, size - 1)], SHARE * usual if size >= TELLS else 0.0)
    limits[:, :TELLS] = -1.0
    return limits


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose text looks like a learned language; of texts with a few letters, too few to tell, all stay."""
    languages, prototypes = learn(docs)
    if not languages:
        return docs.limit(0)
    prototypes = prototypes.astype(np.float32)
    limits = least_likeness(docs, languages, prototypes)
    schema = docs.schema

    def known(vector: np.ndarray | None, size: int) -> bool:
        if vector is None:
            return False
        near = prototypes @ vector
        best = int(near.argmax())
        return float(near[best]) >= limits[best, size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = profiler()
        for batch in slices(batches):
            keep = [bool(x) and known(*tool.sized(x)) for x in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.transform(in_tasks, run, schema)
