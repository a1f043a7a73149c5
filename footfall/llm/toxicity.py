"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, marks off, letters of other scripts and digits that look like Latin
letters replaced by them. The lexicon is learned from labelled documents: a word's evidence is the
number of different neighbourhoods (word before, word after) it was seen in, so copies of a text count
once; its weight is the log ratio of its rates in toxic and clean text. A phrase (neighbour and
lexicon word) that clean text holds and toxic text doesn't is an exception and doesn't count.
One Aho-Corasick automaton finds lexicon words and exceptions in one pass over the folded text.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import Memo, held_out, in_tasks, keep_only, slices, stored, texts, worker_cache

# Signs that look like a Latin letter
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ո": "n", "α": "a", "ε": "e", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ß": "ss", "ł": "l", "ø": "o", "đ": "d",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}

#: Labelled documents to learn from, at most about so many of either class (chosen by a hash of the id).
LEARN_FROM = 10_000
#: A lexicon word has this much evidence (likelihood ratio) and is this much commoner in toxic text.
EVIDENCE, RATIO = 30.0, 8.0
#: Letters of a stem, and how much commoner it is in toxic text; it stands for several words and is written with a star.
STEM, STEM_RATIO = (5, 9), 40.0
#: An exception phrase was seen in so many clean documents at least, and in no toxic one.
EXCEPTION_SEEN = 3
#: Score 1 - exp(-STEEPNESS * weights per hundred words); short texts count as a little longer.
STEEPNESS, SHORT = 0.3, 50
CLEAN_LIMIT = 0.3

_WORD = re.compile(r"[^\W_]+(?:[@$!][^\W_]+)*")
_MIXED = re.compile(r"[@$!0-9]")
_PLAIN = re.compile(r"[a-z]+")


def _fold_word(word: str) -> str:
    if _PLAIN.fullmatch(word):
        return word
    flat = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    flat = "".join(LOOKALIKES.get(c, c) for c in flat)
    if _MIXED.search(flat) and any(c.isalpha() for c in flat):  # digits are letters only beside letters
        flat = "".join(DIGITS.get(c, c) for c in flat)
    return flat


_FOLDED: dict[str, Memo] = worker_cache()


def folded_words(rows: list[str]) -> list[list[str]]:
    """The words of each text in lower case, folded; all else is a word border."""
    keep_only(_FOLDED)
    memo = _FOLDED.setdefault("words", Memo(200_000))
    split = [_WORD.findall(x.lower()) for x in rows]
    return memo.look_up(split, lambda new: [_fold_word(w) for w in new])


class Matcher:
    """Sum of lexicon weights in a text, without those inside an exception phrase."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term, weight in weights.items():
            key = f" {term[:-1]}" if term.endswith("*") else f" {term} "
            self.automaton.add_word(key, (len(key), weight))
        for phrase in exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
        self.empty = not (weights or exceptions)
        if not self.empty:
            self.automaton.make_automaton()

    def weigh(self, words: list[str]) -> tuple[float, int]:
        """(weights, hits) of folded words; a word that is found as itself and by its stem counts once, with the larger weight."""
        if self.empty or not words:
            return 0.0, 0
        found, excused = {}, []
        for end, (size, weight) in self.automaton.iter(f" {' '.join(words)} "):
            start = end - size + 1
            if weight is None:
                excused.append((start, end))
            elif found.get(start, (0.0,))[0] < weight:
                found[start] = (weight, end)
        hits = [w for start, (w, end) in found.items() if not any(a <= start and end <= b for a, b in excused)]
        return sum(hits), len(hits)


def score_of(weight: float, words: int) -> float:
    return 1.0 - math.exp(-STEEPNESS * 100.0 * weight / (words + SHORT))


def learn(docs: DataFrame, labels: DataFrame, learn_from: int = LEARN_FROM) -> tuple[dict[str, float], list[str]]:
    """(weight by word, exception phrases) from labelled documents that aren't held out.

    Each class gives at most about `learn_from` documents, chosen by a hash of the id.
    """
    marked = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic_"))
    sizes = {r["toxic_"]: r["n"] for r in marked.groupBy("toxic_").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return {}, []
    share = {k: min(1.0, learn_from / n) for k, n in sizes.items()}
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.when(F.col("toxic_") == 1, int(share[1] * (1 << 20))).otherwise(int(share[0] * (1 << 20)))
    sample = docs.select("doc_id", "text").join(F.broadcast(marked.where(pick)), "doc_id")  # bounded by learn_from

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            words, before, after, toxic = [], [], [], []
            for row, label in zip(folded_words(texts(batch)), batch.column("toxic_").to_pylist(), strict=True):
                seen = set(zip(row, ["", *row], [*row[1:], ""], strict=False))
                for word, left, right in seen:
                    words.append(word)
                    before.append(left)
                    after.append(right)
                toxic += [label] * len(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(before, pa.string()), pa.array(after, pa.string()), pa.array(toxic, pa.int32())],
                ["word", "before", "after", "toxic"],
            )

    seen = sample.select("text", "toxic_").transform(in_tasks, run, "word string, before string, after string, toxic int")
    # one row per neighbourhood first: copies meet before they are counted
    around = seen.groupBy("word", F.xxhash64("before", "after").alias("around_")).agg(
        F.max("toxic").alias("t"), F.max(1 - F.col("toxic")).alias("c")
    )
    around = around.select("word", "t", "c").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    around = stored(around, "words")
    total = around.agg(F.sum("t"), F.sum("c"))
    all_toxic, all_clean = (float(x or 0) + 1.0 for x in total.first())
    lengths = F.filter(F.sequence(F.lit(STEM[0]), F.lit(STEM[1])), lambda n: n < F.length("word"))
    stems = around.select("word", "t", "c", F.explode(lengths).alias("n")).groupBy(F.substring("word", F.lit(1), F.col("n")).alias("word"))
    stems = stems.agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count("*").alias("forms")).where("forms > 1")

    def chosen(terms: DataFrame, ratio: float) -> DataFrame:
        """Terms with enough evidence; it is paid from the bounded sample, so there is a bound to them."""
        t, c, share = F.col("t"), F.col("c"), F.lit(all_toxic / (all_toxic + all_clean))
        rate = (t + 0.5) / F.lit(all_toxic) * F.lit(all_clean) / (c + 0.5)
        part = lambda n, p: F.when(n > 0, n * F.log(n / ((t + c) * p))).otherwise(0.0)
        evidence = 2 * (part(t, share) + part(c, 1 - share))
        return terms.where((t > 0) & (rate >= ratio) & (evidence >= EVIDENCE)).select("word", F.log(rate).alias("weight"))

    words = {r["word"]: r["weight"] for r in chosen(around, RATIO).collect()}
    roots = {r["word"]: r["weight"] for r in chosen(stems, STEM_RATIO).collect()}
    # of stems that begin alike the shortest stands; it covers the others
    roots = {w: x for w, x in roots.items() if not any(w[:n] in roots for n in range(STEM[0], len(w)))}
    weights = {**words, **{f"{w}*": x for w, x in roots.items()}}
    if not weights:
        return {}, []
    spark = sample.sparkSession
    begun = F.array(*[F.substring("word", 1, n) for n in range(STEM[0], STEM[1] + 1)])
    known = F.broadcast(spark.createDataFrame([(w,) for w in roots], "root string"))
    formed = around.select("word", F.explode(begun).alias("root")).join(known, "root", "left_semi").select("word")
    lexicon = spark.createDataFrame([(w,) for w in words], "word string").unionByName(formed).distinct()
    hits = seen.join(lexicon, "word")
    pairs = hits.select(F.concat_ws(" ", "before", "word").alias("phrase"), "toxic", F.col("before").alias("next")).unionByName(
        hits.select(F.concat_ws(" ", "word", "after").alias("phrase"), "toxic", F.col("after").alias("next"))
    )
    excused = pairs.where("next <> ''").groupBy("phrase").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    return weights, sorted(r["phrase"] for r in excused.where((F.col("t") == 0) & (F.col("c") >= EXCEPTION_SEEN)).collect())


def score(docs: DataFrame, weights: dict[str, float], exceptions: list[str]) -> DataFrame:
    """(doc_id, n_hits, weight, score, predicted) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(weights, exceptions)
        for batch in slices(batches):
            hits, sums, scores = [], [], []
            for words in folded_words(texts(batch)):
                weight, found = matcher.weigh(words)
                hits.append(found)
                sums.append(weight)
                scores.append(score_of(weight, len(words)))
            predicted = [int(s >= CLEAN_LIMIT) for s in scores]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(hits, pa.int64()), pa.array(sums, pa.float64()), pa.array(scores, pa.float64()), pa.array(predicted, pa.int32())],
                ["doc_id", "n_hits", "weight", "score", "predicted"],
            )

    return docs.select("doc_id", "text").transform(in_tasks, run, "doc_id long, n_hits long, weight double, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled documents that aren't held out, then score all.

    `docs` has doc_id and text, `labels` doc_id and toxic; other columns are not looked at. Null and empty texts
    have no hit and score 0. Several labels of one document count as toxic if one is. Without labels of both
    classes nothing is learned and all score 0. Repeated rows give repeated results.
    """
    weights, exceptions = learn(docs, labels)
    scored = score(docs, weights, exceptions)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_hits", "weight")
