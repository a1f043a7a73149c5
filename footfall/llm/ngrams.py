"""Character n-gram models with modified Kneser-Ney smoothing.

A text becomes symbols below `SYMBOLS`; an n-gram is one number, its symbols as digits. So a model has at
most SYMBOLS ** order entries whatever the corpus, which bounds the arrays that tasks get. The alphabet has every character
of the corpus, counted by Spark over all texts: the most frequent ones are one symbol each, all others a spelling of their own of
two symbols or more, the shorter the more frequent they are. Tasks count
n-grams in an array, Spark adds the counts up, and the model is stored as sorted arrays of n-gram
numbers with probabilities and back-off weights beside them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import in_tasks, keep_only, slices, worker_cache

SYMBOLS = 64
ORDER = 4
#: Symbol 0 stands before and after every text.
BORDER = 0
_ROWS = 128
_LAST = 0x110000
#: Symbols that only spell rarer characters; the others but the border are a character each.
DIGITS = 16
SINGLE = SYMBOLS - 1 - DIGITS
#: (number of first symbols, digits behind them) of spellings; the last kind has room for every character there is.
_SPELLINGS = [(9, 1), (5, 2), (1, 3), (1, 6)]


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


def alphabet(docs: DataFrame) -> str:
    """All characters of the texts, the most frequent first, ties by code point; at most as many as Unicode has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        counts = np.zeros(_LAST, np.int64)
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                if text:
                    found = np.bincount(points_of(text))
                    counts[: len(found)] += found
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], ["point", "n"])

    counted = docs.select("text").transform(in_tasks, run, "point int, n long").groupBy("point").agg(F.sum("n").alias("n"))
    return "".join(chr(r["point"]) for r in counted.orderBy(F.desc("n"), "point").collect())


def spelling(rank: int) -> list[int]:
    """The symbols of the character with this rank in the alphabet."""
    if rank < SINGLE:
        return [1 + rank]
    rank, first = rank - SINGLE, 1 + SINGLE
    for firsts, digits in _SPELLINGS:
        room = firsts * DIGITS**digits
        if rank < room:
            tail = [1 + SINGLE + rank // DIGITS**k % DIGITS for k in range(digits - 1, -1, -1)]
            return [first + rank // DIGITS**digits, *tail]
        rank, first = rank - room, first + firsts
    raise ValueError(rank)


class Speller:
    """Texts to symbols; characters outside the alphabet, which counting all texts leaves none of, count as its last one."""

    def __init__(self, letters: str):
        known = [spelling(i) for i in range(max(len(letters), 1))]
        longest = max(map(len, known))
        self.sizes = np.full(_LAST, len(known[-1]), np.uint8)
        self.codes = np.zeros((longest, _LAST), np.uint8)
        self.codes[: len(known[-1]), :] = np.array(known[-1], np.uint8)[:, None]
        for c, spelled in zip(letters, known, strict=False):
            self.sizes[ord(c)] = len(spelled)
            self.codes[: len(spelled), ord(c)] = spelled
        self.plain = longest == 1

    def __call__(self, rows: list[str]) -> list[np.ndarray]:
        return [self.one(points_of(x)) for x in rows]

    def one(self, points: np.ndarray) -> np.ndarray:
        if self.plain:
            return self.codes[0][points]
        sizes = self.sizes[points]
        ends = np.cumsum(sizes, dtype=np.int64)
        if not len(ends) or ends[-1] == len(points):
            return self.codes[0][points]
        out = np.zeros(ends[-1], np.uint8)
        starts = ends - sizes
        out[starts] = self.codes[0][points]
        for k in range(1, int(sizes.max())):
            more = np.flatnonzero(sizes > k)
            out[starts[more] + k] = self.codes[k][points[more]]
        return out


_SPELLERS = worker_cache()


def spelled(letters: str, rows: list[str]) -> list[np.ndarray]:
    """The texts' symbols; the alphabet's tables are made once per worker."""
    keep_only(_SPELLERS)
    if letters not in _SPELLERS:
        _SPELLERS.clear()
        _SPELLERS[letters] = Speller(letters)
    return _SPELLERS[letters](rows)


def speller(letters: str) -> Callable[[list[str]], list[np.ndarray]]:
    return partial(spelled, letters)


def windows(rows: list[np.ndarray], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram numbers that end at each symbol and at the end border, number of them per text)."""
    sizes = np.array([len(x) + 1 for x in rows], np.int64)
    pad = np.zeros(order - 1, np.uint8)
    flat = np.concatenate([pad, *[y for x in rows for y in (x, pad)], pad]).astype(np.int32)
    codes = np.zeros(max(0, len(flat) - order + 1), np.int32 if SYMBOLS**order < 1 << 31 else np.int64)
    for k in range(order):
        codes *= SYMBOLS
        codes += flat[k : len(flat) - order + 1 + k]
    starts = np.concatenate([[0], np.cumsum(sizes + order - 2)[:-1]])
    keep = np.zeros(len(codes) + 1, np.int32)
    np.add.at(keep, starts, 1)
    np.add.at(keep, starts + sizes, -1)
    return codes[np.cumsum(keep)[:-1] > 0], sizes


def counted(docs: DataFrame, encode: Callable[[list[str]], list[np.ndarray]], marks: list[str], order: int = ORDER) -> DataFrame:
    """(mark, code, n): how often each n-gram occurs in the texts for which the boolean column `mark` is true.

    `docs` has text and the columns `marks`; null texts hold nothing. One array of counts per mark and task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {m: np.zeros(SYMBOLS**order, np.int32) for m in marks}
        for batch in slices(batches, _ROWS):
            texts = batch.column("text").to_pylist()
            flags = {m: batch.column(m).to_pylist() for m in marks}
            for m in marks:
                rows = encode([t for t, f in zip(texts, flags[m], strict=True) if f and t])
                if rows:
                    np.add.at(counts[m], windows(rows, order)[0], 1)
        for m in marks:
            codes = np.flatnonzero(counts[m])
            for at in range(0, len(codes), 50_000):
                part = codes[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([m] * len(part), pa.string()), pa.array(part, pa.int64()), pa.array(counts[m][part], pa.int64())], ["mark", "code", "n"])

    parts = docs.select("text", *marks).transform(in_tasks, run, "mark string, code long, n long")
    return parts.groupBy("mark", "code").agg(F.sum("n").alias("n"))


class KneserNey:
    """An interpolated model with three discounts per order, as sorted arrays."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int = ORDER):
        self.order = order
        self.keys, self.probs, self.contexts, self.backoff = {}, {}, {}, {}
        levels = {order: (codes, counts.astype(np.float64))}
        for k in range(order - 1, 0, -1):  # lower orders count the different symbols before
            levels[k] = tuple(x.astype(t) for x, t in zip(np.unique(levels[k + 1][0] % SYMBOLS**k, return_counts=True), (np.int64, np.float64), strict=True))
        for k in range(1, order + 1):
            self._level(k, *levels[k])
        self.index: np.ndarray | None = None

    def _level(self, k: int, keys: np.ndarray, counts: np.ndarray) -> None:
        n = [float((counts == i).sum()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        steps = [0.0] + [min(float(i), max(0.0, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] else 0.0 for i in (1, 2, 3)]
        off = np.array(steps)[np.minimum(counts, 3).astype(int)]
        contexts, at = np.unique(keys // SYMBOLS, return_inverse=True)
        total = np.bincount(at, counts, len(contexts))
        backoff = np.bincount(at, off, len(contexts)) / total
        lower = self.probability(keys % SYMBOLS ** (k - 1), k - 1)
        self.keys[k], self.contexts[k], self.backoff[k] = keys, contexts, backoff
        self.probs[k] = (counts - off) / total[at] + backoff[at] * lower

    def probability(self, codes: np.ndarray, order: int | None = None) -> np.ndarray:
        """Of the last symbol after the ones before it; unseen n-grams back off."""
        k = self.order if order is None else order
        if k == 0:
            return np.full(len(codes), 1.0 / SYMBOLS)
        found, at = _find(self.keys[k], codes)
        out = np.empty(len(codes))
        out[found] = self.probs[k][at[found]]
        rest = codes[~found]
        if len(rest):
            lower = self.probability(rest % SYMBOLS ** (k - 1), k - 1)
            known, where = _find(self.contexts[k], rest // SYMBOLS)
            weight = np.ones(len(rest))
            weight[known] = self.backoff[k][where[known]]
            # a context that was always followed by frequent symbols has nothing left to give
            out[~found] = np.maximum(weight * lower, 1e-12)
        return out

    def losses(self, codes: np.ndarray) -> np.ndarray:
        """-ln of the probabilities. The first call lays an index from n-gram numbers into the sorted arrays."""
        if self.index is None:
            self.index = np.full(SYMBOLS**self.order, -1, np.int32)
            self.index[self.keys[self.order]] = np.arange(len(self.keys[self.order]))
            self.logs = -np.log(self.probs[self.order])
        at = self.index[codes]
        out = self.logs[at]
        new = np.flatnonzero(at < 0)
        if len(new):
            out[new] = -np.log(self.probability(codes[new].astype(np.int64)))
        return out

    def __getstate__(self):
        return {**self.__dict__, "index": None, "logs": None}


def _find(keys: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(codes), bool), np.zeros(len(codes), np.int64)
    at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
    return keys[at] == codes, at


def model_of(counts: DataFrame, mark: str, order: int = ORDER) -> KneserNey | None:
    """The model of one mark's counts (stored); None if nothing was counted. At most SYMBOLS ** order rows come to the driver."""
    rows = counts.where(F.col("mark") == mark).select("code", "n").toArrow()
    codes, n = (rows.column(c).to_numpy() for c in ("code", "n"))
    if not len(codes):
        return None
    by = np.argsort(codes)
    return KneserNey(codes[by].astype(np.int64), n[by], order)


def text_losses(models: list[KneserNey], rows: list[np.ndarray], order: int = ORDER) -> tuple[np.ndarray, list[np.ndarray]]:
    """(symbols with the end border, per model the sum of losses) of each text."""
    if not rows:
        return np.empty(0, np.int64), [np.empty(0) for _ in models]
    codes, sizes = windows(rows, order)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return sizes, [np.add.reduceat(m.losses(codes), starts) for m in models]
