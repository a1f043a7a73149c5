"""Document fingerprints as invertible Bloom lookup sketches.

A text falls into paragraphs: lines, and long lines are cut on after words whose last letters say so, so an
edit moves only the cuts beside it. Each paragraph's digest (with its number among equal ones) goes into one
cell of each of three subtables; a cell holds a count, the exclusive or of digests and that of
their checks. Sketches of two versions subtract cell by cell: what both hold vanishes. Peeling then takes
out cells that hold one digest until none is left; that recovers the paragraphs only one
version has. If cells remain, both are sketched again with four times the cells and another seed.

The likeness of two texts is the share of paragraphs they have in common, 2 * common / (both together).
All pairs of a slice are sketched, subtracted and peeled together as flat arrays.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from footfall.llm.common import in_tasks, keep_only

#: Cells of each of the three subtables of a fingerprint.
CELLS = 8
#: A line goes on to the next paragraph after about so many words.
WORDS = 8
_SLICE = 256

def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix (splitmix64's finisher) of `x` and a seed."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def paragraphs(text: bytes) -> list[bytes]:
    """The paragraphs of a text, without those of white space only."""
    if not text:
        return []
    a = np.frombuffer(text, np.uint8)
    line = a == 10
    cut = line.copy()
    if len(a) > 3:
        last = a[2:-1].astype(np.uint16) * 37 + a[1:-2].astype(np.uint16) * 101 + a[:-3].astype(np.uint16) * 13
        cut[3:] |= (a[3:] == 32) & ((last >> 3) % WORDS == 0)
    ends = (np.flatnonzero(cut) + 1).tolist()
    found = [text[i:j].strip() for i, j in zip([0, *ends], [*ends, len(text)], strict=True)]
    return [x for x in found if x]


def digests(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, key) of every paragraph; the n-th of equal paragraphs of a text has its own key."""
    owner, found = [], []
    for i, text in enumerate(rows):
        parts = [xxh64_intdigest(p) for p in paragraphs(text)]
        found += parts
        owner.append(np.full(len(parts), i))
    owner = np.concatenate([np.empty(0, np.int64), *owner])
    keys = np.array(found, np.uint64)
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    if not len(keys):
        return owner, keys
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])])
    starts = np.flatnonzero(new)
    nth = np.arange(len(keys)) - np.repeat(starts, np.diff([*starts, len(keys)]))
    return owner, np.where(nth > 0, _mix(keys ^ _mix(nth.astype(np.uint64), 5), 6), keys)


class Sketches:
    """Sketches number 0 to n - 1, number i with `size[i]` cells (a power of two) in each subtable."""

    def __init__(self, size: np.ndarray, seed: int):
        self.size, self.seed = size, seed
        self.base = np.concatenate([[0], np.cumsum(3 * size)])
        cells = int(self.base[-1])
        self.count, self.key, self.check = np.zeros(cells, np.int64), np.zeros(cells, np.uint64), np.zeros(cells, np.uint64)

    def places(self, owner: np.ndarray, keys: np.ndarray, table: int) -> np.ndarray:
        size = self.size[owner]
        inside = (_mix(keys, 3 * self.seed + table + 10) & (size - 1).astype(np.uint64)).astype(np.int64)
        return self.base[owner] + table * size + inside

    def add(self, owner: np.ndarray, keys: np.ndarray, signs: np.ndarray | int = 1) -> None:
        checks = _mix(keys, 3)
        for table in range(3):
            at = self.places(owner, keys, table)
            np.add.at(self.count, at, signs)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, checks)

    def minus(self, other: Sketches) -> Sketches:
        left = Sketches(self.size, self.seed)
        left.count, left.key, left.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return left

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, key, sign) of recovered digests, and which sketches are empty afterwards."""
        tables = [np.concatenate([b + t * s + np.arange(s) for b, s in zip(self.base, self.size, strict=False)] or [[]]).astype(np.int64) for t in range(3)]
        owners, keys, signs, idle, table = [], [], [], 0, 0
        while idle < 3:
            cells = tables[table]
            pure = (np.abs(self.count[cells]) == 1) & (_mix(self.key[cells], 3) == self.check[cells])
            hit = cells[pure]
            if len(hit):
                owner, key, sign = np.searchsorted(self.base, hit, "right") - 1, self.key[hit].copy(), self.count[hit].copy()
                owners.append(owner)
                keys.append(key)
                signs.append(sign)
                self.add(owner, key, -sign)
                idle = 0
            else:
                idle += 1
            table = (table + 1) % 3
            if len(keys) > 4096:  # a check that lies by chance; the sketch is then tried larger
                break
        dirty = (self.count != 0) | (self.key != 0) | (self.check != 0)
        full = np.add.reduceat(dirty, self.base[:-1]) == 0 if len(self.size) else np.empty(0, bool)
        joined = [np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((owners, np.int64), (keys, np.uint64), (signs, np.int64))]
        return (*joined, full)

    def texts(self) -> list[str]:
        """Each sketch as hex: per cell count (4 digits), digest (16) and check (4)."""
        raw = np.zeros(len(self.key), [("count", ">u2"), ("key", ">u8"), ("check", ">u2")])
        raw["count"], raw["key"], raw["check"] = self.count & 0xFFFF, self.key, self.check & np.uint64(0xFFFF)
        flat, width = raw.tobytes(), raw.itemsize
        return [flat[width * i : width * j].hex() for i, j in zip(self.base, self.base[1:], strict=False)]


def sketch(owner: np.ndarray, keys: np.ndarray, size: np.ndarray, seed: int = 0) -> Sketches:
    found = Sketches(size, seed)
    found.add(owner, keys)
    return found


def _of(owner: np.ndarray, keys: np.ndarray, bounds: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the texts `wanted`, numbered as `wanted` is."""
    sizes = bounds[wanted + 1] - bounds[wanted]
    at = np.repeat(bounds[wanted] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    return np.repeat(np.arange(len(wanted)), sizes), keys[at]


def differences(owner: np.ndarray, keys: np.ndarray, texts: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(pair, digest, sign) for pairs of texts a[i], b[i]: sign 1 where only a has the digest, -1 where only b.

    Also the number of attempts per pair. `owner` must be sorted.
    """
    bounds = np.searchsorted(owner, np.arange(texts + 1))
    left, found, tries = np.arange(len(a)), [], np.zeros(len(a), np.int64)
    cells, seed = CELLS, 0
    while len(left):
        size = np.full(len(left), cells)
        mine, theirs = (sketch(*_of(owner, keys, bounds, x[left]), size, seed) for x in (a, b))
        pair, key, sign, done = mine.minus(theirs).peel()
        tries[left] += 1
        whole = done[pair]
        found.append((left[pair[whole]], key[whole], sign[whole]))
        left = left[~done]
        cells, seed = cells * 4, seed + 1
    return (*(np.concatenate([np.empty(0, k), *(x[i] for x in found)]).astype(k) for i, k in enumerate((np.int64, np.uint64, np.int64))), tries)


def likeness(owner: np.ndarray, keys: np.ndarray, texts: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(likeness, digests that differ, attempts) of pairs of texts; two texts without paragraphs are alike."""
    pair, _, _, tries = differences(owner, keys, texts, a, b)
    counts = np.bincount(owner, minlength=texts)
    both, apart = counts[a] + counts[b], np.bincount(pair, minlength=len(a))
    return np.where(both > 0, 1 - apart / np.maximum(both, 1), 1.0), apart, tries


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_paragraphs long, n_changed long, attempts long"
)


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(ids: list, rows: list[str], ahead: str) -> pa.RecordBatch:
    n = len(rows)
    changed = [edited(x, y) for x, y in zip(rows, [*rows[1:], ahead], strict=True)]
    raw = [x.encode() for x in [*rows, ahead, *changed]]
    owner, keys = digests(raw)
    own = np.arange(n)
    prints = sketch(owner, keys, np.full(len(raw), CELLS)).texts()
    near, apart, tries = likeness(owner, keys, len(raw), np.concatenate([own, own]), np.concatenate([own + n + 1, own + 1]))
    counts = np.bincount(owner, minlength=len(raw))[:n]
    columns = [
        pa.array(ids, pa.int64()), pa.array([len(x) for x in rows], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in raw[n + 1 :]], pa.string()),
        pa.array(prints[:n], pa.string()), pa.array(prints[n + 1 :], pa.string()),
        pa.array(near[:n]), pa.array(near[n:]),
        pa.array(counts), pa.array(apart[:n]), pa.array(tries[:n]),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and order; the last rows of a bucket only look ahead to the next one."""
    keep_only()
    ids, rows, marks = [], [], []

    def upto(stop: int) -> Iterator[pa.RecordBatch]:
        start = 0
        while start < stop:
            if marks[start][1]:
                start += 1
                continue
            end = start
            while end < stop and marks[end] == marks[start]:
                end += 1
            yield _compare(ids[start:end], rows[start:end], rows[end])
            start = end

    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            part = batch.slice(at, _SLICE)
            ids += part.column("doc_id").to_pylist()
            rows += [x or "" for x in part.column("text").to_pylist()]
            marks += list(zip(part.column("bucket").to_pylist(), part.column("ahead").to_pylist(), strict=True))
            yield from upto(len(rows) - 1)
            del ids[:-1], rows[:-1], marks[:-1]


def fingerprint_versions(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited version, and how near they are.

    `docs` has doc_id and text; other columns are not looked at. The next document is that of the next doc_id
    (null first; equal ids by text), after the last the first; one document alone follows itself. Null texts
    count as empty; equal texts have equal fingerprints; an empty table gives none.

    Documents are dealt by ranges of doc_id whose bounds are ids that occur, so the first document of a range is
    known beforehand and is sent to the range before it as well: one shuffle of the texts, no join. The
    driver sees one id per range.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    wide = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = [i / wide for i in range(1, wide)]
    found = docs.agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("nulls"), F.percentile_approx("doc_id", at, 10_000).alias("cuts")).first()
    cuts = sorted({x for x in found["cuts"] or [] if x > found["low"]})
    bounds = F.array(*[F.lit(x) for x in cuts]).cast("array<long>")
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(_bucket(bounds, cuts))
    first = F.col("doc_id").isNull() if found["nulls"] else F.col("doc_id") == F.lit(found["low"])
    before = F.when(first, F.lit(len(cuts))).when(F.array_contains(bounds, F.col("doc_id")), F.col("bucket") - 1)
    rows = docs.withColumn("bucket", bucket.cast("int"))
    rows = rows.withColumn("before", before.cast("int"))
    sent = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ahead")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("ahead")))
    dealt = rows.withColumn("to", F.explode(sent)).where("to.bucket IS NOT NULL").select("to.bucket", "to.ahead", "doc_id", "text")
    dealt = dealt.repartitionById(len(cuts) + 1, F.col("bucket")).sortWithinPartitions("bucket", "ahead", "doc_id", "text")
    return dealt.transform(in_tasks, _runs, SCHEMA)


def _bucket(bounds: Column, cuts: list[int]) -> Column:
    """How many of the sorted bounds are not above doc_id: by every `step`-th first, then among the next ones."""
    step = math.isqrt(len(cuts)) + 1
    below = lambda some: F.size(F.filter(some, lambda x: x <= F.col("doc_id")))
    coarse = below(F.array(*[F.lit(x) for x in cuts[step - 1 :: step]]).cast("array<long>")) * step
    return coarse + below(F.slice(bounds, coarse + 1, step))
