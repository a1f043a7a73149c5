"""Benchmark decontamination: a hash set of the test items' word windows, broadcast to the tasks that scan the documents.

Words are lower-cased runs of letters, digits and everything beyond ASCII. A window is `width` consecutive words of an
item; an item of fewer words, but at least one, is one window. A task numbers the words of the windows, sees every other word
as 0, hashes runs without a 0, looks the hashes up in a bitmap and verifies what is left on the numbers of its words.

The broadcast has a bound: at most `limit` rows (window, item). More of them are dealt by hash into blocks of that size
and each block scans the documents; what the blocks found meets by the digest of the text, so that only texts with a
hit are shuffled.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.llm.common import in_tasks, keep_only, slices, stored, worker_cache

WIDTH = 10
#: Rows (window, item) of one broadcast: some 20 MB as text, some 100 MB as a worker's tables.
LIMIT = 200_000
#: Bytes of a text that are split into words at once.
PART = 1 << 20
SEED = 42
_BITS = 22

#: What each byte becomes: A-Z in lower case, a space where no word is.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
HITS = "array<struct<start:int,end:int>>"
_INDEX = worker_cache()


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in parts of about PART bytes."""
    folded = text.translate(_FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + PART) if len(folded) - at > PART else -1
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct (window, item) of `items` (item_id, text): words joined by one space, and the id as text, a null id as the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in slices(batches, 64):
            for item, text in zip(batch.column("item").to_pylist(), _utf8(batch, "text"), strict=True):
                rest, whole = [], True
                for part in words_of(text):
                    rest += part
                    if len(rest) >= width:
                        whole = False
                        found = [b" ".join(rest[i : i + width]).decode() for i in range(len(rest) - width + 1)]
                        rest = rest[len(rest) - width + 1 :]
                        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([item] * len(found), pa.string())], ["window", "item"])
                if whole and rest:
                    yield pa.RecordBatch.from_arrays([pa.array([b" ".join(rest).decode()]), pa.array([item], pa.string())], ["window", "item"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return named.transform(in_tasks, run, "window string, item string").distinct()


class Index:
    """The windows of one block, ready to be met by documents."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.numbers: dict[bytes, int] = {}
        by_window: dict[str, list[str]] = {}
        for window, item in rows:
            by_window.setdefault(window, []).append(item)
        self.by_length: dict[int, tuple[np.ndarray, dict[bytes, tuple[str, ...]]]] = {}
        for window, items in by_window.items():
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in window.encode().split(b" ")], np.int32)
            self.by_length.setdefault(len(ids), ({}, {}))[1][ids.tobytes()] = tuple(items)
        longest = max(self.by_length, default=0)
        self.times = np.random.default_rng(SEED).integers(0, 1 << 63, max(longest, 1), dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        for length, (_, known) in self.by_length.items():
            ids = np.frombuffer(b"".join(known), np.int32).reshape(-1, length)
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[self._places(ids.T, length)] = True
            self.by_length[length] = (bitmap, known)

    def _places(self, columns: Iterator[np.ndarray], length: int) -> np.ndarray:
        total = np.uint64(0)
        for k, column in zip(range(length), columns, strict=False):
            total = total + column.astype(np.uint64) * self.times[k]
        return total >> np.uint64(64 - _BITS)

    def number(self, text: bytes) -> np.ndarray:
        get = self.numbers.get
        parts = [np.fromiter(map(get, words, repeat(0)), np.int32, len(words)) for words in words_of(text)]
        return np.concatenate(parts) if parts else np.empty(0, np.int32)

    def scan(self, docs: list[np.ndarray]) -> tuple[np.ndarray, list[dict[int, None]], np.ndarray]:
        """(where each document starts in one row of words with a 0 after each, its items, which words are hit)."""
        starts = np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs])]).astype(np.int64)
        ids = np.zeros(starts[-1], np.int32)
        for at, d in zip(starts, docs, strict=False):
            ids[at : at + len(d)] = d
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        steps = np.zeros(len(ids) + 1, np.int32)
        items: list[dict[str, None]] = [{} for _ in docs]
        for length, (bitmap, exact) in self.by_length.items():
            at = np.flatnonzero(known[length:] - known[:-length] == length)
            if len(at):
                at = at[bitmap[self._places((ids[at + k] for k in range(length)), length)]]
            for i, doc in zip(at.tolist(), (np.searchsorted(starts, at, "right") - 1).tolist(), strict=True):
                found = exact.get(ids[i : i + length].tobytes())
                if found:
                    steps[i] += 1
                    steps[i + length] -= 1
                    items[doc].update(dict.fromkeys(found))
        return starts, items, np.cumsum(steps[:-1]) > 0


def _index(name: str, sent: Broadcast) -> Index:
    """The index of a broadcast, made once per worker."""
    keep_only(_INDEX)
    if name not in _INDEX:
        _INDEX.clear()
        _INDEX[name] = Index(sent.value)
    return _INDEX[name]


def _runs(hit: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _scanned(docs: DataFrame, rows: list[tuple[str, str]]) -> DataFrame:
    """`docs` with n_words, hits and item_ids, from one block of windows."""
    sent, name = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex
    columns = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, sent)
        runs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches):
            numbered = [index.number(x) for x in _utf8(batch, "text")]
            starts, items, hit = index.scan(numbered)
            hits = [_runs(hit[a : b - 1]) if found else [] for a, b, found in zip(starts, starts[1:], items, strict=False)]
            new = [pa.array([len(x) for x in numbered], pa.int64()), pa.array(hits, runs), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *new], [*columns, "n_words", "hits", "item_ids"])

    kinds = T.StructType([docs.schema[c] for c in columns])
    extra = T.StructType.fromDDL(f"n_words long, hits {HITS}, item_ids array<string>")
    return in_tasks(docs, run, T.StructType([*kinds.fields, *extra.fields]))


def _united(rows: DataFrame) -> DataFrame:
    """One row per digest, with the runs and items of all blocks."""
    met = rows.groupBy("digest").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_set("item_ids")).alias("item_ids"))
    first = F.aggregate(
        F.array_sort("hits"),
        F.array().cast(HITS),
        lambda done, x: F.when(
            F.get(done, F.size(done) - 1)["end"] >= x["start"],
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.get(done, F.size(done) - 1)["start"].alias("start"), F.greatest(F.get(done, F.size(done) - 1)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    return met.select("digest", first.alias("hits"), F.array_sort(F.array_distinct("item_ids")).alias("item_ids"))


def find(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, width: int = WIDTH, limit: int = LIMIT) -> DataFrame:
    """The columns `keep` of `docs` (default all) with n_words, hits (runs of word numbers: start, and end that isn't hit) and item_ids (sorted).

    `docs` has text, `items` has item_id and text; other columns are not looked at, and result columns replace
    columns of `docs` with their names. A null or empty text has no words, and an item without words no window. Repeated rows of an item are one
    item, repeated documents have repeated results, a null item_id counts as the empty text. Without items
    nothing is hit.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "hits", "item_ids")]
    table = stored(windows(items, width), "windows")
    n = table.count()
    chosen = docs.select(*keep, *[F.col("text")] * ("text" not in keep))
    if n <= limit:
        found = _scanned(chosen.withColumn("text_", F.col("text")) if "text" in keep else chosen, _collected(table))
        return found.withColumnRenamed("text_", "text").select(*keep, "n_words", "hits", "item_ids")
    blocks = -(-2 * n // limit)  # by hash: half full on average, so that none passes the limit
    dealt = stored(table.withColumn("block", F.pmod(F.xxhash64("window", "item"), F.lit(blocks))).repartitionByRange(blocks, "block"), "blocks")
    texts = docs.select("text").withColumn("digest", _digest())
    parts = [_scanned(texts, _collected(dealt.where(F.col("block") == b))).where("size(hits) > 0").select("digest", "hits", "item_ids").distinct() for b in range(blocks)]
    met = None
    for part in parts:
        part = stored(part, "block_hits")
        met = part if met is None else met.unionByName(part)
    counted = _scanned(chosen.withColumn("digest", _digest()).withColumn("text_", F.col("text")), []).drop("hits", "item_ids")
    joined = counted.join(stored(_united(met), "hits").hint("merge"), "digest", "left").drop("text").withColumnRenamed("text_", "text")
    nothing = {"hits": HITS, "item_ids": "array<string>"}
    return joined.select(*keep, "n_words", *[F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in nothing.items()])


def _digest() -> Column:
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)


def _collected(block: DataFrame) -> list[tuple[str, str]]:
    """A block of at most `limit` short rows."""
    found = block.select("window", "item").toArrow()
    return list(zip(found.column("window").to_pylist(), found.column("item").to_pylist(), strict=True))


def without(text: str, hits: list) -> str:
    """A text without the characters from each run's first to its last word; what is left is joined by one space."""
    spans = [m.span() for m in _WORD.finditer(text)]
    cuts = [(spans[r["start"]][0], spans[r["end"] - 1][1]) for r in hits]
    ends = [0, *[b for _, b in cuts]]
    kept = [text[a:b].strip() for a, b in zip(ends, [*[a for a, _ in cuts], len(text)], strict=True)]
    return " ".join(x for x in kept if x)


def remove(docs: DataFrame, items: DataFrame, whole: bool = False, width: int = WIDTH, limit: int = LIMIT) -> DataFrame:
    """`docs` with clean texts: hit documents go (`whole`), or only their hit spans go. All columns stay; untouched texts, null too, stay as they are."""
    found = find(docs.withColumnRenamed("item_ids", "item_ids_").withColumnRenamed("hits", "hits_").withColumnRenamed("n_words", "n_words_"), items, None, width, limit)
    clean = found.where("size(hits) = 0")
    if not whole:
        cut = F.udf(without, "string")  # for the few texts that are hit
        clean = clean.unionByName(found.where("size(hits) > 0").withColumn("text", cut("text", "hits")))
    back = clean.drop("n_words", "hits", "item_ids")
    for c in ("item_ids", "hits", "n_words"):
        if c in docs.columns:
            back = back.withColumnRenamed(f"{c}_", c)
    return back.select(docs.columns)


def digests(found: DataFrame) -> DataFrame:
    """The columns of `find` as numbers and a digest of the sorted items."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )
