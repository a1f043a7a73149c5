"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Every bit position i has a nonzero vector m(i) of radius + 1 bits, dealt round robin. For each nonzero
vector v there is a mask: the positions whose m(i) has an odd product with v. Up to `radius` differing
positions span at most `radius` dimensions, so some v is orthogonal to them all, and under its mask the
two fingerprints are equal: every pair within the radius meets in some table.

Copies fall together first, as one row per distinct fingerprint. A bucket of one is dropped and a bucket of two
is its pair; both come out of one aggregate. Small buckets are compared inside and give a forest of
links, not all pairs. A bucket of more than `SMALL` fingerprints is dealt again: the positions that its
mask leaves free are cut into radius + 1 blocks, and two members that differ in at most `radius` places agree
on one whole block. Masks only grow and the fingerprints are distinct, so buckets end up small,
and no bucket is capped or sampled on the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import in_tasks, keep_only, slices, stored, texts
from footfall.llm.components import connected

BITS = 64
SMALL = 512
SEED = 42
_RIGHT = np.arange(BITS)


def fingerprints(rows: list[str], width: int) -> np.ndarray:
    """64-bit fingerprints of texts over shingles of `width` words, repeats included; no word gives zero."""
    from xxhash import xxh64_intdigest

    hashes, sizes = [], []
    for text in rows:
        words = text.encode().lower().split()
        flat = b" ".join(words)
        ends = list(accumulate([len(w) + 1 for w in words]))
        shingles = max(len(words) - width + 1, min(len(words), 1))
        starts = [0, *ends]
        last = ends[width - 1 :] if len(words) >= width else ends[-1:]
        hashes += [xxh64_intdigest(flat[i : j - 1], SEED) for i, j in zip(starts[:shingles], last, strict=True)]
        sizes.append(shingles)
    sizes = np.array(sizes, np.int64)
    found = np.zeros(len(rows), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        begins = np.concatenate([[0], np.cumsum(sizes[full])])
        h, step = np.array(hashes, np.uint64), 1 << 15
        cut = 0
        while cut < len(full):  # texts whose shingles make about `step` rows of bits at once
            upto = max(cut + 1, int(np.searchsorted(begins, begins[cut] + step, "right")) - 1)
            counts = np.zeros((upto - cut, BITS), np.int64)
            for at in range(begins[cut], begins[upto], step):  # a very long text: in parts
                to = min(begins[upto], at + step)
                bits = np.unpackbits(h[at:to].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                inside = np.clip(begins[cut:upto] - at, 0, None)
                inside = inside[(begins[cut + 1 : upto + 1] > at) & (begins[cut:upto] < to)]
                here = np.flatnonzero((begins[cut + 1 : upto + 1] > at) & (begins[cut:upto] < to))
                counts[here] += np.add.reduceat(bits, inside, axis=0, dtype=np.int64)
            over = 2 * counts > sizes[full[cut:upto], None]
            found[full[cut:upto]] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
            cut = upto
    return found


def fingerprint_column(docs: DataFrame, width: int = 3, beside: tuple[str, ...] = ()) -> DataFrame:
    """`docs` (with doc_id and text) as (doc_id, fp: the fingerprint's bits as a signed long) and the long columns `beside`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in slices(batches):
            fp = fingerprints(texts(batch), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp), *[batch.column(c) for c in beside]], ["doc_id", "fp", *beside])

    return docs.select("doc_id", "text", *beside).transform(in_tasks, run, ", ".join(["doc_id long, fp long", *[f"{c} long" for c in beside]]))


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def covering_masks(radius: int) -> list[int]:
    """The 2^(radius+1) - 1 masks of the covering family, as unsigned numbers."""
    n = (1 << (radius + 1)) - 1
    vectors = [i % n + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vectors[i] & v).bit_count() & 1) for v in range(1, n + 1)]


def finer_masks(mask: int, radius: int) -> list[int]:
    """`mask` and, in turn, one of radius + 1 blocks of the positions it leaves free."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[b :: radius + 1]) for b in range(radius + 1)]


def forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect exactly those of a few distinct fingerprints that chains within the radius connect."""
    u = members.view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= radius
    label = np.arange(len(u))
    while True:
        low = np.where(near, label[None, :], len(u)).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    return [(int(members[i]), int(members[k])) for i, k in enumerate(label) if i != k]


def _bucket_links(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b) from buckets (bucket, fp) of at most SMALL rows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((0, 2), np.int64)

        def cut(part: np.ndarray) -> pa.RecordBatch:
            ends = np.flatnonzero(part[1:, 0] != part[:-1, 0]) + 1
            found = [x for group in np.split(part[:, 1], ends) for x in forest(np.ascontiguousarray(group), radius)]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            part = np.stack([batch.column(c).to_numpy() for c in ("bucket", "fp")], axis=1)
            part = np.concatenate([rest, part])
            if len(part):
                whole = int(np.searchsorted(part[:, 0], part[-1, 0]))
                rest = part[whole:]
                if whole:
                    yield cut(part[:whole])
        if len(rest):
            yield cut(rest)

    dealt = rows.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.transform(in_tasks, run, "a long, b long")


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """(a, b) links between distinct fingerprints (column fp) whose components are those of all pairs within `radius`."""
    spark = distinct.sparkSession
    masks = covering_masks(radius)
    table = F.array(*[F.lit(_signed(m)) for m in masks])
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a few bytes per row become many rows: spread them first
    rows = distinct.select("fp").repartition(wide, "fp").select("fp", F.explode(table).alias("mask"))
    found = None
    while True:
        # a bucket is named by a hash: where two share a name, their members are too far apart to link
        rows = rows.select(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"), "mask", "fp")
        buckets = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        buckets = stored(buckets.where("n > 1"), "buckets")
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
        pairs = buckets.where((F.col("n") == 2) & near).select("a", "b")
        # both sides grow with the documents: merged at every size, and split where a bucket is hot
        members = rows.join(buckets.where("n > 2").select("bucket", "n").hint("merge"), "bucket")
        small = _bucket_links(members.where(F.col("n") <= SMALL), radius)
        level = pairs.unionByName(small)
        found = level if found is None else found.unionByName(level)
        if not buckets.where(F.col("n") > SMALL).take(1):
            return found
        finer = [(_signed(m), [_signed(x) for x in finer_masks(m, radius)]) for m in masks]
        masks = sorted({x for m in masks for x in finer_masks(m, radius)})
        into = F.broadcast(spark.createDataFrame(finer, "mask long, into array<long>"))  # a few masks per level
        large = members.where(F.col("n") > SMALL).join(into, "mask").select("fp", F.explode("into").alias("mask"))
        rows = stored(large.distinct(), "finer")


def _grouped(prints: DataFrame, radius: int) -> DataFrame:
    """`prints` with root, the same fingerprint for a whole group, and component_id, its least doc_id."""
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    reached = stored(connected(links(classes.select("fp"), radius)), "reached")
    rooted = classes.join(reached.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "least")
    lows = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = rooted.join(lows, "root").select("fp", "root", F.col("component_id").alias("linked_id"))
    named = classes.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("linked_id", "least").alias("component_id"))
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): the least doc_id that links of at most `radius` differing bits reach.

    `docs` has doc_id and text; other columns are not looked at. Null and empty texts share the zero
    fingerprint, which is linked like any other. Repeated rows give repeated results. A null doc_id is never
    the least one; a component of null ids alone has a null id.
    """
    prints = stored(fingerprint_column(docs, width), "fingerprints")
    return _grouped(prints, radius).select("doc_id", "fp", "component_id")


def fingerprint_text(fp: str = "fp"):
    """The fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """One document of each group: the one with the least doc_id, with all its columns.

    A doc_id that comes with several texts stays once in every group where it is the least; of a group's texts with
    this doc_id the one with the least hash stays, and of equal rows one. Rows without a doc_id can't be told apart and all stay.
    """
    marked = docs.withColumn("mark_", F.xxhash64("text"))
    prints = stored(fingerprint_column(marked, width, ("mark_",)), "fingerprints")
    kept = _grouped(prints, radius).where("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "mark_")).alias("one"), F.count("*").alias("n_"))
    kept = stored(kept.select("one.*", "n_"), "kept")
    chosen = [kept.where(c).select("doc_id", "mark_").distinct().hint("merge") for c in ("n_ = 1", "n_ > 1")]
    first = marked.join(chosen[0], ["doc_id", "mark_"], "left_semi").unionByName(marked.where("doc_id IS NULL"))
    if kept.where("n_ > 1").take(1):  # repeated ids
        first = first.unionByName(marked.join(chosen[1], ["doc_id", "mark_"], "left_semi").dropDuplicates(["doc_id", "mark_"]))
    return first.select(docs.columns)
