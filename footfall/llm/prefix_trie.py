"""Prefix trie of conversations by truncation peeling.

A node is named by a chained digest of its turns. From the deepest level up, the conversations that end on a level meet the nodes that
survive from the level below, one row per node comes out of a grouping with all of its aggregates, and loses its last
turn to become a child on the next level.

Where few conversations share their first turns, all their levels are peeled at once inside one task: a conversation's anchor is
the least of the depths 4, 8, 16, ... whose node has at most `GROUP` turns below it, or one conversation alone. So Spark peels level
by level only as deep as larger groups share turns, however long their conversations are. Copies are one row from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import in_tasks, keep_only, stored

#: Turns of all distinct conversations below one node that a task peels on its own.
GROUP = 200_000
#: The least depth of an anchor; further ones double.
ANCHOR = 4
#: Consecutive numbers, a power of two, whose ids are joined into one piece before a node's ids are hashed.
PIECE = 512
#: Bytes of a digest.
WIDE = 16
_NONE = hashlib.sha256(b"").hexdigest()
_NODE = "key binary, parent binary, conv_id long, depth int, n_convs long, n_children long, n_leaves long, saved_tokens long, parent_conv_id long"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (key, bytes) in order) of `conversations` (conv_id, turn, role, text).

    Null turns come first. Equal turn numbers are ordered by role, then by the digest of role and text; a null role or text is empty.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text))))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", role.alias("role"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    placed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return placed.select("conv_id", F.transform("t", lambda x: F.struct(x["key"].alias("key"), x["bytes"].alias("bytes"))).alias("turns"))


def branched(conversations: DataFrame) -> DataFrame:
    """`turns` of every conversation c, its first h turns replaced by the first h of conversation c - c % 5; h = crc32(c) % 9."""
    own = stored(turns(conversations), "turns")
    heads = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    met = own.withColumn("base", F.expr("conv_id - conv_id % 5")).join(heads, "base", "left")
    first = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    return met.select("conv_id", F.concat(first, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def chains(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, depth, chain, sizes): the digests of all prefixes one after the other, the last of them, and each turn's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in batches:
            found, ends = [], []
            for keys in batch.column("keys").to_pylist():
                last, chain = b"\0" * WIDE, []
                for key in keys:
                    last = hashlib.md5(last + key, usedforsecurity=False).digest()
                    chain.append(last)
                found.append(b"".join(chain))
                ends.append(last)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(ends, pa.binary()), pa.array([len(c) // WIDE for c in found], pa.int32()), pa.array(found, pa.binary()), batch.column("sizes")], ["conv_id", "key", "depth", "chain", "sizes"])

    rows = conversations.select("conv_id", F.col("turns.key").alias("keys"), F.col("turns.bytes").alias("sizes"))
    return rows.transform(in_tasks, run, "conv_id long, key binary, depth int, chain binary, sizes array<long>")


def _prefix(depth: Column) -> Column:
    """The digest of the first `depth` turns; the root's is zero."""
    return F.when(depth == 0, F.lit(b"\0" * WIDE)).otherwise(F.substring("chain", (depth - 1) * WIDE + 1, F.lit(WIDE)))


def ends(chained: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes where conversations end: ids in numeric order, joined by commas.

    Ids are joined in pieces of PIECE numbers each, so no group is larger; a node's pieces stream through its hash in order.
    """
    pieces = chained.groupBy("key", F.shiftright("conv_id", PIECE.bit_length() - 1).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    ordered = pieces.repartition("key").sortWithinPartitions("key", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        key, sha, done = None, None, []
        for batch in batches:
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k == key:
                    sha.update(b"," + ids.encode())
                else:
                    if sha:
                        done.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(ids.encode())
            yield _hashes(done)
            done = []
        if sha:
            yield _hashes([(key, sha.hexdigest())])

    return ordered.transform(in_tasks, run, "key binary, ends_sha256 string")


def _hashes(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())], ["key", "ends_sha256"])


def anchored(distinct: DataFrame, group: int) -> DataFrame:
    """`distinct` with `anchor`: the depth from which on a task peels the conversation's levels, null if there is none."""
    deep = distinct.where(F.col("depth") >= ANCHOR)
    depths = F.filter(F.array(*[F.lit(ANCHOR << k) for k in range(26)]), lambda b: b <= F.col("depth"))
    marks = deep.select("key", "depth", "chain", F.explode(depths).alias("at"))
    marks = marks.select("key", "depth", "at", _prefix(F.col("at")).alias("node"))
    sizes = marks.groupBy("node").agg(F.sum(F.col("depth") - F.col("at") + 1).alias("turns"), F.count("*").alias("n"))
    fits = marks.join(sizes.where((F.col("turns") <= group) | (F.col("n") == 1)), "node").groupBy("key").agg(F.min("at").alias("anchor"))
    return distinct.join(fits, "key", "left")


class _Level:
    """The nodes of one level inside a task, by digest: [least id, members, children, leaves, saved below]."""

    def __init__(self):
        self.nodes: dict[bytes, list[int]] = {}
        self.sample: dict[bytes, int] = {}

    def add(self, key: bytes, row: int, low: int, n: int, children: int, leaves: int, saved: int) -> None:
        node = self.nodes.get(key)
        if node is None:
            self.nodes[key] = [low, n, children, leaves, saved]
            self.sample[key] = row
        else:
            node[0] = min(node[0], low)
            node[1] += n
            node[2] += children
            node[3] += leaves
            node[4] += saved


def peel(rows: list[tuple[int, int, bytes, list[int]]], anchor: int) -> list[tuple]:
    """The nodes at and below the anchor of distinct conversations (least id, copies, chain, sizes) that share their first `anchor` turns, deepest first."""
    at: dict[int, list[int]] = {}
    for i, (_, _, chain, _) in enumerate(rows):
        at.setdefault(len(chain) // WIDE, []).append(i)
    found, below, parents = [], {}, []
    for depth in range(max(at), anchor - 1, -1):
        level = _Level()
        for i, (low, n, leaves, saved) in parents:
            level.add(rows[i][2][(depth - 1) * WIDE : depth * WIDE], i, low, n, 1, leaves, saved)
        for i in at.get(depth, ()):
            level.add(rows[i][2][-WIDE:], i, rows[i][0], rows[i][1], 0, 0, 0)
        for j in below:
            found[j][8] = level.nodes[found[j][1]][0]
        parents, below = [], range(len(found), len(found) + len(level.nodes))
        for key, (low, n, children, leaves, saved) in level.nodes.items():
            i = level.sample[key]
            leaves, saved = leaves if children else 1, saved + (n - 1) * rows[i][3][depth - 1]
            found.append([key, rows[i][2][(depth - 2) * WIDE : (depth - 1) * WIDE], low, depth, n, children, leaves, saved, None])
            parents.append((i, (low, n, leaves, saved)))
    return found


def _groups(fitting: DataFrame) -> DataFrame:
    """All nodes at and below the anchors; those at an anchor carry the chain and sizes of their parents."""
    names = [c.split()[0] for c in _NODE.split(", ")]
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int32(), *[pa.int64()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("node", "anchor", "conv_id", "n", "chain", "sizes")), strict=True)

        for (_, anchor), group in groupby(rows(), key=lambda r: (r[0], r[1])):
            members = [r[2:] for r in group]
            found = peel(members, anchor)
            rest = [None] * (len(found) - 1)  # the node at the anchor comes last
            chain, sizes = members[0][2][: (anchor - 1) * WIDE], members[0][3][: anchor - 1]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([*rest, chain], pa.binary()), pa.array([*rest, sizes], pa.list_(pa.int64()))], [*names, "chain", "sizes"])

    placed = fitting.withColumn("node", _prefix(F.col("anchor"))).select("node", "anchor", F.col("conv_id"), "n", "chain", "sizes")
    dealt = placed.repartition("node").sortWithinPartitions("node")
    return dealt.transform(in_tasks, run, f"{_NODE}, chain binary, sizes array<long>")


def _regrouped(rows: DataFrame, depth: int) -> DataFrame:
    """One row per node of a level, from conversations that end there and children (key, chain, sizes and aggregates)."""
    met = rows.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.min(F.struct("chain", "sizes")).alias("any"),
    )
    last = F.coalesce(F.get("any.sizes", F.lit(depth - 1)), F.lit(0)) if depth else F.lit(0)
    return met.select(
        "key", "conv_id", F.lit(depth).alias("depth"), "n_convs", "n_children", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).alias("n_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * last).alias("saved_tokens"), "any.chain", "any.sizes",
    )


def _stripped(nodes: DataFrame, depth: int) -> DataFrame:
    """The nodes of a level without their last turn, as children of the level above."""
    chain, sizes = F.substring("chain", 1, (depth - 1) * WIDE), F.slice("sizes", 1, depth - 1)
    return nodes.select(_prefix(F.lit(depth - 1)).alias("key"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens", chain.alias("chain"), sizes.alias("sizes"))


def trie(rebuilt: DataFrame, group: int = GROUP) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the trie of `rebuilt` (conv_id, turns).

    A conversation without turns ends at the root. Each conv_id comes once. An empty table has no node at all. A conversation is one row: some ten million turns.
    """
    chained = stored(chains(rebuilt), "chains")
    distinct = chained.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.min(F.struct("depth", "chain", "sizes")).alias("any"))
    distinct = stored(anchored(distinct.select("key", "n", "conv_id", "any.*"), group), "distinct")
    low = distinct.agg(F.min("conv_id")).first()[0]
    if low is None:
        return rebuilt.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    grouped = stored(_groups(distinct.where("anchor IS NOT NULL")), "groups")
    tops = grouped.where("chain IS NOT NULL")
    zero = F.lit(0).cast("long")
    ended = distinct.where("anchor IS NULL").select("key", "depth", "conv_id", F.col("n").alias("n_convs"), zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"), "chain", "sizes")
    starts = ended.select("depth").unionByName(tops.selectExpr("depth - 1 AS depth")).agg(F.max("depth")).first()[0]
    levels, below = [], None
    for depth in range(starts, -1, -1):
        new = tops.where(F.col("depth") == depth + 1)
        here = ended.where(F.col("depth") == depth).drop("depth")
        here = here.unionByName(new.select(F.col("parent").alias("key"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens", "chain", "sizes"))
        if below is not None:
            here = here.unionByName(_stripped(below, depth + 1))
        below = stored(_regrouped(here, depth), "level")
        levels.append(below.withColumn("parent", _prefix(F.lit(max(depth - 1, 0)))).drop("chain", "sizes"))
    upper = levels[0]
    for level in levels[1:]:
        upper = upper.unionByName(level)
    parents = upper.where("depth > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    rest = upper.unionByName(tops.select(upper.columns))
    deep = rest.where("depth > 1").join(parents.hint("merge"), "parent", "left")
    shallow = rest.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(low)))
    inner = grouped.where("chain IS NULL").select(*deep.columns)
    nodes = deep.unionByName(shallow.select(deep.columns)).unionByName(inner).join(ends(chained).hint("merge"), "key", "left")
    counts = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", *[F.col(c).cast("long").alias(c) for c in counts], F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"))
