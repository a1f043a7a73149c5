"""The trie of conversations against brute force over all prefixes."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from footfall.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    """conv_id: list of (role, text); equal turn numbers by role and digest."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), role, key, text))
    own = {c: [(role, text) for _, role, _, text in sorted(t)] for c, t in own.items()}
    found = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        found[c] = own.get(base, [])[:h] + t[h:]
    return found


def brute(rows):
    nodes = {}
    for c, t in rebuilt(rows).items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    sequences = rebuilt(rows)
    children, leaves, saved = {}, {}, {}
    for node in sorted(nodes, key=len, reverse=True):
        kids = children.get(node, [])
        leaves[node] = sum(leaves[k] for k in kids) if kids else 1
        saved[node] = sum(saved[k] for k in kids) + ((len(nodes[node]) - 1) * len(node[-1][1].encode()) if node else 0)
        if node:
            children.setdefault(node[:-1], []).append(node)
    found = []
    for node, members in nodes.items():
        ended = ",".join(str(c) for c in sorted(members) if len(sequences[c]) == len(node))
        parent = min(nodes[node[:-1]]) if node else None
        found.append((min(members), len(node), parent, len(members), len(children.get(node, [])), leaves[node], saved[node], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(found, key=str)


def planted():
    rng = random.Random(5)
    rows = []
    for c in range(-12, 130):
        n = rng.choice([0, 1, 2, 3, 5, 8, 9, 12, 20])
        for turn in range(n):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "漢"]) if rng.random() < 0.3 else "same"))
    # copies, one long conversation, and conversations that are prefixes of each other
    rows += [(c, turn, "user", f"copy {turn}") for c in range(1000, 1060) for turn in range(12)]
    rows += [(c, turn, "user", f"snapshot {turn}") for c in range(2000, 2100, 5) for turn in range((c - 2000) // 5)]
    rows += [(3000, turn, "user", f"long {turn}") for turn in range(150)]
    rows += [(5000, None, None, "x"), (5000, None, "b", None), (5000, -3, "", ""), (5000, 0, "user", "tie"), (5000, 0, "user", "tie"), (5000, 0, "user", "other")]
    rows += [(None, 1, "user", "no conversation"), (6001, 0, "u", "one turn"), (6002, 0, "u", "z" * 200_000)]
    return rows


def rows_of(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=str)


def test_by_brute_force_with_groups_of_any_size(spark):
    table = spark.createDataFrame(planted(), SCHEMA).withColumn("key", F.lit(1)).withColumn("depth", F.lit("x")).repartition(7)
    want = brute(planted())
    for group in (prefix_trie.GROUP, 60):
        assert rows_of(prefix_trie.trie(prefix_trie.branched(table), group)) == want


def test_small_groups_leave_every_level_to_spark(spark):
    rows = [r for r in planted() if r[0] is not None and r[0] < 60 and r[1] < 6]
    table = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(prefix_trie.trie(prefix_trie.branched(table), 0)) == brute(rows)


def test_ids_of_a_node_in_many_pieces(spark):
    rows = [(c, 0, "user", "same") for c in [*range(-2000, 3000), 2**62, -(2**62)]]
    assert rows_of(prefix_trie.trie(prefix_trie.branched(spark.createDataFrame(rows, SCHEMA)))) == brute(rows)


def test_empty_tables(spark):
    assert prefix_trie.trie(prefix_trie.branched(spark.createDataFrame([], SCHEMA))).collect() == []
    one = prefix_trie.trie(prefix_trie.branched(spark.createDataFrame([(4, 0, None, None)], SCHEMA)))
    assert rows_of(one) == brute([(4, 0, None, None)])


def test_whole_table(spark, sf_dir):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert rows_of(prefix_trie.trie(prefix_trie.branched(table))) == brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
