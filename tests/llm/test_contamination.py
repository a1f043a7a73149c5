"""Benchmark windows in documents, against brute force over all positions."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from footfall.llm import contamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width=10):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document."""
    wanted = {}
    for item, text in items:
        w = words(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1) if w else ():
            wanted.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    found = []
    for doc, text in docs:
        w = words(text)
        hit, ids = set(), set()
        for n in {len(k) for k in wanted}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wanted:
                    hit |= set(range(i, i + n))
                    ids |= wanted[tuple(w[i : i + n])]
        found.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(found, key=str)


def planted():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünï", "ГРАД", "漢字", "x" * 300]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(8, 40))) for i in range(30)]
    items += [(1, text(20)), (None, text(15)), (40, ""), (41, None), (42, "Only Four words, here"), (43, "single"), (7, items[7][1]), (100, items[7][1])]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(40)]
    for i in range(40, 90):
        item = words(rng.choice(items)[1])
        cut = rng.randrange(len(item) + 1)
        docs.append((i, text(rng.randrange(5)) + " -- " + "! ".join(item[max(0, cut - 12) : cut + 6]).upper() + "\n" + text(rng.randrange(5))))
    docs += [(None, items[3][1]), (90, None), (90, items[4][1]), (90, ""), (91, "..., "), (92, items[5][1] * 3000), (93, "a single\x00only four\tWORDS\x7fhere"), (None, items[3][1])]
    return docs, items


def tables(spark):
    docs, items = planted()
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("n_words", F.lit("x"))
    return docs, spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit(1))


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


def test_by_brute_force_in_one_block_and_in_many(spark):
    docs, items = tables(spark)
    want = brute(*planted())
    assert any(r[3] > 1 for r in want) and any(not r[5] for r in want)
    assert rows(contamination.digests(contamination.find(docs, items, ["doc_id"]))) == want
    assert rows(contamination.digests(contamination.find(docs, items, ["doc_id"], limit=100))) == want
    assert rows(contamination.digests(contamination.find(docs, items, limit=100))) == want


def test_one_block_plan_has_no_shuffle(spark):
    docs, items = tables(spark)
    plan = contamination.find(docs, items, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(contamination, "PART", 7)
    item, doc = "one two three four five six seven eight nine ten eleven", b"Zero ONE two three  four\nfive six seven eight nine ten twelve"
    index = contamination.Index([(" ".join(item.split()[i : i + 10]), "5") for i in range(2)])
    starts, items, hit = index.scan([index.number(doc), index.number(b""), index.number(b"one")])
    assert [list(x) for x in items] == [["5"], [], []] and hit.tolist() == [False, *[True] * 10, False, False, False, False, False]


def test_empty_tables(spark):
    docs, items = tables(spark)
    clean = contamination.find(docs, items.limit(0), ["doc_id"])
    assert clean.count() == docs.count() and clean.where("size(hits) > 0 OR size(item_ids) > 0").count() == 0
    assert contamination.find(docs.limit(0), items).count() == 0


def test_spans_and_documents_go(spark):
    passage = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = [(1, f"Keep this: {passage.title()}, and that."), (2, passage), (3, "clean text"), (4, None), (5, f"{passage} x {passage}!")]
    docs = spark.createDataFrame([(a, b, 7) for a, b in docs], "doc_id long, text string, n_words int")
    cut = contamination.remove(docs, items)
    assert cut.columns == docs.columns
    assert {r.doc_id: r.text for r in cut.collect()} == {1: "Keep this: , and that.", 2: "", 3: "clean text", 4: None, 5: "x !"}
    assert sorted(r.doc_id for r in contamination.remove(docs, items, whole=True).collect()) == [3, 4]
    assert {r.n_words for r in cut.collect()} == {7}


def test_whole_tables(spark):
    folder = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    got = rows(contamination.digests(contamination.find(docs, items, ["doc_id"])))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == want and sum(r[5] for r in want) > 3
