"""Operators on single texts and pairs of texts: sketches, pieces, packing, fingerprints."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from footfall.llm import packing, pieces, simhash, sketches
from footfall.llm.components import connected

DOCS = "doc_id long, text string, lang string, fp long, bucket int, length string"
ODD = [
    (1, None, None, 1, 2, "x"), (2, "", "en", None, None, None), (3, " \n\t ", "en", 0, 0, ""), (4, "one", None, 0, 0, ""),
    (5, "a b c d e f\nsame line here\nsame line here\n", "en", 0, 0, ""), (5, "a b c d e f\nsame line here\nsame line here\n", "en", 0, 0, ""),
    (6, "é日本語 ▁ x́ <|endoftext|> </s> it's 12\x00", "en", 0, 0, ""), (None, "no id", "en", 0, 0, ""), (None, None, None, None, None, None),
    (7, "word " * 30_000, "en", 0, 0, ""), (8, "x" * 20_000, "en", 0, 0, ""),
]
TEXTS = st.lists(st.text(st.sampled_from(" \n\t.,!?'#ab THéßΣσ日😀▁1́×"), max_size=12), max_size=8)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1: sketches


def alike(a, b):
    a, b = (Counter(sketches.paragraphs(x.encode())) for x in (a, b))
    both = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / both if both else 1.0


def check_versions(df, rows):
    order = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in rows))
    want = []
    for i, (known, doc, text) in enumerate(order):
        after = order[(i + 1) % len(order)][2]
        version = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        want.append((doc if known else None, len(text), hashlib.sha256(version.encode()).hexdigest(), round(alike(text, version), 9), round(alike(text, after), 9)))
    got = sketches.fingerprint_versions(df).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=repr) == sorted(want, key=repr)
    return got


def test_versions_by_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = check_versions(documents, rows)
    prints = {}
    by_id = dict(rows)
    for r in got:
        assert prints.setdefault(by_id[r.doc_id], r.fingerprint) == r.fingerprint
    assert sum(r.near_edited > r.near_next for r in got) > 0.9 * len(got)


def test_versions_of_odd_rows(odd, empty, spark):
    check_versions(odd, ODD)
    assert sketches.fingerprint_versions(empty).count() == 0
    check_versions(spark.createDataFrame([(9, "alone text")], "doc_id long, text string"), [(9, "alone text")])


def test_peeling_recovers_what_differs():
    rng = random.Random(5)
    a = [f"line {i}" for i in range(400)]
    b = [x for x in a if rng.random() > 0.2] + [f"new {i}" for i in range(60)]
    owner, keys = sketches.digests(["\n".join(a).encode(), "\n".join(b).encode()])
    pair, key, sign, tries = sketches.differences(owner, keys, 2, np.array([0]), np.array([1]))
    mine, theirs = (set(keys[owner == i].tolist()) for i in (0, 1))
    assert set(key[sign > 0].tolist()) == mine - theirs and set(key[sign < 0].tolist()) == theirs - mine
    assert tries[0] > 1 and (pair == 0).all()


# 6: pieces


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))


def check_pieces(model, rows):
    ids = model.library.encode(rows)
    for (count, joined, text, mended), want in zip(model.encode_batch(rows), ids, strict=True):
        assert (count, joined, text, mended) == (len(want), ",".join(map(str, want)), model.library.decode(want), 0)


@settings(max_examples=150, deadline=None)
@given(rows=TEXTS)
def test_pieces_are_the_librarys(rows):
    check_pieces(pieces.piece_model(public_tokenizers.path("piece_bpe_32k.model")), rows)


def test_pieces_of_documents(model, documents, odd, empty):
    check_pieces(model, [r.text for r in documents.collect()])
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = pieces.encode_digests(odd, path).collect()
    want = []
    for doc, text, *_ in ODD:
        ids = library.encode(text or "")
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), 0))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert pieces.encode_digests(empty, path).count() == 0


# 2: packing


@settings(max_examples=150, deadline=None)
@given(rows=TEXTS)
def test_word_ids_are_the_tokenizers(rows):
    words = packing.word_ids(public_tokenizers.path("word_bpe_49k.json"))
    want = [np.array(x.ids, "<u4").tobytes() for x in words.tokenizer.encode_batch(rows, add_special_tokens=False)]
    assert words.encode_batch(rows) == want


@settings(max_examples=60, deadline=None)
@given(lengths=st.lists(st.integers(1, 40), max_size=80))
def test_plan_uses_every_length_once(lengths):
    plan = packing.plan_lengths(dict(Counter(lengths)), 40)
    used = Counter()
    for times, row in plan:
        assert sum(row) <= 40 and times > 0
        used.update({x: times * n for x, n in Counter(row).items()})
    assert used == Counter(lengths)


def test_plan_fills_exact_complements():
    assert sum(t for t, _ in packing.plan_lengths({60: 5, 40: 5, 50: 2, 30: 3, 20: 3, 10: 5}, 100)) == 8


def check_packing(df, rows, tokenizer):
    got = [tuple(r) for r in packing.pack_documents(df, public_tokenizers.path("word_bpe_49k.json")).collect()]
    want = []
    for doc, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(doc, i // 4096, i, len(ids[i : i + 4096]), zlib.crc32(ids[i : i + 4096].tobytes())) for i in range(0, len(ids), 4096)]
    assert sorted((r[:5] for r in got), key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in got:
        sequences.setdefault(r[5], []).append((r[6], r[3]))
    for row in sequences.values():
        row.sort()
        assert [o for o, _ in row] == [sum(n for _, n in row[:i]) for i in range(len(row))] and sum(n for _, n in row) <= 4096
    return len(sequences), sum(x[3] for x in want)


def test_packing(documents, odd, empty):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sequences, tokens = check_packing(documents, [(r.doc_id, r.text) for r in documents.collect()], tokenizer)
    assert sequences <= 1.02 * tokens / 4096 + 1
    check_packing(odd, ODD, tokenizer)
    assert packing.pack_documents(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0


# 9: fingerprints


def fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def check_groups(df, rows, radius=2):
    prints = [fingerprint(r[1] or "") for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]
    root = roots(len(rows), near)
    least = {}
    for r, g in zip(rows, root, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = [(r[0], f"{p:016x}", least.get(g)) for r, p, g in zip(rows, prints, root, strict=True)]
    got = simhash.near_duplicates(df, radius=radius).select("doc_id", simhash.fingerprint_text(), "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_groups_by_brute_force(documents, odd, empty):
    check_groups(documents, [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])
    check_groups(odd, ODD)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 4])
def test_masks_cover(radius):
    rng = random.Random(radius)
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(300):
        error = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not error & m for m in masks)
        assert any(not error & f for m in masks if not error & m for f in simhash.finer_masks(m, radius))


@pytest.mark.parametrize("radius", [2, 3])
def test_large_buckets_are_dealt_again(spark, monkeypatch, radius):
    monkeypatch.setattr(simhash, "SMALL", 8)
    rng = random.Random(3)
    found = set()
    for centre in (rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(150):
            x = centre
            for b in rng.sample(range(64), rng.randrange(7)):
                x ^= 1 << b
            found.add(x)
    found = sorted(found)
    near = [(i, j) for i in range(len(found)) for j in range(i) if (found[i] ^ found[j]).bit_count() <= radius]
    root = roots(len(found), near)
    signed = [x - (1 << 64) if x >> 63 else x for x in found]
    got = connected(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius)).collect()
    groups, want = {}, {}
    for r in got:
        groups.setdefault(r.root, set()).add(r.node)
    for x, g in zip(signed, root, strict=True):
        want.setdefault(g, set()).add(x)
    assert {frozenset(x) for x in groups.values()} == {frozenset(x) for x in want.values() if len(x) > 1}


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (70, 71), (71, 70), (70, 71)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 70: 70, 71: 70}


def test_one_of_each_group_stays(spark, odd):
    text = " ".join(f"w{i % 90}" for i in range(400))
    rows = [(3, text), (1, text), (2, "something else entirely here"), (None, text), (1, text)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id for r in kept), key=str) == [1, 2, None]
    assert simhash.keep_one(odd).columns == odd.columns


def test_repeated_ids_with_other_texts_stay_once_a_group(spark):
    a, b = (" ".join(f"{x}{i % 90}" for i in range(400)) for x in "ab")
    rows = [(1, a), (1, b), (1, a), (2, a), (3, b), (1, None), (4, "")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == [(1, ""), (1, a), (1, b)]


def test_stage_keeps_the_least_of_linked_fingerprints(spark, documents):
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, documents, "").collect()}
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    prints = [int(x) for x in simhash.fingerprints([t or "" for _, t in rows], 3)]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    low = {}
    for (doc, _), r in zip(rows, root, strict=True):
        low[r] = min(low.get(r, doc), doc)
    assert kept == set(low.values()) and len(kept) < len(rows)
