"""The language stage: texts in scripts that were never learned and gibberish go, clean texts stay."""

import random
import zlib

import numpy as np
import pytest

from footfall.llm import language

SF = "/root/testdata/sf0.01"
ALPHABETS = {
    "cyrillic": "абвгдежзийклмнопрстуфхцчшщыьэюя",
    "greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "han": "".join(map(chr, range(0x4E00, 0x5A00))),
    "arabic": "".join(map(chr, range(0x627, 0x64B))),
    "gibberish": "abcdefghijklmnopqrstuvwxyz",
    "common letters": "etaoinshrdlu",
}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_planted_texts(spark, documents):
    rng = random.Random(7)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 10)))
    known = [r for r in documents.collect() if len((r.text or "").split()) >= 60]
    planted = [(-1 - i, " ".join(word(letters) for _ in range(n))) for i, (letters, n) in enumerate((a, n) for a in ALPHABETS.values() for n in (60, 200, 1000) for _ in range(20))]
    short = []
    for r in rng.sample(known, 200):
        words = r.text.split()
        at = rng.randrange(len(words) - 20)
        short.append((1_000_000 + r.doc_id, " ".join(words[at : at + 20])))
    more = spark.createDataFrame(planted + short, "doc_id long, text string")
    docs = documents.select("doc_id", "text", "lang").unionByName(more.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    kept = {r.doc_id for r in language.keep_known(docs).select("doc_id").collect()}
    assert not kept & {i for i, _ in planted}
    assert {r.doc_id for r in known} <= kept
    assert len(kept & {i for i, _ in short}) >= 198


def test_thresholds_come_from_all_texts(spark):
    """Prototypes and medians by brute force over all training texts of a language with more than a few thousand."""
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 10)))
    words = {lang: [word(ALPHABETS[name]) for _ in range(30)] for lang, name in (("el", "greek"), ("ru", "cyrillic"))}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randrange(3, 12))), lang) for i, lang in ((i, "el" if i % 9 else "ru") for i in range(9000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    learned = [(text, lang) for i, text, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    assert language.training_texts(docs).count() == len(learned) > 6000
    languages, prototypes = language.learn(docs)
    tool = language.profiler()
    found = [(lang, *tool.sized(text)) for text, lang in learned]
    sums = np.array([sum(np.round(v * (1 << 20)) for each, v, _ in found if each == lang) for lang in languages])
    assert languages == ["el", "ru"] and np.allclose(prototypes, sums / np.linalg.norm(sums, axis=1, keepdims=True), atol=1e-9)
    limits = language.least_likeness(docs, languages, prototypes)
    size = 6
    near = [float((prototypes @ v).max()) for lang, v, s in found if lang == "el" and s == size]
    assert len(near) > 1000 and limits[0, size] > limits[0, size - 1] and abs(limits[0, size] - language.SHARE * np.median(near)) < 1e-5
