"""Best-fit packing by exact complements.

Documents become token pieces of at most `capacity` ids. Which lengths share a sequence depends only on
how many pieces each length has, so the plan is made on that histogram (at most `capacity` numbers,
whatever the corpus): from the longest length down, the gap that is left is looked up among the single,
pair and triple sums of the lengths still available; a combination that fills it exactly is consumed as
often as its parts allow. Where none does, the longest length that fits is put in and the rest of
the gap is looked up again. A plan row says: `times` sequences hold these lengths in this order.

Pieces then find their place by (length, rank among the pieces of that length). Ranks are counted per
salt within a length, so a length that a third of all pieces have is spread over many tasks.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import Memo, in_tasks, keep_only, slices, stored, texts, worker_cache

CAPACITY = 4096
END_ID = 1
#: Distinct words that a worker remembers, in each of two generations.
REMEMBERED = 400_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Words that the tokenizer surely keeps whole: composed Latin letters only, or ASCII signs other than the apostrophe only.
_WHOLE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+")
_SIGNS = re.compile(rb"[!-&(-/:-@\[-`{-~]+|[0-9]")
_LETTERS = bytes([*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)])
_SPACE = b" \t\n\r\x0b\x0c"
_PROSE = _LETTERS + _SPACE + b".,"
_LATIN = _LETTERS + _SPACE + bytes(x for x in range(33, 127) if x != 39 and x not in _LETTERS)
_RUNS, _NO_LETTERS = (b"..", b".,", b",.", b",,"), (b"\xc3\x97", b"\xc3\xb7")


def words_apart(raw: bytes) -> list[bytes]:
    """The words of a text; where it has Latin letters and plain signs only, signs stand apart, as the tokenizer cuts them.

    So a word is looked up in one form, whatever its capitals and the signs around it. Texts with apostrophes, other
    letters, marks that combine or the strings of special tokens keep their words as they are.
    """
    if not any([x in raw for x in _NO_LETTERS]):
        if not raw.translate(None, _PROSE) and not any([x in raw for x in _RUNS]):
            raw = raw.lower().replace(b".", b" . ").replace(b",", b" , ")
        elif not raw.translate(None, _LATIN) and b"<|" not in raw:
            raw = _SIGNS.sub(rb" \g<0> ", raw.lower())
    return raw.split()


class WordIds:
    """Ids of a text, word by word, for a tokenizer that drops white space between words.

    ASCII white space always ends a word of such a tokenizer and leaves no id, so the ids of a text are
    those of its words in order; the tokenizer sees every new word once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Memo(REMEMBERED)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _together(self, words: list[str]) -> list[bytes]:
        """Words that stay whole, all in one text: the last id of each has the word end."""
        found = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(found[0].ids, "<u4")
        stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(stops) != len(words):
            return self._one_by_one(words)
        flat = ids.tobytes()
        return [flat[i:j] for i, j in zip([0, *stops], stops, strict=False)]

    def _encode(self, words: list[bytes]) -> list[bytes]:
        decoded = [w.decode() for w in words]
        whole = [_WHOLE.fullmatch(w) is not None for w in decoded]
        kinds = {True: [w for w, k in zip(decoded, whole, strict=True) if k], False: [w for w, k in zip(decoded, whole, strict=True) if not k]}
        found = {True: iter(self._together(kinds[True])), False: iter(self._one_by_one(kinds[False]))}
        return [next(found[k]) for k in whole]

    def encode_batch(self, rows: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return [b"".join(x) for x in self.words.look_up([words_apart(x.encode()) for x in rows], self._encode)]


_WORDS: dict[str, WordIds] = worker_cache()


def word_ids(path: str) -> WordIds:
    keep_only(_WORDS)
    if path not in _WORDS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every text's ids and the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(tokenizer_path), np.array([END_ID], "<u4").tobytes()
        for batch in slices(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(words.encode_batch(texts(batch))):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").transform(in_tasks, run, PIECES)


class Sums:
    """Index of single, pair and triple sums of the available lengths: which combination fills a gap exactly.

    For every sum it holds the combination with the longest length that may still be there. Availability only falls, so
    what has run out never comes back and each entry moves down once over all lengths; a look-up is a step or a few.
    """

    def __init__(self, have: list[int]):
        self.have = have
        self.pairs = [s - 1 for s in range(len(have))]
        self.triples = [s - 2 for s in range(len(have))]

    def pair(self, total: int, beside: int = 0) -> list[int] | None:
        """Two lengths that sum up to `total`, the longer one first; `beside` is a length of which one is spoken for."""
        have, a = self.have, self.pairs[total]
        while 2 * a >= total and not (have[a] and have[total - a] and (2 * a != total or have[a] > 1)):
            a -= 1
        self.pairs[total] = a
        while beside and 2 * a >= total:
            b = total - a
            if have[a] > (a == beside) + (a == b) and have[b] > (b == beside):
                break
            a -= 1
        return [a, total - a] if 2 * a >= total else None

    def triple(self, total: int) -> list[int] | None:
        """Three lengths that sum up to `total`, the longest first as far as it has a pair beside it."""
        have, a = self.have, self.triples[total]
        while 3 * a >= total:
            rest = self.pair(total - a, a) if have[a] else None
            if rest:
                self.triples[total] = a
                return [a, *rest]
            a -= 1
        self.triples[total] = a
        return None

    def filling(self, gap: int) -> list[int] | None:
        """Available lengths that fill `gap` exactly: one, else two, else three."""
        return [gap] if self.have[gap] else self.pair(gap) or self.triple(gap)


def plan_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths in a sequence) for all pieces; every length is used exactly as often as it occurs."""
    have = [0] * (capacity + 1)
    for length, count in counts.items():
        have[length] = count
    sums, plan = Sums(have), []
    for longest in range(capacity, 0, -1):
        while have[longest]:
            have[longest] -= 1
            taken, gap = [longest], capacity - longest
            while gap:
                found = sums.filling(gap)
                if not found:  # best fit
                    fit = gap
                    while fit and not have[fit]:
                        fit -= 1
                    if not fit:
                        break
                    found = [fit]
                for x in found:
                    have[x] -= 1
                taken += found
                gap -= sum(found)
            use = Counter(taken)
            times = 1 + min(have[x] // n for x, n in use.items())
            for x, n in use.items():
                have[x] -= n * (times - 1)
            plan.append((times, taken))
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (any columns, with a length of 1 to `capacity`) plus sequence_id and offset.

    Repeated rows are pieces of their own; an empty table gives an empty one. The plan has at most a few
    rows per distinct length, so it is small whatever the corpus.
    """
    spark = pieces.sparkSession
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [c for c in pieces.columns if c != "length"]
    salted = pieces.withColumn("salt_", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt_").agg(F.count("*").alias("n_"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n_").alias("n")).collect()}
    # from here: which (length, rank) goes where
    slots, used, sequence = [], Counter(), 0
    for times, lengths in plan_lengths(counts, capacity):
        offset = 0
        for length in lengths:
            slots.append((length, used[length], used[length] + times, sequence - used[length], offset))
            used[length] += times
            offset += length
        sequence += times
    table = spark.createDataFrame(slots, "length long, first_ long, last_ long, shift_ long, offset long")
    begins = sizes.select(
        "length", "salt_",
        (F.sum("n_").over(Window.partitionBy("length").orderBy("salt_")) - F.col("n_")).alias("begin_"), "n_",
    )
    # a salt's ranks are one run, cut where the plan's slots end: (length, salt) to its slots, by equality on length
    runs = (
        begins.join(F.broadcast(table), "length")
        .where((F.col("begin_") < F.col("last_")) & (F.col("begin_") + F.col("n_") > F.col("first_")))
        .groupBy("length", "salt_", "begin_")
        .agg(F.array_sort(F.collect_list(F.struct("first_", "last_", "shift_", "offset"))).alias("slots_"))
    )
    rank = F.row_number().over(Window.partitionBy("length", "salt_").orderBy(*order)) - 1
    ranked = salted.withColumn("rank_", rank).join(runs, ["length", "salt_"])
    at = F.col("begin_") + F.col("rank_")
    slot = F.filter("slots_", lambda s: (s["first_"] <= at) & (at < s["last_"]))[0]
    return ranked.withColumn("slot_", slot).select(
        *pieces.columns, (at + F.col("slot_.shift_")).alias("sequence_id"), F.col("slot_.offset").alias("offset")
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document's token pieces, packed.

    `docs` has doc_id and text; other columns are not looked at. A null or empty text is one piece that
    holds the end id only. The pieces are written once to the shared folder, so texts are encoded once.
    """
    pieces = stored(token_pieces(docs, tokenizer_path, capacity), "pieces")
    return pack(pieces, capacity)
