"""SentencePiece encoding and decoding of merge-type vocabularies.

The text becomes symbols of one character; an agenda ordered by score, then by position, names the
adjacent pair that is joined next, until no pair is a vocabulary entry. Characters without an entry
are spelled as byte entries. No entry holds a word mark after another character, nor a line end
together with something else; so a text falls into units (word marks and what follows, up to
the next mark or line end) that never join, and units into parts between neighbours that no entry has
side by side; the agenda runs once per new part.
`unit_pattern` proves this from the vocabulary and leaves texts whole where it doesn't hold.

Each Arrow batch hands its new units to the sentencepiece library as well. The agenda's ids are the result; where
the library has others, `n_differ` counts it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from footfall.llm.common import Memo, in_tasks, keep_only, slices, texts, worker_cache

MARK = "▁"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_differ long"
#: Units that a worker remembers, in each of two generations.
REMEMBERED = 400_000


_PROSE = bytes([*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]) + b" \n.,"
_RUNS = (b"..", b".,", b",.", b",,", b"\xc3\x97", b"\xc3\xb7")


def _is_prose(raw: bytes) -> bool:
    """Latin letters, spaces, line ends, and full stops and commas that stand alone."""
    return not raw.translate(None, _PROSE) and not any([x in raw for x in _RUNS])


class PieceModel:
    """Vocabulary, scores and byte entries of a sentencepiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, size = self.library, self.library.get_piece_size()
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(size)]
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.rank = {p: -lib.get_score(i) for p, i in self.ids.items()}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(not lib.is_byte(i) for i in self.bytes):
            raise ValueError("the vocabulary has no byte entries")
        self.byte_of = {i: bytes([b]) for b, i in enumerate(self.bytes)}
        self.surface = [b"" if special[i] else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.line_end = str(self.bytes[10])
        whole = all(MARK not in p.lstrip(MARK) and "\n" not in p for p in self.ids)
        self.plain = whole and lib.normalize("a  ﬁ\n b") == f"{MARK}a{MARK}{MARK}ﬁ\n{MARK}b"
        self.unit_pattern = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+" if self.plain else "(?s).+")
        self.inside = {pair for p in self.ids for pair in map("".join, zip(p, p[1:], strict=False))}
        # letters and the two commonest signs never join, whichever comes first
        sides = [chr(i) for i in range(0x250) if chr(i).isalpha()] + [MARK]
        self.signs_apart = self.plain and not any(a + b in self.inside for x in sides for p in ".," for a, b in ((x, p), (p, x)))
        self.odd: dict[str, tuple[str, int]] = {}
        self.memo, self.parts = Memo(REMEMBERED), Memo(REMEMBERED)

    def normal(self, text: str) -> str:
        """The text with word marks, as the library normalises it."""
        if not text:
            return ""
        return MARK + text.replace(" ", MARK) if self.plain else self.library.normalize(text)

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.plain or "  " in text or text[0] == " " or "\n " in text or MARK in text:
            return self.unit_pattern.findall(self.normal(text))
        marked = MARK + text.replace(" ", f" {MARK}")
        prose = self.signs_apart and _is_prose(text.encode())
        if prose:
            marked = marked.replace(".", " . ").replace(",", " , ")
        found = []
        for line in marked.split("\n"):
            found.append("\n")
            found += line.split() if prose else line.split(" ") if line else ()
        return found[1:]

    def split_unit(self, unit: str) -> list[str]:
        """The unit, cut between neighbours that no entry has inside: nothing joins across."""
        inside, start, found = self.inside, 0, []
        for i in range(1, len(unit)):
            if unit[i - 1 : i + 1] not in inside:
                found.append(unit[start:i])
                start = i
        found.append(unit[start:])
        return found

    def encode_unit(self, unit: str) -> list[int]:
        """The agenda over one unit (or over a part of one, or a whole normalised text)."""
        rank, symbols, count = self.rank.get, list(unit), len(unit)
        agenda = [(r, i, p) for i in range(count - 1) if (r := rank(p := unit[i : i + 2])) is not None]
        if agenda:
            after, before = list(range(1, count + 1)), list(range(-1, count - 1))
            heapify(agenda)
            while agenda:
                _, i, pair = heappop(agenda)
                j = after[i]
                if j >= count or symbols[i] is None or symbols[i] + symbols[j] != pair:
                    continue
                symbols[i], symbols[j] = pair, None
                j = after[i] = after[j]
                if j < count:
                    before[j] = i
                    right = pair + symbols[j]
                    if (r := rank(right)) is not None:
                        heappush(agenda, (r, i, right))
                k = before[i]
                if k >= 0:
                    left = symbols[k] + pair
                    if (r := rank(left)) is not None:
                        heappush(agenda, (r, k, left))
        symbols = [x for x in symbols if x is not None]
        found = list(map(self.ids.get, symbols))
        if None in found:  # characters without an entry are spelled in bytes
            found = [i for x, known in zip(symbols, found, strict=True) for i in ([self.bytes[b] for b in x.encode()] if known is None else [known])]
        return found

    def decode_ids(self, ids: list[int]) -> str:
        """Surfaces in order, with word marks as spaces; byte entries are read as UTF-8."""
        surface, byte_of = self.surface, self.byte_of
        return b"".join([byte_of[i] if i in byte_of else surface[i] for i in ids]).decode("utf-8", "replace")

    def _parts_of(self, units: list[str]) -> list[list[int]]:
        """The agenda's ids of each unit; parts of several units are remembered."""
        split = [self.split_unit(u) for u in units]
        shared = iter(self.parts.look_up([x for x in split if len(x) > 1], lambda new: [self.encode_unit(p) for p in new]))
        return [[i for ids in next(shared) for i in ids] if len(x) > 1 else self.encode_unit(u) for u, x in zip(units, split, strict=True)]

    def _checked(self, units: list[str]) -> list[str]:
        """The agenda's ids as text, checked against the library; units that differ there or decode to something else are `odd`."""
        ours = self._parts_of(units)
        theirs = ours
        if self.plain:
            marked = [u[0] == MARK for u in units]
            lead = len(self.library.encode("\n"))
            asked = [u[1:].replace(MARK, " ") if m and len(u) > 1 else f"\n{u}".replace(MARK, " ") for u, m in zip(units, marked, strict=True)]
            found = self.library.encode(asked, num_threads=1)
            theirs = [ids if m and len(u) > 1 else ids[lead:] for u, m, ids in zip(units, marked, found, strict=True)]
        for unit, own, lib in zip(units, ours, theirs, strict=True):
            surface = self.decode_ids(own)
            if own != lib or surface != unit.replace(MARK, " "):
                self.odd[unit] = (surface, int(own != lib))
        return [",".join(map(str, ids)) for ids in ours]

    def encode_batch(self, rows: list[str]) -> list[tuple[int, str, str, int]]:
        """Per text: number of ids, ids joined by commas, decoded text, units (of a vocabulary that isn't plain: texts) that the library encodes otherwise."""
        split = [self.units(self.normal(x)) if not self.plain else self.units(x) for x in rows]
        odd, found = self.odd, []
        whole = [None] * len(rows) if self.plain else self.library.encode(rows, num_threads=1)
        for units, values, lib in zip(split, self.memo.look_up(split, self._checked), whole, strict=True):
            ids = ",".join(values)
            differ = int(lib is not None and ids != ",".join(map(str, lib)))
            if odd and not odd.keys().isdisjoint(units):
                text = "".join([odd[u][0] if u in odd else u.replace(MARK, " ") for u in units])
                differ += sum([odd[u][1] for u in units if u in odd])
            else:  # every unit's ids decode to the unit itself
                text = "".join(units).replace(MARK, " ")
            found.append((ids.count(",") + 1 if ids else 0, ids, text[1:] if text[:1] == " " else text, differ))
        return found


_MODELS: dict[str, PieceModel] = worker_cache()


def piece_model(path: str) -> PieceModel:
    """One model per worker process."""
    keep_only(_MODELS)
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Ids and decoded text of every whole text, as digests.

    `docs` has doc_id and text; other columns are not looked at. A null or empty text has no ids
    and decodes to the empty text; repeated rows give repeated results; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in slices(batches):
            counts, ids, decoded, differ = [], [], [], []
            for count, joined, text, wrong in model.encode_batch(texts(batch)):
                counts.append(count)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(text.encode()).hexdigest())
                differ.append(wrong)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), pa.array(differ, pa.int64())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_differ"],
            )

    return docs.select("doc_id", "text").transform(in_tasks, run, SCHEMA)
