"""Main text of web pages, with a suffix array per host for what repeats across its pages.

A page is cut into blocks of text. Elements that are never content (menus, headers, footers, adverts, forms,
scripts, comments) go by their names, classes and ids. Where a page marks its article, the blocks inside are its candidates.
The other blocks of a host's pages are put behind each other as one stream of tokens; its suffix array
shows substrings of at least RUN tokens that several distinct pages hold. Tokens covered by those, and whole blocks of
at least WHOLE tokens that as many pages hold, are boilerplate; a page without a marked article keeps the runs that
are left. Copies of a page count as one page, and a share of the pages must agree, so common phrases of prose stay.

The blocks of a host's marked articles are a stream of their own. Articles share passages and have near copies, so more is
asked of it: furniture is what most of the host's distinct articles hold, by three standard errors (so no less than nine).
It goes from each article, unless that takes more than half of the article's tokens: that one is a near copy and stays whole.

A host's pages are dealt to groups of about GROUP pages, so a host that has a third of all pages makes many tasks. A group
tells how many distinct pages hold each of its runs and blocks; a host of several groups adds these counts up by the
hash of the run, so repetition counts over the whole host, and the pages look the frequent ones up. Of articles a group only
tells runs that a quarter of its articles hold: by the hash that deals n articles to a group, one that most of a host's
articles hold is below that with odds under exp(-n / 8).
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import in_tasks, keep_only, slices, stored

#: Boilerplate: substrings of so many tokens, and whole blocks of WHOLE or more, that so many distinct pages of a host and
#: this share of them have.
RUN, WHOLE, PAGES, SHARE = 12, 4, 3, 0.01
#: A group tells what so many of its articles hold, and an article loses no more than this part of itself.
TOLD, MOST = 0.25, 0.5
#: Pages of a host that one suffix array covers.
GROUP = 2_000
#: A host of several groups is looked up under so many keys.
SALTS = 64

# A quoted value is one only if a blank or the tag's end follows it; a quote left open ends with the tag, at the next `>`.
_ATTRIBUTES = r"""((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')(?=\s|/?>)|=)*+)"""
_PIECE = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+){_ATTRIBUTES}>|<[!?][^>]*(?:>|\Z)|<[/a-zA-Z][^>]*\Z", re.S
)
# What stands inside these is dropped. The first kind holds no markup, so it goes on to the page's end if it isn't closed.
_RAW = frozenset("script style title textarea iframe".split())
_DROPPED = _RAW | frozenset("noscript template svg math select object button".split())
_BOUNDS = {tag: re.compile(rf"<(/?){tag}(?=[\s/>]){_ATTRIBUTES}>", re.I) for tag in _DROPPED}
_MARKS = re.compile(r"(?<![\w-])(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SIDE_TAGS = frozenset("nav footer aside form dialog menu head header fieldset".split())
_SIDE_WORDS = frozenset(
    """nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget ad ads adv advert adverts advertisement
    adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe
    subscription signup login search share sharing social related recommended recommendations comment comments disqus reply replies respond
    contentinfo complementary pagination pager toolbar""".split()
)
#: With a side word these make up the name of a part of the page, such as `comment-list`; `share-price` is none.
_HOLDERS = frozenset("area bar block box button buttons container content form inner links list panel posts section slot unit wrap wrapper".split())
_HEADINGS = frozenset(["header", "masthead"])
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
_MAIN_WORDS = frozenset("article articlebody post entry story main".split())
_ARTICLE, _MAIN, _OPEN = 2, 1, 0


def _nature(tag: str, attributes: str, level: int) -> tuple[bool, int]:
    """(never content, how surely it is the article) of an element; an article's own heading is content."""
    words, named = set(), False
    if attributes:
        but = _HEADINGS if level else frozenset()
        for _, *values in _MARKS.findall(attributes):
            for name in "".join(values).lower().split():
                parts = _PART.findall(name)
                words.update(parts)
                side = (_SIDE_WORDS - but).intersection(parts)
                # inside an article a name counts as a whole
                named = named or bool(side and (not level or side.union(_HOLDERS).issuperset(parts)))
    hidden = bool(attributes) and _HIDDEN.search(attributes) is not None
    side = named or hidden or (tag in _SIDE_TAGS and not (level and tag in _HEADINGS))
    if tag == "article":
        return named or hidden, _ARTICLE
    if tag == "main" or (tag in ("div", "section") and words & _MAIN_WORDS):
        return side, _MAIN
    return side, _OPEN


def _end_of(page: str, tag: str, at: int) -> int | None:
    """Where the element `tag` whose content begins at `at` is over; None if it isn't closed."""
    depth = 1
    for m in _BOUNDS[tag].finditer(page, at):
        if m[1]:
            depth -= 1
        elif tag not in _RAW and not m[2].endswith("/"):
            depth += 1
        if not depth:
            return m.end()
    return None


def blocks(page: str) -> list[tuple[str, int, bool]]:
    """(text, level, never content) of each block with text, in page order; level 2 is inside an article, 1 inside a main part."""
    found, texts, stack = [], [], []  # the stack holds (tag, side, level)
    at, side, level = 0, 0, _OPEN
    unclosed = set()

    def close() -> None:
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            texts.clear()
            if text:
                found.append((text, level, side > 0))

    def pop(place: int) -> None:
        nonlocal side, level
        for _, was_side, before in reversed(stack[place:]):
            side -= was_side
            level = before
        del stack[place:]

    while m := _PIECE.search(page, at):
        if m.start() > at:
            texts.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _DROPPED:
            if m[1] or tag in unclosed or (m[3].endswith("/") and tag not in _RAW):
                continue
            end = _end_of(page, tag, at)
            if end is None and tag in _RAW:
                at = len(page)
            elif end is None:
                unclosed.add(tag)
            else:
                at = end
            continue
        if m[1]:
            if tag in _INLINE and not any(x[0] == tag for x in stack[-1:]):
                continue
            close()
            for place in range(len(stack) - 1, -1, -1):
                if stack[place][0] == tag:
                    pop(place)
                    break
            continue
        own_side, own_level = _nature(tag, m[3], level)
        if tag in _INLINE and not own_side:
            continue
        close()
        if tag == "body":  # also ends an unclosed head
            pop(0)
        if stack and stack[-1][0] == "p":  # a paragraph ends where the next block begins
            pop(len(stack) - 1)
        if tag in _VOID or m[3].endswith("/"):
            continue
        stack.append((tag, int(own_side), level))
        side += own_side
        level = max(level, own_level)
    if at < len(page):
        texts.append(page[at:])
    close()
    return found


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefix length of each suffix with the one before it) by prefix doubling, common lengths up to RUN only."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < RUN:  # substrings of RUN tokens need no deeper order
        after = np.full(n, -1, np.int64)
        after[: max(n - step, 0)] = rank[step:]
        rank = np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        step *= 2
    order = np.argsort(rank, kind="stable")
    common = np.zeros(n, np.int64)
    if n > 1:
        at = np.arange(1, n)  # the suffixes still alike
        for k in range(RUN):
            a, b = order[at] + k, order[at - 1] + k
            inside = np.maximum(a, b) < n
            at, a, b = at[inside], a[inside], b[inside]
            at = at[tokens[a] == tokens[b]]
            common[at] += 1
    return order, common


def _stream(pages: list[list[list[str]]], same: list[int] | None) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]]]:
    """(numbers of the tokens of all blocks behind each other, the page of each, where each page's blocks lie)."""
    ids: dict[str, int] = {}
    flat, ends, spans = [], [], []
    for parts in pages:
        spans.append([])
        for tokens in parts:
            spans[-1].append((len(flat), len(flat) + len(tokens)))
            flat += [ids.setdefault(t, len(ids)) for t in tokens]
            flat.append(-1 - len(flat))  # no substring goes on into the next block
        ends.append(len(flat))
    owner = np.repeat(np.arange(len(pages)) if same is None else np.array(same, np.int64), np.diff(np.array([0, *ends])))
    return np.array(flat, np.int64), owner, spans


def covered(pages: list[list[list[str]]], same: list[int] | None = None, least: int = PAGES) -> list[list[np.ndarray]]:
    """For each page's blocks of tokens: which tokens lie in a substring of RUN tokens that `least` distinct pages have.

    `same` numbers the pages, with one number for copies (default: all are distinct).
    """
    codes, owner, spans = _stream(pages, same)
    cover = np.zeros(len(codes) + RUN, np.int64)
    if len(codes):
        order, common = suffix_array(codes)
        run = np.cumsum(common < RUN)  # suffixes that share RUN tokens have one number
        pair = np.unique(np.stack([run, owner[order]], axis=1), axis=0)
        pages = np.bincount(pair[:, 0], minlength=run[-1] + 1)
        starts = order[pages[run] >= least]
        cover[starts] += 1
        cover[starts + RUN] -= 1
    inside = np.cumsum(cover)[: len(codes)] > 0
    return [[inside[a:b] for a, b in parts] for parts in spans]


def boilerplate(pages: list[list[list[str]]], whole: list[tuple]) -> list[list[np.ndarray]]:
    """`covered` by a share of the distinct pages, and the blocks that as many of them hold whole; `whole` is what copies have alike."""
    numbers: dict[tuple, int] = {}
    same = [numbers.setdefault(x, len(numbers)) for x in whole]
    least = max(PAGES, math.ceil(SHARE * len(numbers)))
    holders: dict[tuple, set[int]] = {}
    for page, parts in zip(same, pages, strict=True):
        for tokens in parts:
            if len(tokens) >= WHOLE:
                holders.setdefault(tuple(tokens), set()).add(page)
    often = {block for block, held in holders.items() if len(held) >= least}
    return [[mask | (tuple(tokens) in often) for tokens, mask in zip(parts, masks, strict=True)] for parts, masks in zip(pages, covered(pages, same, least), strict=True)]


def _article(found: list[tuple[str, int, bool]]) -> tuple[int, list[str]]:
    """(level of the article, its blocks); level 0 where none is marked."""
    best = max([level for _, level, never in found if not never], default=_OPEN)
    return best, [t for t, level, never in found if not never and level == best] if best else []


#: An article is its blocks, one a line.
PARSED = "page_id long, url string, host string, article string, marked boolean, side array<string>, open array<boolean>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep_only()
    for batch in slices(batches):
        articles, marked, side, free = [], [], [], []
        for page in batch.column("html").to_pylist():
            found = blocks(page or "")
            best, inside = _article(found)
            marked.append(best > _OPEN)
            articles.append("\n".join(inside))
            rest = [(t, not never) for t, level, never in found if never or level < max(best, _MAIN)]
            side.append([t for t, _ in rest])
            free.append([f for _, f in rest])
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(articles, pa.string()), pa.array(marked),
             pa.array(side, pa.list_(pa.string())), pa.array(free, pa.list_(pa.bool_()))],
            ["page_id", "url", "host", "article", "marked", "side", "open"],
        )


_ODD, _WHOLE_SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D)


class Prints:
    """64-bit numbers of runs of RUN tokens and of whole blocks, equal in every task."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, tokens: list[str]) -> tuple[np.ndarray, np.uint64 | None]:
        """One number per place where a run begins, and that of the block (None below WHOLE tokens)."""
        known = self.known
        if len(known) > 1_000_000:  # only saves work
            known.clear()
        for t in tokens:
            if t not in known:
                known[t] = xxhash.xxh64_intdigest(t)
        codes = np.array([known[t] for t in tokens], np.uint64)
        runs = np.zeros(max(len(codes) - RUN + 1, 0), np.uint64)
        for k in range(RUN if len(runs) else 0):
            runs = runs * _ODD + codes[k : k + len(runs)]
        whole = None
        if len(codes) >= WHOLE:
            powers = np.cumprod(np.full(len(codes), _ODD, np.uint64))
            whole = ((codes * powers).sum(keepdims=True) * _WHOLE_SEED + np.uint64(len(codes)))[0]
        return runs, whole

    def mask(self, tokens: list[str], often: np.ndarray) -> np.ndarray:
        """Which tokens of a block lie in the runs of these numbers; all of them if it's one of the whole blocks."""
        runs, whole = self.of(tokens)
        cover = np.zeros(len(tokens) + 1, np.int64)
        starts = np.flatnonzero(np.isin(runs, often))
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + RUN, -1)
        return (np.cumsum(cover)[:-1] > 0) | (whole is not None and bool(np.isin(whole, often)))


def counted(pages: list[list[list[str]]], same: list[int], prints: Prints) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the runs and blocks, how many distinct pages hold each); `same` is as in `covered`."""
    numbers, owners, flat = [], [], []
    ids: dict[str, int] = {}
    for page, parts in zip(same, pages, strict=True):
        for tokens in parts:
            runs, whole = prints.of(tokens)
            numbers += [runs, np.zeros(len(tokens) + 1 - len(runs), np.uint64)]
            flat += [ids.setdefault(t, len(ids)) for t in tokens]
            flat.append(-1 - len(flat))
            owners.append((page, len(tokens) + 1, len(runs), whole))
    if not flat:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    number = np.concatenate(numbers)
    owner = np.concatenate([np.full(n, page) for page, n, _, _ in owners])
    begins = np.concatenate([np.arange(n) < k for _, n, k, _ in owners])
    order, common = suffix_array(np.array(flat, np.int64))
    run = np.cumsum(common < RUN)
    order, run = order[begins[order]], run[begins[order]]
    pair, at = np.unique(np.stack([run, owner[order]], axis=1), axis=0, return_index=True)
    _, first, holders = np.unique(pair[:, 0], return_index=True, return_counts=True)
    wholes = {(whole, page) for page, _, _, whole in owners if whole is not None}
    blocks_ = np.array([w for w, _ in wholes], np.uint64)
    block, block_holders = np.unique(blocks_, return_counts=True)
    return np.concatenate([number[order][at][first], block]), np.concatenate([holders, block_holders])


GROUPED = "kind int, host string, part long, run long, n long, least long, page_id long, url string, text string, side array<string>, open array<boolean>"
_RUN_ROW, _TEXT_ROW, _PAGE_ROW = 0, 1, 2


def _kept_text(parts: list[list[str]], masks: list[np.ndarray], free: list[bool]) -> str:
    return " ".join(t for tokens, mask, f in zip(parts, masks, free, strict=True) if f for t, c in zip(tokens, mask, strict=True) if not c)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows come by host and part."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and (row["host"], row["part"]) != (rows[0]["host"], rows[0]["part"]):
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _rows(columns: dict, n: int) -> Iterator[pa.RecordBatch]:
    kinds = {"kind": pa.int32(), "host": pa.string(), "part": pa.int64(), "run": pa.int64(), "n": pa.int64(), "least": pa.int64(), "page_id": pa.int64(),
             "url": pa.string(), "text": pa.string(), "side": pa.list_(pa.string()), "open": pa.list_(pa.bool_())}
    arrays = [pa.array(columns[c], kind) if c in columns else pa.nulls(n, kind) for c, kind in kinds.items()]
    whole = pa.RecordBatch.from_arrays(arrays, list(kinds))
    for start in range(0, n, 20_000):
        yield whole.slice(start, 20_000)


def _judge_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of unmarked pages where the group is the host; else the counts of its runs, and the unmarked pages as they are."""
    prints = Prints()
    for rows in _groups(batches):
        pages = [r for r in rows if not r["elsewhere"]]
        elsewhere = {r["digest"] for r in rows if r["elsewhere"]}  # another group counts these copies
        host, part, least = rows[0]["host"], rows[0]["part"], rows[0]["least"]
        unmarked = [i for i, r in enumerate(pages) if not r["marked"]]
        streams = [[block.split() for block in r["side"]] for r in pages]
        if rows[0]["parts"] == 1:
            masks = boilerplate(streams, [r["digest"] for r in pages])
            out = {"text": [_kept_text(streams[i], masks[i], pages[i]["open"]) for i in unmarked]}
            kind = _TEXT_ROW
        else:
            first = {r["digest"]: i for i, r in reversed(list(enumerate(pages))) if r["digest"] not in elsewhere}
            runs, n = counted([streams[i] for i in first.values()], list(range(len(first))), prints)
            same = {"kind": [_RUN_ROW] * len(runs), "host": [host] * len(runs), "least": [least] * len(runs)}
            yield from _rows({**same, "run": runs.view(np.int64), "n": n}, len(runs))
            out = {name: [pages[i][name] for i in unmarked] for name in ("side", "open")}
            out |= {"host": [host] * len(unmarked), "part": [part] * len(unmarked)}
            kind = _PAGE_ROW
        out |= {name: [pages[i][name] for i in unmarked] for name in ("page_id", "url")}
        yield from _rows({**out, "kind": [kind] * len(unmarked)}, len(unmarked))


def _unique_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of the pages of a group, whose first row has the frequent runs and blocks of its host."""
    prints = Prints()
    for rows in _groups(batches):
        often = np.array(rows[0]["often"] if rows[0]["often"] is not None else [], np.int64).view(np.uint64)
        out = []
        for r in rows:
            if r["often"] is None:
                parts = [block.split() for block in r["side"]]
                out.append((r["page_id"], r["url"], _kept_text(parts, [prints.mask(tokens, often) for tokens in parts], r["open"])))
        columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text"])


def _articles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The marked articles; a task gives most copies only once."""
    keep_only()
    seen: set[tuple[str, int]] = set()
    for batch in slices(batches):
        hosts, articles = [], []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            best, inside = _article(blocks(page or ""))
            article = "\n".join(inside)
            key = (host, xxhash.xxh64_intdigest(article))
            if best and key not in seen:
                if len(seen) > 1_000_000:  # only saves work
                    seen.clear()
                seen.add(key)
                hosts.append(host)
                articles.append(article)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(articles, pa.string())], ["host", "article"])


def held_by(articles: list[list[list[str]]], least: int, prints: Prints) -> tuple[list[int], list[int]]:
    """(numbers of the runs and blocks that `least` of these articles hold, how many hold each); `least` is 2 or more."""
    codes, owner, spans = _stream(articles, None)
    order, common = suffix_array(codes)
    run = np.cumsum(common < RUN)
    frequent = np.bincount(run)[run] >= least
    pair = np.unique(run[frequent] * len(articles) + owner[order[frequent]])
    holders = np.bincount(pair // len(articles))
    places = [(i, k) for i, parts in enumerate(articles) for k in range(len(parts))]
    begins = np.array([begin for parts in spans for begin, _ in parts])
    numbers, counts = [], []
    for r in np.flatnonzero(holders >= least).tolist():
        at = order[np.searchsorted(run, r)]
        block = np.searchsorted(begins, at, "right") - 1
        i, k = places[block]
        at -= begins[block]
        numbers.append(int(prints.of(articles[i][k][at : at + RUN])[0][0]))
        counts.append(int(holders[r]))
    wholes = Counter(whole for parts in articles for whole in {tuple(block) for block in parts if len(block) >= WHOLE})
    for whole, n in wholes.items():
        if n >= least:
            numbers.append(int(prints.of(list(whole))[1]))
            counts.append(n)
    return numbers, counts


def _article_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    prints = Prints()
    for rows in _groups(batches):
        articles = [[block.split() for block in article.split("\n")] for article in dict.fromkeys(r["article"] for r in rows)]
        numbers, n = held_by(articles, max(2, math.ceil(TOLD * len(articles))), prints)
        columns = [pa.array([rows[0]["host"]] * len(n), pa.string()), pa.array(np.array(numbers, np.uint64).view(np.int64)), pa.array(n, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["host", "run", "n"])


def without(article: list[str], often: np.ndarray, prints: Prints) -> str:
    """The text of an article's blocks without these runs and blocks; the whole text if they are most of it."""
    parts = [block.split() for block in article]
    masks = [prints.mask(tokens, often) for tokens in parts]
    if sum(int(mask.sum()) for mask in masks) > MOST * sum(map(len, parts)):
        return " ".join(article)
    return _kept_text(parts, masks, [True] * len(parts))


def _article_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of the pages with a marked article; `often` has the furniture of their host."""
    prints = Prints()
    for batch in slices(batches):
        out = []
        for page_id, url, page, often in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "often")), strict=True):
            best, inside = _article(blocks(page or ""))
            if best:
                text = " ".join(inside) if often is None else without(inside, np.array(often, np.int64).view(np.uint64), prints)
                out.append((page_id, url, text))
        columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text"])


def _in_groups(df: DataFrame, large: DataFrame, spot: Column) -> DataFrame:
    """`df` with the parts of its host and the part that `spot` deals a row to; `large` has the hosts of several parts under each salt."""
    dealt = df.withColumn("salt", F.pmod(spot, F.lit(SALTS))).join(large, ["host", "salt"], "left").drop("salt")
    return dealt.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(spot, "parts"))


def _marked_texts(pages: DataFrame, parsed: DataFrame, large: DataFrame) -> DataFrame:
    """The texts of the marked pages: their articles without what most articles of their host hold.

    Articles go to their groups, but the texts aren't written: pages are parsed again, which costs less than the disk.
    """
    large = large.select("host", "salt", "parts")
    articles = pages.select("host", "html").transform(in_tasks, _articles, "host string, article string")
    articles = _in_groups(articles, large, F.xxhash64("article")).select("host", "part", "article")
    tasks = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), parsed.count() // GROUP)
    articles = articles.repartition(tasks, "host", "part").sortWithinPartitions("host", "part")
    runs = articles.transform(in_tasks, _article_runs, "host string, run long, n long").groupBy("host", "run").agg(F.sum("n").alias("n"))
    distinct = parsed.where("marked").groupBy("host", "article").agg(F.count("*")).groupBy("host").agg(F.count("*").alias("articles"))
    often = runs.join(distinct, "host").where(F.col("n") >= F.col("articles") / 2 + 1.5 * F.sqrt("articles"))
    often = often.groupBy("host").agg(F.collect_list("run").alias("often"))
    parts = large.groupBy("host").agg(F.max("parts").alias("parts"))
    lists = stored(often.join(parts, "host", "left").select("host", "often", F.coalesce("parts", F.lit(1)).alias("parts")), "furniture")
    lists = lists.select("host", "often", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    looked = _in_groups(pages, large, F.xxhash64("page_id", "url")).join(lists, ["host", "part"], "left")
    return looked.select("page_id", "url", "html", "often").transform(in_tasks, _article_texts, "page_id long, url string, text string")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    `pages` has page_id, url and html; other columns are not looked at. Null and empty html give the empty text.
    Pages without a host (null url) are one host. Repeated rows give repeated results, and count as
    one page of their host. An unclosed element ends with the one around it, an attribute's open quote with its tag; a tag or
    comment cut off by the page's end is dropped, and so is the rest of the page after an unclosed script or style.
    The runs that a host's pages share are at most as many as 1 / SHARE pages have, so each group can hold them.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    digest = F.xxhash64(F.translate("article", "\n", " "), "side", "open").alias("digest")
    parsed = pages.transform(in_tasks, _parse, PARSED)
    parsed = stored(parsed.select("host", "page_id", "url", "marked", F.xxhash64("article").alias("article"), digest, "side", "open"), "parsed")
    beside = parsed.drop("article")
    contents = beside.groupBy("host", "digest").agg(F.count("*").alias("n"))
    sizes = contents.groupBy("host").agg(F.sum("n").alias("n"), F.count("*").alias("distinct"))
    large = sizes.where(F.col("n") > GROUP).select(
        "host", F.ceil(F.col("n") / F.lit(GROUP)).cast("long").alias("parts"),
        F.greatest(F.lit(PAGES), F.ceil(F.lit(SHARE) * F.col("distinct"))).cast("long").alias("least"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    # few hosts are large, so their table is met where the pages are, or else under a salt
    large = stored(large, "hosts")
    dealt = _in_groups(beside, large, F.xxhash64("page_id", "url"))
    # copies in several groups are counted by the first of them
    spots = dealt.where("parts > 1").select("host", "parts", "least", "digest", "part").distinct()
    owners = spots.groupBy("host", "digest").agg(F.min("part").alias("owner"), F.max("part").alias("last")).where("owner < last")
    others = spots.join(owners, ["host", "digest"]).where("part > owner").select("host", "parts", "least", "digest", "part", F.lit(True).alias("elsewhere"))
    rows = dealt.withColumn("elsewhere", F.lit(False)).unionByName(others, allowMissingColumns=True)
    rows = rows.repartition("host", "part").sortWithinPartitions("host", "part", "page_id", "url")
    grouped = stored(rows.transform(in_tasks, _judge_groups, GROUPED), "grouped")
    often = grouped.where(F.col("kind") == _RUN_ROW).groupBy("host", "run").agg(F.sum("n").alias("n"), F.max("least").alias("least")).where("n >= least")
    often = often.groupBy("host").agg(F.collect_list("run").alias("often"))
    waiting = grouped.where(F.col("kind") == _PAGE_ROW).select("host", "part", "page_id", "url", "side", "open")
    lists = waiting.select("host", "part").distinct().join(often, "host")
    looked = waiting.unionByName(lists, allowMissingColumns=True).repartition("host", "part")
    looked = looked.sortWithinPartitions("host", "part", F.col("often").isNull(), "page_id", "url")
    found = _marked_texts(pages, parsed, large).unionByName(grouped.where(F.col("kind") == _TEXT_ROW).select("page_id", "url", "text"))
    found = found.unionByName(looked.transform(in_tasks, _unique_runs, "page_id long, url string, text string"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
