"""Furniture inside marked articles: what most articles of a host hold goes; passages, near copies and other hosts' texts stay."""

import random
from collections import Counter

import pytest

from footfall.llm import html_text

SCHEMA = "page_id long, url string, html string"
LETTER = "sign up now for our letter and get the best of the week each sunday morning"
ASK = "tell us your own view"


def texts_of(spark, rows):
    return {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def words(page, n=40):
    return " ".join(f"p{page}x{k}" for k in range(n))


def article(page, *more):
    return f"<article><h1>Headline {page}</h1><p>{words(page)}</p>{''.join(f'<div>{x}</div>' for x in more)}</article>"


def furnished(n=40):
    """A letter to sign up for in all articles of h.org, a question in most; a passage in a third, seven articles of a small host."""
    passage = " ".join(f"quoted{k}" for k in range(15))
    rows, want = [], {}
    for i in range(n):
        more = [LETTER] + [ASK] * (i % 8 > 0) + [passage] * (i % 3 == 0)
        rows.append((i, f"http://h.org/{i}", article(i, *more)))
        want[i] = f"Headline {i} {words(i)}" + (f" {passage}" if i % 3 == 0 else "")
    for i in range(1000, 1007):
        rows.append((i, f"http://small.org/{i}", article(i, LETTER)))
        want[i] = f"Headline {i} {words(i)} {LETTER}"
    rows += [(2000 + i, f"http://h.org/copy{i}", rows[3][2]) for i in range(n)]
    want.update({2000 + i: want[3] for i in range(n)})
    return rows, want


def test_furniture_of_articles_goes(spark):
    rows, want = furnished()
    assert texts_of(spark, rows) == want


def test_groups_of_articles_count_as_one_host(spark, monkeypatch):
    rows, want = furnished(60)
    monkeypatch.setattr(html_text, "GROUP", 40)
    assert texts_of(spark, rows) == want


def test_main_parts_and_runs_inside_a_block(spark):
    rows = [(i, "http://h.org/", f'<div class="post"><p>{words(i, 20)} {LETTER} {words(i + 100, 20)}</p></div>') for i in range(12)]
    assert texts_of(spark, rows) == {i: f"{words(i, 20)} {words(i + 100, 20)}" for i in range(12)}


def test_near_copies_stay_whole(spark):
    rows = [(i, "http://h.org/", f"<article><p>{words(0)}</p><p>{words(1)}</p><p>edited by person{i} on the day</p></article>") for i in range(30)]
    rows += [(100 + i, "http://h.org/", article(i + 100)) for i in range(5)]
    want = {i: f"{words(0)} {words(1)} edited by person{i} on the day" for i in range(30)}
    assert texts_of(spark, rows) == want | {100 + i: f"Headline {i + 100} {words(i + 100)}" for i in range(5)}


def test_beside_and_inside_count_apart(spark):
    """A teaser that stands beside every article doesn't go from its own one; furniture of articles stays out of pages without one."""
    rows = [(i, "http://h.org/", f"<div>{words(0)}</div>{article(i)}") for i in range(20)]
    rows += [(100, "http://h.org/", f"<div>{words(7)}</div>")]
    want = {i: f"Headline {i} {words(i)}" for i in range(20)}
    assert texts_of(spark, rows) == want | {100: words(7)}


@pytest.mark.parametrize("least", [2, 3])
def test_held_runs_by_brute_force(least):
    rng = random.Random(least)
    words = [rng.choice("abc") for _ in range(30)]
    articles = [[words[rng.randrange(12) : rng.randrange(12, 30)] for _ in range(rng.randrange(1, 4))] for _ in range(15)]
    prints, held = html_text.Prints(), Counter()
    for blocks in articles:
        runs = {("run", tuple(b[k : k + html_text.RUN])) for b in blocks for k in range(len(b) - html_text.RUN + 1)}
        held.update(runs | {("whole", tuple(b)) for b in blocks if len(b) >= html_text.WHOLE})
    want = {}
    for (kind, tokens), n in held.items():
        if n >= least:
            runs, whole = prints.of(list(tokens))
            want[int(runs[0] if kind == "run" else whole)] = n
    numbers, counts = html_text.held_by(articles, least, prints)
    assert len(numbers) > 3 and dict(zip(numbers, counts, strict=True)) == want


def test_streams_shorter_than_a_run():
    for n in range(1, 20):
        block = [f"w{k}" for k in range(n)]
        assert [mask.tolist() for mask in html_text.covered([[block]])[0]] == [[False] * n]
        assert html_text.held_by([[block]], 2, html_text.Prints()) == ([], [])
