"""The given pages with their article tags taken off: what repeats goes, the article's words stay."""

import random
import re
import time

import pytest

from footfall.llm import html_text


def test_articles_without_their_tags(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()
    want = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages)).collect()}
    copies = {t for t in want.values() if list(want.values()).count(t) > 1}
    bare = [(r.page_id, "http://one.org/", re.sub(r"</?article>", "", r.html)) for r in pages]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(bare, "page_id long, url string, html string")).collect()}
    words = lost = 0
    for page, text in want.items():
        if text not in copies:
            words += len(text.split())
            lost += max(0, len(text.split()) - len(got[page].split()))
    print("lost", lost, "of", words)
    assert words > 1000 and lost <= 0.02 * words


def test_copies_count_once_and_phrases_stay(spark):
    own = "<div>own words of this one page in the middle of nowhere that nobody else has</div>"
    rows = [(i, "http://h.org/", own) for i in range(5)]
    rows += [(10 + i, "http://h.org/", f"<div>page{i} a{i} one of the most b{i} c{i}</div><div>all rights reserved by us</div>") for i in range(5)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "own words of this one page in the middle of nowhere that nobody else has" for i in range(5))
    assert all(got[10 + i] == f"page{i} a{i} one of the most b{i} c{i}" for i in range(5))


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_count_as_one_host(spark, monkeypatch, seed):
    """Boilerplate of a section that each group holds on one or two pages goes; the number of groups changes nothing."""
    rng = random.Random(seed)
    runs = [" ".join(f"s{s}w{i}" for i in range(15)) for s in range(6)]
    rows = []
    for i in range(150):
        own = [f"p{i}x{k}" for k in range(20)]
        at = rng.randrange(20)
        shared = runs[i % 40] if i % 40 < 6 else ""
        rows.append((i, "http://big.org/", f"<div>{' '.join(own[:at])} {shared} {' '.join(own[at:])}</div>" + ("<p>read on at our place</p>" if i % 7 == 0 else "")))
    rows += [(200 + i, "http://big.org/", "<div>" + " ".join(f"copy{k}" for k in range(30)) + "</div>") for i in range(60)]
    rows += [(300 + i, "http://big.org/", f"<article>own {i}</article><div>{runs[5]}</div>") for i in range(10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = sorted(html_text.main_text(df).collect())
    monkeypatch.setattr(html_text, "GROUP", 10)
    assert sorted(html_text.main_text(df).collect()) == whole
    got = {r.page_id: r.text.split() for r in whole}
    assert all(got[i] == [f"p{i}x{k}" for k in range(20)] for i in range(150))
    assert all(got[200 + i][0] == "copy0" and len(got[200 + i]) == 30 for i in range(60))


def text_of(page):
    return " ".join(t for t, level, never in html_text.blocks(page) if level == 2 and not never)


def test_broken_markup():
    assert text_of('<article><p title="a>Hello</p><p>World</p></article>') == "Hello World"
    assert text_of('<article><p title="a>Hello</p><p class="x">World <a href="/y">there</a></p></article>') == "Hello World there"
    assert text_of('<article><p title="a > b" id=x>Hello</p><p data-x=\'<p>"\'>World</p></article>') == "Hello World"
    assert text_of("<article><p it's>Hello</p><p>it's</p></article>") == "Hello it's"
    assert text_of("<article><svg/><p>words</p></article>") == "words"
    assert text_of("<article><svg><p>words</p></article>") == "words"
    assert text_of("<article>a<svg><svg><text>no</text></svg><text>no</text></svg>b<SVG viewBox='0 0'></SVG>c</article>") == "abc"
    assert text_of("<article><button>press</button>a<select><option>x</select> b<object><p>no</object></article>") == "a b"
    assert text_of("<article>a<title-card>b</title-card><!--> c<!-- x --!> d<!---> e</article>") == "a b c d e"
    assert text_of("<article>a</article><script>b") == "a"
    assert text_of('<article><p class="share-price">a</p><p class="menu-item">b</p><p class="share-buttons">c</p><p class="x related">d</p><ol class="comment-list"><li>e</ol>f</article>') == "a b f"


def test_odd_pages_take_linear_time():
    for page in ("<button>" * 100_000, "<p title=\"a" * 50_000, "<" * 200_000, "<a b='" * 50_000 + ">", "<!--" * 50_000, "<svg>" * 50_000 + "</svg>", "=\"'" * 100_000):
        began = time.time()
        html_text.blocks("<article>" + page)
        assert time.time() - began < 5, page[:10]
