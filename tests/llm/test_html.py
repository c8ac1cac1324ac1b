"""HTML extraction: time, names that only weigh, and a plain extractor that knows the synthetic pages' layout."""

import html as entities
import re
import time
from pathlib import Path

import pytest

from curaspark.llm import html

DATA = Path("/root/testdata/sf0.01/pages.parquet")
LONG = "One long sentence, with marks. " * 8
P = LONG.strip()


@pytest.mark.parametrize(
    "page",
    [
        "<a" * 500_000,
        "<div>" * 100_000 + "x, y." + "</div>" * 100_000,
        "<article><p>" + "word, and. " * 90_000,
        '<a "' * 250_000 + ">",
        "<b>" * 100_000 + "</i>" * 100_000 + "x, y.",
        "<x-y>" * 50_000 + "<li>" * 50_000,
        "&#" + "9" * 1_000_000 + ";",
        '<p class="' + "ad-" * 300_000 + '">x, y.',
    ],
    ids=range(8),
)
def test_time_is_linear(page):
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 4


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<div class="content has-sidebar"><p>{P}</p><p>{P}</p></div>', [P, P]),
        (f'<div id="story-related"><p>{P}</p><p>{P}</p></div>', [P, P]),
        (f'<article><div class="post-header"><h1>Head</h1></div><p>{P}</p><math><mi>x</mi></math><address>Here</address><object>o</object><canvas>c</canvas></article>', ["Head", P, "x", "Here", "o", "c"]),
        (f"<form id=all><div><h1>Head</h1><p>{P}</p><p>{P}</p><input></div></form>", ["Head", P, P]),
        (f'<div class="cookie-banner">We, use.</div><div id=page><h2>Head</h2><p>{P}</p><ul><li>one</li><li>two</li></ul><p>{P}</p></div><div class=comments><p>{P * 5}</p></div><div class=site-footer>f</div>', ["Head", P, "one", "two", P]),
        (f"<aside><p>{P * 9}</p></aside><main><p>{P}</p></main>", [P]),
        (f'<article><p>{P}</p><div class="post-comments"><p>{P * 9}</p></div></article>', [P]),
        (f"<article><p>{P}</p><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul></article>", [P]),
        ("<div class=ad>Buy, now.</div>", []),
        ("<p>x<span hidden>no<span>no</span>no</span>y, z.</p>", ["xy, z."]),
        ("a < b &amp; c, &#0000000065;&#99999999999;", ["a < b & c, A�"]),
    ],
)
def test_names_only_weigh(page, text):
    assert html.main_text(page) == "\n".join(text)


@pytest.mark.skipif(not DATA.exists(), reason="tables are absent")
def test_agrees_with_a_plain_extractor(spark):
    """Every synthetic page has one article; its blocks are what stands between tags of block level."""
    for r in html.extract(spark.read.parquet(str(DATA)).withColumnRenamed("url", "N_CHARS")).collect():
        article = re.search("<article>(.*)</article>", r.html, re.S)[1]
        pieces = re.split(r"</?(?:p|h1)>", re.sub("<br>", " ", article))
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", "", x)).split()) for x in pieces]
        assert r.text == "\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


def test_empty_table(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
