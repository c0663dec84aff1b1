"""Main text: regions by brute force, marked and broken pages, long adversarial pages, learned weights, odd rows."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstore.llm import html_text

PARA = "Some real words stand here now and more of them follow. " * 8
ARTICLE = f"<article><h1>Title here</h1><p>{PARA}</p><p>End.</p></article>"
TEXT = f"Title here\n{PARA.strip()}\nEnd."


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-4, 4).map(float), max_size=14))
def test_best_region_against_all_regions(scores):
    total, first, end = html_text.best_region(scores)
    every = {(a, b): sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)}
    most = max(every.values(), default=0.0)
    assert total == max(0.0, most) and (sum(scores[first:end]) == total)
    assert (first == end) == (most <= 0)


@pytest.mark.parametrize(
    "before, after",
    [
        ('<div class="content-with-sidebar">', "</div>"),
        ('<div class="no-sidebar page">', "</div>"),
        ('<main class="has-comments">', "</main>"),
        ('<div class="search-results">', "</div>"),
        ('<section id="related-work">', "</section>"),
        ('<div class="ad"><p>Buy!</p>', ""),
        ('<nav><a href="x">Home</a>', ""),
        ('<form id="whole-page">', "</form>"),
        ("<title>never closed", ""),
        ("<select><option>one", "</select>"),
    ],
)
def test_articles_in_marked_or_unclosed_elements(before, after):
    page = f"<html><body><div><h2>Site</h2></div>{before}{ARTICLE}{after}<footer>all rights</footer></body></html>"
    if before.startswith("<select>"):
        page = page.replace(ARTICLE, "").replace("</select>", "</select>" + ARTICLE)
    assert html_text.main_text(page) == TEXT


def test_comments_longer_than_the_article_and_marks_inside():
    comments = "".join(f"<article><p>{PARA}</p></article>" for _ in range(20))
    for box in ('<section class="comments">', '<div id="disqus_thread">', '<div class="post-comments">'):
        assert html_text.main_text(f"<body>{ARTICLE}{box}{comments}</section></body>") == TEXT
    ad = '<div class="ad-box">Buy this now, it is good and you need it, really, buy buy buy buy</div>'
    assert html_text.main_text(f"<body><p>{PARA}</p>{ad}<p>{PARA}</p></body>") == f"{PARA.strip()}\n{PARA.strip()}"
    links = "<a href=x>Another article of ours to read next</a> " * 8
    assert html_text.main_text(f'<body>{ARTICLE[:-10]}<div class="related">{links}</div></article></body>') == TEXT
    assert html_text.main_text('<div class="siteHeader">My site of many things</div><p class="cookieNotice">We use cookies</p>' + ARTICLE) == TEXT


@pytest.mark.parametrize("unit", ['<a "', '<a ="\' ', "<a =\"'>", "<!--", "<![CDATA[", "<p><b>", "</i><b>", "<title>", '<div class="ad">x ', "<nav>a b <article>c ", "<li><ul>", "&#", "<", "</", "<script"])
def test_long_pages_take_linear_time(unit):
    began = time.process_time()
    html_text.main_text(unit * (1_000_000 // len(unit)))
    assert time.process_time() - began < 2


def test_learned_weights_decide():
    """Where articles are made of list items, these come to cost little; menus of the same tags stay out by what surrounds them."""
    items = "".join(f"<li>Item {k}</li>" for k in range(40))
    page = f"<body><p>{PARA}</p><ul>{items}</ul></body>"
    assert "Item 3" not in html_text.main_text(page)
    assert "Item 39" in html_text.main_text(page, html_text.DEFAULT_WEIGHTS | {"li": 0.05, "ul": 0.05})


def test_weights_are_learned_from_labelled_pages(spark):
    items = "".join(f"<li>Item {k}</li>" for k in range(40))
    labelled = [(k, "u", f"<body><div><div>x</div></div><article><p>{PARA}</p><ul>{items}</ul></article></body>") for k in range(5)]
    odd = [(7, "u", f"<body><p>{PARA}</p><ul>{items}</ul></body>"), (8, None, None), (None, "u", ARTICLE), (7, "u", ARTICLE), (9, "u", "<p>" + "long words " * 200_000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in labelled + odd], "page_id long, url string, html string, text string, n_chars int")
    weights = html_text.fit_weights(pages)
    assert weights["li"] < html_text.DEFAULT_WEIGHTS["li"] and weights["div"] > 1
    got = html_text.extract_text(pages).collect()
    by = {(r.page_id, r.n_chars): r.text for r in got}
    assert len(got) == len(labelled) + len(odd) and any("Item 39" in t for (i, _), t in by.items() if i == 7)
    assert by[8, 0] == "" and by[None, len(TEXT)] == TEXT and by[7, len(TEXT)] == TEXT and by[9, 11 * 200_000 - 1].startswith("long")
