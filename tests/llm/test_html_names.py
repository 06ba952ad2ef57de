import random

import pytest

from loomwright.llm.html import extract, extract_pages, parse


@pytest.mark.parametrize("inside", ['<h2 id="related-work">kept</h2>', '<h2 id="search">kept</h2>', *(f'<section id="{x}"><p>kept</p></section>' for x in ("side-effects", "search-methods", "social-history", "notice-period"))])
def test_slugs_of_articles_stay(inside):
    assert extract(parse(f"<article><p>a</p>{inside}<p>b</p></article>"), set()) == "a\n\nkept\n\nb"


@pytest.mark.parametrize("name", ["comments", "ad-banner", "site-footer", "share_buttons", "nav-bar", "story related-posts", "cookie-notice"])
def test_whole_names_go(name):
    assert extract(parse(f"<article><p>a</p><div class='{name}'>gone</div><p>b</p></article>"), set()) == "a\n\nb"


@pytest.mark.parametrize("name", ["navy", "navarre", "promotion", "cookies", "foot", "side", "social", "share", "menus", "advertising-history"])
def test_sections_named_by_their_headings_stay(name):
    assert extract(parse(f'<article><h1>T</h1><section id="{name}"><p>Body text here.</p></section></article>'), set()) == "T\n\nBody text here."


def test_headings_of_an_articles_header_stay():
    page = "<body><header><h1>Site</h1></header><article><header><nav>x</nav><hgroup><h1>Title</h1></hgroup><p>by</p></header><object>o</object><dialog>d</dialog><p>x</p></article></body>"
    assert extract(parse(page), set()) == "Title\n\no\n\nd\n\nx"
    assert extract(parse("<body><header><h1>Site</h1></header><p>x</p></body>"), set()) == "x"


def test_sections_of_many_pages_stay(spark):
    rng = random.Random(1)
    words = lambda: " ".join("".join(rng.choices("etaoinshr", k=rng.randrange(2, 9))) for _ in range(25))
    rows, want = [], {}
    for i in range(30):
        parts = [words() for _ in range(7)]
        body = f"<h1>{parts[0]}</h1><p>{parts[1]}</p><section id='navy'><p>{parts[2]}</p><p>{parts[3]}</p></section><section class='promotion'><p>{parts[4]}</p><p>{parts[5]}</p></section><p>{parts[6]}</p>"
        rows.append((i, f"https://h.org/{i}", f"<html><body><nav>menu</nav><div class='w'>{body}<div class='comments'><p>{words()}</p></div></div><footer>f</footer></body></html>"))
        want[i] = "\n\n".join(parts)
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in got.collect()} == want
