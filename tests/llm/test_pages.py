"""Line blocks of pages against a plain version over trees, and what must not shut text out."""

import random
import time

import pytest

from orbweave.llm import html_extract
from tests.llm import brute

LONG = [f"Paragraph {k} of text that goes on and on for a while, and a while more." for k in range(5)]


def render(node):
    if isinstance(node, str):
        return node
    tag, name, children = node
    return f"<{tag}{f' class={chr(34)}{name}{chr(34)}' if name else ''}>{''.join(map(render, children))}</{tag}>"


def tree(rng, article):
    words = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(n))
    name = lambda: rng.choice([None, None, *brute.PAGE_MARKS])

    def block(depth):
        tag = rng.choices(["p", "h2", "div", "section", "nav", "aside", "footer", "form", "menu"], [8, 2, 3, 2, 0.5, 0.5, 0.5, 0.3, 0])[0]
        if tag in ("div", "section") and depth:
            return (tag, name(), [block(depth - 1) for _ in range(rng.randrange(4))])
        inner = [words(rng.choice([1, 3, 12, 40]))]
        if rng.random() < 0.3:
            inner.append(("a", None, [words(rng.choice([1, 6, 30]))]))
        return (tag, name(), inner)

    parts = [block(2) for _ in range(rng.randrange(1, 6))]
    if article:
        parts.insert(rng.randrange(len(parts) + 1), ("article", None, [block(2) for _ in range(rng.randrange(6))]))
        if rng.random() < 0.3:
            parts.append(("div", rng.choice(["comments", "lead"]), [("article", None, [block(1)])]))
    return ("body", None, parts)


@pytest.mark.parametrize("article", [True, False])
def test_as_the_plain_version(article):
    rng = random.Random(11 + article)
    kept = 0
    for _ in range(1500):
        t = tree(rng, article)
        want = brute.page_text(t)
        assert html_extract.main_text(render(t)) == want, render(t)
        kept += bool(want)
    assert kept > 500


def test_names_of_headings_shut_nothing_out():
    page = f"<article><h2 id='related-work'>Related work</h2><section id='form-and-function'><p>{LONG[0]}</p></section><p class='ad-hoc'>{LONG[1]}</p><h3 id='comments'>Comments on it</h3><p class='search results'>{LONG[2]}</p><p role='note'>{LONG[3]}</p></article>"
    assert html_extract.main_text(page) == "\n".join(["Related work", LONG[0], LONG[1], "Comments on it", LONG[2], LONG[3]])


def test_marked_parts_inside_an_article_stay_out():
    page = f"<article><p>{LONG[0]}</p><div class='box ad'><p>{LONG[1]}</p></div><div role='navigation'>x</div><aside><p>{LONG[2]}</p></aside><ol class='Comments'><li>{LONG[3]}</li></ol><p>{LONG[4]}</p></article>"
    assert html_extract.main_text(page) == f"{LONG[0]}\n{LONG[4]}"


def test_links_are_no_text_on_unmarked_pages():
    menu = "".join(f"<div><a href='/{k}'>Another page of this site, number {k}</a></div>" for k in range(9))
    page = f"{menu}<h1>Title</h1><p>{LONG[0]} <a href='x'>here</a></p><p>Short.</p><p>{LONG[1]}</p><p>End.</p>{menu}<p>All rights reserved</p>"
    assert html_extract.main_text(page) == f"Title\n{LONG[0]} here\nShort.\n{LONG[1]}\nEnd."
    assert html_extract.main_text(f"<article>{menu}</article>").count("\n") == 8  # an article of links is one


def test_a_long_text_outweighs_its_mark():
    """On a page without an article the lists only lower density."""
    body = "word " * 700
    assert html_extract.main_text(f"<div class='notice'><p>{body}</p></div><p>x</p>").startswith("word word")


@pytest.mark.parametrize("piece", ["<div>", "<x>", "<a \"", "<a href=\"x", "<p title='", "<td><p>", "<p><li>", "<!--", "<script>", "</p>", "&amp;<", "<article><div class='ad'>"])
def test_broken_pages_take_linear_time(piece):
    times = []
    for n in (10_000, 40_000):
        page = piece * n + "</p>" * n + "<b>end"
        began = time.perf_counter()
        html_extract.main_text(page)
        times.append(time.perf_counter() - began)
    assert times[1] < 12 * times[0] + 0.3


def test_quotes_that_are_not_closed():
    assert html_extract.main_text(f"<article><p title=a\"b>{LONG[0]}<p class='x>{LONG[1]}</article>") == LONG[0]
    assert html_extract.main_text(f"<article><a href=\"x\"\">{LONG[0]}</a></article>") == LONG[0]
