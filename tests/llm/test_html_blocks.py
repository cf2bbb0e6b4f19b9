"""The block parser against a second, plain one, and pages that names and open tags once emptied."""

from __future__ import annotations

import random
import time
from html.parser import HTMLParser

import pytest

from graphloom.llm import html_extract as hx

P = "The house stands on a hill and it is the oldest of all the houses that were built in the town by the river. " * 3
MAIN = " ".join(P.split())


class Plain(HTMLParser):
    """Texts between block-level tags, and how many of their letters stand in links, for well-formed pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.raw, self.links, self.out, self.parts = [], 0, [], []

    def cut(self):
        text = " ".join("".join(t for t, _ in self.parts).split())
        if text:
            self.out.append((text, sum(len("".join(t.split())) for t, linked in self.parts if linked)))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in hx.RAW:
            if tag not in ("script", "style", "textarea", "template", "noscript", "iframe"):  # these leave no gap
                self.cut()
            self.raw.append(tag)
        elif not self.raw:
            if tag == "br":
                self.parts.append((" ", False))
            elif tag in hx.BLOCK_TAGS:
                self.cut()
            if tag == "a":
                self.links = int(any(k == "href" for k, _ in attrs))

    def handle_endtag(self, tag):
        if self.raw and tag == self.raw[-1]:
            self.raw.pop()
        elif not self.raw:
            if tag in hx.BLOCK_TAGS:
                self.cut()
            if tag == "a":
                self.links = 0

    def handle_data(self, data):
        if not self.raw:
            self.parts.append((data, self.links))


def plain_blocks(page):
    p = Plain()
    p.feed(page)
    p.close()
    p.cut()
    return p.out


def made_page(r, depth=0):
    word = lambda: r.choice(["the", "house", "&amp;", "a&lt;b", "caf&eacute;", "&#8364;", "x"])
    out = []
    for _ in range(r.randint(1, 4)):
        k = r.random()
        text = " ".join(word() for _ in range(r.randint(1, 9)))
        if k < 0.3 and depth < 4:
            tag = r.choice(["div", "section", "ul", "article", "td", "h2"])
            out.append(f"<{tag} class='{r.choice(['', 'side', 'post'])}'>{made_page(r, depth + 1)}</{tag}>")
        elif k < 0.5:
            out.append(f'<a href="/{r.randint(0, 9)}">{text}</a>')
        elif k < 0.6:
            out.append(f'<a name="t">{text}</a> <b>{text}</b><br/>{text}')
        elif k < 0.7:
            out.append(r.choice(["<script>if (a < b) { '<p>' }</script>", "<style>p { a: b }</style>", "<!-- <p>no</p> -->", "<svg><text>no</text></svg>"]))
        else:
            out.append(f"<p>{text}\n {text}</p>")
    return r.choice(["", " ", "\n"]).join(out)


def test_blocks_against_a_second_parser(spark, sf):
    r = random.Random(6)
    pages = [x["html"] or "" for x in spark.read.parquet(f"{sf}/pages.parquet").collect()] + [made_page(r) for _ in range(300)]
    for page in pages:
        assert [(b.text, b.linked) for b in hx.blocks(page)] == plain_blocks(page)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<a name="top"><h1>On an old house</h1><p>{P}</p><p>{P}</p>', ["On an old house", MAIN, MAIN]),
        (f'<div><p><a href="x">more<p>{P}</p></div>', [MAIN]),
        (f'<ul><li><a href="x">one<li><a href="y">two</ul><p>{P}</p>', [MAIN]),
        (f'<a href="x">home</a><a href="y">news<div><p>{P}</p></div></a><p>{P}</p>', [MAIN]),
        (f'<div class="page-side"><article><h1>Old</h1><p>{P}</p><div class="share">Share this</div></article></div>', ["Old", MAIN]),
        (f'<div class="menu-open"><main><p>{P}</p></main></div>', [MAIN]),
        (f'<div id="toc-page"><p>{P}{P}</p></div>', [f"{MAIN} {MAIN}"]),
        (f'<div class="sidebar"><article><p>{P}</p></article></div><div><p>{P}{P}</p></div>', [f"{MAIN} {MAIN}"]),
        (f'<article><p>{P}</p></article><section class="comments"><article><p>{P} zz</p></article></section>', [MAIN]),
        (f'<div id="comments"><article><p>{P}</p></article></div>', []),
        (f'<aside><article><p>{P}</p></article></aside>', []),
        (f'<div style="display: none"><article><p>{P}</p></article></div>', []),
        (f'<div class="side"><article class="comment"><p>{P}</p></article><article><p>{P}</p></article></div>', [MAIN]),
    ],
)
def test_names_and_open_tags_lose_no_text(page, want):
    assert hx.main_text(page).split("\n") == (want or [""])


def test_time_is_linear():
    def seconds(page):
        at = time.perf_counter()
        hx.main_text(page)
        return time.perf_counter() - at

    for made in (lambda n: "<div>" * n + "</span>" * n, lambda n: '<span class="x">' * n + "</b>" * n, lambda n: "<a href=x>y" * n, lambda n: "<p>" * n + "</div>" * n, lambda n: '<div class="side"><article>' * n + "x"):
        seconds(made(4000))
        small, large = min(seconds(made(8000)) for _ in range(3)), seconds(made(64000))
        assert large < 30 * small + 0.5
