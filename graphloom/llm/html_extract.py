"""Main-text extraction from HTML by two passes of block rules."""

from __future__ import annotations

import bisect
import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import map_batches, slices

#: Frequent function words of the languages that are told apart by density.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
    "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wie wir zu zum zur "
    "al como con de del el en entre es esta este fue ha la las lo los más no o para pero por que se sin sobre su sus un una y ya "
    "au aux avec ce ces cette dans des du elle en est et être il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses son sur une vous".split()
)
#: Elements whose content is no text at all.
RAW = frozenset(("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "head", "select", "textarea", "button"))
#: Elements that no text of an article stands in, and those that it may stand in if it is long and dense.
CLOSED_TAGS = frozenset(("nav", "footer", "aside", "menu", "dialog"))
RAISED_TAGS = frozenset(("form", "header"))
MAIN_TAGS = frozenset(("article", "main"))
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Parts of class, id and role values that mark what readers see beside an article, and those that may also wrap one.
CLOSED_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|newsletter|subscribe|signup|nav\w*|menu\w*|breadcrumbs?|footer|sidebar|side|widget\w*|related|recommend\w*|share|sharing|social|comments?|commentlist|replies|reply|respond|disqus|discussion|pagination|pager|copyright|legal|toolbar|tags|toc|skip\w*|complementary|contentinfo|navigation|dialog|alertdialog)(?=$|[\s_\d-])",
    re.I,
)
#: Those of them that stay closed whatever they hold; others may turn out to wrap a page.
FIRM_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|newsletter|subscribe|signup|related|recommend\w*|comments?|commentlist|replies|reply|respond|disqus|discussion|footer|contentinfo|dialog|alertdialog)(?=$|[\s_\d-])",
    re.I,
)
RAISED_NAMES = re.compile(r"(?:^|[\s_-])(?:form|search\w*|login|header|masthead|banner)(?=$|[\s_\d-])", re.I)
#: Names that only say what stands beside an element, or not.
_BESIDE = re.compile(r"\b(?:has|with|no|without)[-_]\S+", re.I)
#: Names of headings, which belong to an article that they stand in.
_HEADING = re.compile(r"(?:^|[\s_-])(?:header|masthead|banner)(?=$|[\s_\d-])", re.I)
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article|articlebody|post-?content|entry-?content|article-?body|post-?body|main-?content|story)(?=$|[\s_-])", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
#: Names that make an article element one of a reader or an advertiser.
_OTHERS = re.compile(r"(?:^|\s)(?:comments?|comment-(?:item|body|content|text|entry)|reply|replies|ads?|advert\w*|sponsored|promo)(?=$|\s)", re.I)
_HREF = re.compile(r"(?:^|\s)href(?=\s*=)", re.I)
_MARKS = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[^\W\d_]+")

#: Kinds of regions: what an element says of the text in it.
MAIN, PLAIN, RAISED, CLOSED = 1, 0, -1, -2


@dataclass(frozen=True)
class Thresholds:
    """The most link density of text; the characters and the share of stop words from which a block is text; whether a long block without stop words is out; how many of two unlike neighbours make text of an open block (0: the nearer decides)."""

    links: float
    long: float
    stop: float
    sparse_out: bool
    votes: int


#: Thresholds by region. Elements and names only shift them; in a closed region none is in reach, but see :func:`reopen`.
THRESHOLDS = {
    MAIN: Thresholds(0.99, 25, 0.10, False, 1),
    PLAIN: Thresholds(0.33, 70, 0.15, True, 0),
    RAISED: Thresholds(0.10, 400, 0.30, True, 2),
    CLOSED: Thresholds(0.0, math.inf, 1.0, True, 2),
}
#: Characters from which a block without stop words is out, where that counts.
SPARSE = 210


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    region: int = 0
    kind: int = PLAIN
    text: str = ""
    label: int = 0
    rule: str = ""
    #: In a closed region that only a name closed, one that may also wrap a page; and there within an article.
    soft: bool = False
    inner: bool = False


def _kind(tag: str, attributes: str, inside_main: bool) -> int:
    """The kind of region that an element opens; PLAIN if none."""
    if tag in CLOSED_TAGS:
        return CLOSED
    if tag in RAISED_TAGS:
        # a header within an article holds its headings
        return PLAIN if tag == "header" and inside_main else RAISED
    kind = MAIN if tag in MAIN_TAGS else PLAIN
    if "=" not in attributes and "hidden" not in attributes or tag in ("body", "html"):
        return kind
    for name, *values in _MARKS.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return CLOSED
        if name in ("class", "id", "role"):
            value = _BESIDE.sub("", value)
            if inside_main:
                value = _HEADING.sub("", value)
            if tag in MAIN_TAGS and _OTHERS.search(value):
                return CLOSED
            if MAIN_NAMES.search(value) or name == "role" and value.lower() == "main":
                kind = MAIN
            elif kind == PLAIN and CLOSED_NAMES.search(value):
                kind = CLOSED
            elif kind == PLAIN and RAISED_NAMES.search(value):
                kind = RAISED
    return kind


def _letters(text: str) -> int:
    return len("".join(text.split()))


def _softly(tag: str, attributes: str) -> bool:
    """Whether an element that opens a closed region does so by a name alone, and by none of FIRM_NAMES."""
    if tag in CLOSED_TAGS:
        return False
    for name, *values in _MARKS.findall(attributes):
        if name.lower() not in ("class", "id", "role") or FIRM_NAMES.search(_BESIDE.sub("", "".join(values))):
            return False
    return True


#: Elements that end an open one of their kind.
_LISTED = frozenset(("li", "dd", "dt", "tr", "td", "th", "option"))


@dataclass(frozen=True)
class Around:
    """What stands around a place of a page: the kind and number of its region; whether a name alone has closed it, and an article opened within."""

    kind: int = PLAIN
    region: int = 0
    soft: bool = False
    inner: bool = False


class Link:
    """Whether text stands in a link: in an ``a`` with href, until its end tag, the next ``a``, or the end of the block that it began in, whichever comes first."""

    def __init__(self) -> None:
        self.on = False
        self.block = ""
        self.inside = 0

    def anchor(self, opens: bool, block: str) -> None:
        self.on, self.block, self.inside = opens, block, 0

    def block_tag(self, tag: str, closing: bool) -> None:
        if not self.on:
            return
        if self.inside:
            self.inside += -1 if closing else 1
        elif closing or self.block == "p" or self.block == tag and tag in _LISTED:
            self.on = False
        else:
            self.inside = 1


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order: what stands between block-level tags. Unclosed and stray tags are tolerated; time is linear in the page."""
    out: list[Block] = []
    block = Block()
    stack: list[tuple[str, Around]] = []  # element, and what stands around it
    opened: Counter[str] = Counter()  # elements on the stack
    around, regions, link, last = Around(), 0, Link(), ""
    raw = None
    at = 0

    def flush() -> None:
        nonlocal block
        if block.parts:
            block.text = " ".join(html.unescape("".join(block.parts)).split())
            if block.text:
                block.kind, block.region, block.soft, block.inner = around.kind, around.region, around.soft, around.inner
                out.append(block)
        block = Block()

    def add(text: str) -> None:
        if text:
            block.parts.append(text)
            if link.on:
                block.linked += _letters(html.unescape(text))

    def leave(n: int) -> None:
        """Close the innermost elements until ``n`` are open."""
        nonlocal around
        around = stack[n][1]
        for name, _ in stack[n:]:
            opened[name] -= 1
        del stack[n:]

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if raw is None:
            add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA[") and raw is None:
                add(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in ("script", "style", "textarea", "template", "noscript", "iframe") and not closing:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in RAW:
            if raw is None and not closing and not m[3].endswith("/"):
                flush()
                raw = tag
            elif closing and raw == tag:
                raw = None
            elif raw == "head" and tag == "head":
                raw = None
            continue
        if raw is not None:
            if raw == "head" and tag == "body":
                raw = None
            else:
                continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
            if tag not in VOID:
                link.block_tag(tag, closing)
                last = "" if closing else tag
        if tag == "a":
            link.anchor(not closing and _HREF.search(m[3]) is not None, last)
        if tag in VOID:
            continue
        if closing:
            if opened[tag]:
                flush()
                n = len(stack) - 1
                while stack[n][0] != tag:
                    n -= 1
                leave(n)
        elif tag in BLOCK_TAGS and stack and stack[-1][0] == "p":  # ends an open paragraph
            leave(len(stack) - 1)
        if closing:
            continue
        if tag in BLOCK_TAGS or tag in ("span", "a", "b", "i", "em", "strong", "small") and m[3]:
            shut = around.kind == CLOSED
            own = _kind(tag, m[3], around.kind == MAIN)
            firm = shut and around.soft and own == CLOSED and (around.inner or not _softly(tag, m[3]))
            inner = shut and around.soft and own == MAIN and not around.inner
            enters = (firm or inner) if shut else own != PLAIN
            if enters or tag in ("div", "section", "ul", "ol", "table"):
                if enters:
                    flush()
                stack.append((tag, around))
                opened[tag] += 1
                if enters:
                    regions += 1
                    around = Around(CLOSED, regions, inner, inner) if shut else Around(own, regions, own == CLOSED and _softly(tag, m[3]))
    if raw is None:
        add(page[at:])
    flush()
    return out


def _dense(b: Block) -> bool:
    t = THRESHOLDS[PLAIN]
    return b.linked <= t.links * _letters(b.text) and len(b.text) >= t.long and stop_density(b.text) >= t.stop


def reopen(page_blocks: list[Block]) -> None:
    """Open what a name has closed where it wraps the page: names shift thresholds, they don't lose a page's text.

    On a page without an article elsewhere, articles in such regions are articles if more text stands in them than outside. Where no dense text
    stands outside at all, blocks of such regions count as text if they pass raised thresholds.
    """
    soft = [b for b in page_blocks if b.soft]
    if not soft or any(b.kind == MAIN for b in page_blocks):
        return
    size = lambda some: sum(len(b.text) for b in some if _dense(b))
    outside, inner = size(b for b in page_blocks if b.kind != CLOSED), [b for b in soft if b.inner]
    if size(inner) > outside:
        for b in inner:
            b.kind = MAIN
    elif not outside:
        for b in soft:
            b.kind = RAISED


def stop_density(text: str) -> float:
    """The share of stop words among the words of letters."""
    words = [w.lower() for w in _WORDS.findall(text)]
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def classify(page_blocks: list[Block]) -> None:
    """Label blocks 1 (main text) or -1, in two passes, and note the rule that decided.

    First pass, by the thresholds of the block's region: too many of its characters in links, out
    (``links``); long and with enough stop words, in (``dense``); very long without any, out
    (``sparse``; not within an article); short of thresholds that are out of reach, out (``closed``). The others stay open.

    Second pass: an open block inherits from the nearest decided blocks before and after it in its
    region (``neighbours``); one that stands in no region looks at the whole page if need be. If these two differ, one of text is
    enough within an article, the nearer decides elsewhere (the one before if they are as near), and both
    are needed where thresholds are raised. Without a decided neighbour it is in, but where thresholds are
    raised (``alone``). On pages with an article, what stands in no region has raised thresholds.
    """
    reopen(page_blocks)
    article = any(b.kind == MAIN for b in page_blocks)
    for b in page_blocks:
        if article and b.kind == PLAIN:
            b.kind = RAISED
        t = THRESHOLDS[b.kind]
        if b.linked > t.links * max(1, _letters(b.text)):
            b.label, b.rule = -1, "links"
        elif b.kind == CLOSED:
            b.label, b.rule = -1, "closed"
        elif len(b.text) >= min(t.long, SPARSE):
            density = stop_density(b.text)
            if len(b.text) >= t.long and density >= t.stop:
                b.label, b.rule = 1, "dense"
            elif t.sparse_out and len(b.text) >= SPARSE and density == 0:
                b.label, b.rule = -1, "sparse"
    regions: dict[int, list[int]] = {}
    for i, b in enumerate(page_blocks):
        if b.label:
            regions.setdefault(b.region, []).append(i)
    inherited: list[tuple[Block, int]] = []
    every = [i for i, b in enumerate(page_blocks) if b.label and b.kind != CLOSED] or [i for i, b in enumerate(page_blocks) if b.label]
    for i, b in enumerate(page_blocks):
        if b.label:
            continue
        votes = THRESHOLDS[b.kind].votes
        own = regions.get(b.region) or (every if b.kind == PLAIN else [])
        at = bisect.bisect(own, i)
        near = [*own[max(at - 1, 0) : at], *own[at : at + 1]]
        labels = [page_blocks[j].label for j in near]
        b.rule = "neighbours" if near else "alone"
        if not near:
            new = -1 if b.kind == RAISED else 1
        elif len(set(labels)) == 1:
            new = labels[0]
        else:
            new = {1: 1, 2: -1}.get(votes) or (labels[1] if near[1] - i < i - near[0] else labels[0])
        inherited.append((b, new))
    for b, new in inherited:
        b.label = new


def main_text(page: str) -> str:
    found = blocks(page)
    classify(found)
    return "\n".join(b.text for b in found if b.label > 0)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        texts = [main_text(x or "") for x in part.column("__html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Character references are decoded, white space within a block becomes one
    space, blocks are trimmed and joined by ``\\n`` in page order. Null and empty pages, and
    pages without main text, have an empty text. Repeated rows each get their row; extra columns
    are ignored. Pages are independent: nothing is shuffled.
    """
    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("__html"))
    return map_batches(d, _extract, f"page_id {d.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
