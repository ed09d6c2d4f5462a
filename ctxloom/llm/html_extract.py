"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. Features of a block are its words and link density,
those of its neighbours, and what the markup around it hints at (an article, or a menu, footer, form, advert ...). A CART
tree tells content from the rest. It is trained here on a small labelled table: the blocks of pages that are made up by rule, with
and without markup that helps, and with names that mislead. One map over the pages, no shuffle.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ctxloom.llm._common import map_in_pandas

# HTML vocabulary.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html"
    " legend li link main menu meta nav ol option p pre section select summary table tbody td tfoot th thead title tr ul button label input textarea iframe".split()
)
CONTAINERS = frozenset("article aside blockquote button div dialog details fieldset figure footer form head header label main menu nav noscript ol section select svg table td template tr ul li object".split())
RAW_TAGS = frozenset("script style title textarea noscript template iframe svg".split())
BOILER_TAGS = frozenset("aside button dialog fieldset footer form head header label menu nav noscript select svg template object".split())
MAIN_TAGS = frozenset("article main".split())
BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs footer foot header masthead"
    " cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search social share sharing related recommended trending"
    " comment comments commentlist respond reply replies disqus widget toolbar copyright legal pagination pager skip hidden complementary contentinfo form dialog".split()
)
MAIN_NAMES = frozenset("article post entry content story main body text".split())
COMMENT_NAMES = frozenset("comment comments commentlist respond reply replies responses disqus discussion discussions feedback".split())
HEAD_NAMES = frozenset("header head heading masthead".split())
#: A name that begins so tells of the page's layout, not of what the tag holds.
LAYOUT_NAMES = frozenset("with without has have no is show hide js".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[a-z]+", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW_TAGS}
_CUE = re.compile(r"©|\(c\)\s|all rights reserved|copyright|cookies?\b|privacy policy|terms of (use|service)|sign up|subscribe|log ?in\b|advertisement", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    boiler: float  # 1 for a tag or a name of boilerplate, 0.5 for a name that only mentions it, and for the head of an article
    main: bool
    heading: bool


def _hints(attributes: str) -> tuple[float, bool]:
    """What the class, id and role names of a tag hint at: boilerplate, and main text.

    A compound name is what its last part says, or boilerplate if it also names main text (``main-menu``, ``sidebar-content``);
    the head of an article (``entry-header``) is neither.
    """
    boiler, about = 0.0, False
    for name in (w for v in _NAMES.findall(attributes) for w in v.strip("\"'").lower().split()):
        parts = _PART.findall(name)
        if not parts or len(parts) > 1 and parts[0] in LAYOUT_NAMES:
            continue
        some, main = set(parts) & BOILER_NAMES, bool(set(parts) & MAIN_NAMES)
        if set(parts) & COMMENT_NAMES or some and (name in BOILER_NAMES or parts[-1] in BOILER_NAMES or main) and not (main and some <= HEAD_NAMES):
            boiler = 1.0
        elif some and not main:
            boiler = max(boiler, 0.5)
        elif main and not some:
            about = True
    return boiler, about and boiler < 1.0


def blocks(page: str | None) -> list[Block]:
    """The page's non-empty text blocks in order: white space is one space, character references are decoded."""
    if not page:
        return []
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, float, bool]] = []  # tag, boiler, main: those of the ancestors count too
    link = heading = False

    def close() -> None:
        nonlocal parts
        if parts:
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                boiler, main = stack[-1][1:] if stack else (0.0, False)
                out.append(Block(text, text.count(" ") + 1, sum(len(p.split()) for p, linked in parts if linked), boiler, main, heading))
            parts = []

    at = 0
    while True:
        found = _TAG.search(page, at)
        if text := page[at : found.start() if found else len(page)]:
            parts.append((html.unescape(text), link))
        if not found:
            break
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            if found[0].startswith("<![CDATA["):
                parts.append((found[0][9:].removesuffix("]]>"), link))
            continue
        closing, attributes = bool(found[1] or found[4]), found[3] or found[6] or ""
        if tag == "a":
            link = not closing
        if tag in RAW_TAGS and not closing:
            if tag in BLOCK_TAGS:
                close()
            if not attributes.endswith("/"):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag not in BLOCK_TAGS and tag not in CONTAINERS:
            continue
        close()
        heading = not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        if tag == "body" and not closing:
            stack, link = [], False
        elif closing and any(x[0] == tag for x in stack):
            while stack.pop()[0] != tag:
                pass
            link = False
        elif not closing and tag in CONTAINERS and not attributes.endswith("/"):
            if tag == "li" and stack and stack[-1][0] == "li":
                stack.pop()
            if tag in MAIN_TAGS:  # menus and heads that were never closed hold no article
                while stack and stack[-1][0] in ("nav", "head", "header", "footer", "ul", "li") and stack[-1][1] == 1.0:
                    stack.pop()
            hint, about = _hints(attributes) if attributes else (0.0, False)
            boiler, main = stack[-1][1:] if stack else (0.0, False)
            own = max(hint, 0.5 if tag == "header" and main else 1.0 if tag in BOILER_TAGS else 0.0)
            stack.append((tag, max(boiler, own), (main or tag in MAIN_TAGS or about) and own < 1.0))
    close()
    return out


FEATURES = ("words", "link density", "previous words", "previous link density", "next words", "next link density", "boiler", "main", "page has main", "heading", "cue")
#: Names of boilerplate and of main text in made-up pages, and some that mislead.
_SAID = {
    "menu": ("nav", "menu", "navbar", "site-nav", "breadcrumb", "main-menu", "post-navigation", "nav-main"), "foot": ("footer", "site-footer", "foot", "copyright"), "side": ("sidebar", "related", "widget", "right-rail", "side", "main-sidebar", "sidebar-content"),
    "ad": ("ad", "advert", "sponsored", "promo", "ad-slot", "content-ads"), "notice": ("cookie-banner", "notice", "consent", "newsletter", "signup-box"), "talk": ("comments", "comment-list", "replies", "comment", "discussion", "user-feedback"),
    "text": ("content", "post", "entry-content", "article-body", "main", "story"), "plain": ("wrap", "box", "c1", "inner", "sharing-economy", "search-results-2019", "footnotes"),
}


def made_up_page(seed: int) -> tuple[str, set[str]]:
    """A page and the texts of its content blocks. A third has tags that say what is what, a third has names, a third has neither."""
    r = random.Random(seed)
    style = ("tags", "names", "bare")[seed % 3]
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 9)))
    words = lambda lo, hi: " ".join(word() for _ in range(r.randint(lo, hi)))
    link = lambda lo, hi: f'<a href="/{word()}">{words(lo, hi)}</a>'
    content: set[str] = set()

    def keep(tag: str, text: str, inner: str | None = None) -> str:
        content.add(" ".join(text.split()))
        return f"<{tag}>{inner or text}</{tag}>"

    def around(kind: str, tag: str, body: str) -> str:
        if style == "tags" and kind not in ("talk", "ad", "notice", "plain"):
            return f"<{tag}>{body}</{tag}>"
        name = r.choice(_SAID[kind]) if style != "bare" or kind == "plain" and r.random() < 0.5 else None
        return f'<div class="{name}">{body}</div>' if name else f"<div>{body}</div>"

    def linked(most: int) -> str:
        """A paragraph or an item with many links: only its place in an article tells it from a menu."""
        spans = [(words(1, most), r.random() < 0.6) for _ in range(r.randint(2, 7))] + [(words(1, 3), True)]
        return keep(r.choice(("p", "p", "li")), " ".join(t for t, _ in spans) + ".", " ".join(f'<a href="#">{t}</a>' if on else t for t, on in spans) + ".")

    def title() -> str:
        """A headline, of a word or two at times, and in some articles in a head with a line on the author."""
        head = keep("h1", words(1, r.choice((2, 4, 10))))
        if unnamed or r.random() < 0.6:
            return head
        line = f"<p>{words(2, 6)}</p>" if r.random() < 0.4 else ""
        return f"<header>{head}{line}</header>" if style == "tags" else f'<div class="{r.choice(("entry-header", "post-header", "article-head"))}">{head}</div>'

    def paragraph() -> str:
        if not unnamed and r.random() < 0.2:
            return linked(r.choice((1, 4, 9)))
        first, last = words(4, r.choice((20, 60, 150))), words(3, r.choice((20, 60)))
        if r.random() < 0.3:
            anchor = words(1, 3)
            return keep("p", f"{first} {anchor} {last}.", f'{first} <a href="#">{anchor}</a> {last}.')
        return keep("p", f"{first}, {last}.") if r.random() < 0.8 else keep("p", words(1, 6) + ".")

    def passage() -> str:
        return f'<div class="{r.choice(_SAID["plain"])}">{paragraph()}</div>' if said and r.random() < 0.15 else paragraph()

    unnamed = style == "bare" or r.random() < 0.3
    said = style != "bare"  # texts that only their markup can tell from content are for pages with markup
    if seed % 10 == 9:  # nothing but a few words
        return "<html><body>" + "".join(keep("p", words(2, 9) + ".") for _ in range(r.randint(1, 2))) + "</body></html>", content
    top = around("menu", "nav", "<ul>" + "".join(f"<li>{link(1, 2)}</li>" for _ in range(r.randint(3, 9))) + "</ul>")
    if r.random() < 0.5:
        top += around("menu", "header", f"<div>{link(1, 3)}</div><div>{words(1, 4) if style != 'bare' else link(1, 4)}</div>")
    if r.random() < 0.6:
        top += around("ad", "aside", f"<p>{link(3, 9)}</p>" + (f"<p>{words(3, r.choice((25, 90)))}</p>" if said else ""))
    if said and r.random() < 0.5:
        top += around("notice", "aside", f"<p>{words(10, r.choice((30, 120)))} {link(1, 2)}</p><button>{words(1, 2)}</button>")
    body = (title() if r.random() < 0.75 else "") + "".join(
        keep(r.choice(("h2", "h3")), words(1, r.choice((2, 7)))) if r.random() < 0.2 else "<ul>" + "".join(keep("li", words(2, 14)) for _ in range(3)) + "</ul>" if r.random() < 0.1 else passage() for _ in range(r.randint(1, 12))
    )
    if said and r.random() < 0.4:
        body += around("ad", "aside", f"<p>{words(3, r.choice((20, 90)))}</p>")
    if said and r.random() < 0.5:
        body += around("side", "aside", f"<h3>{words(1, 2)}</h3>" + "".join(f"<p>{link(3, 9)}</p>" for _ in range(3)))
    main = around("plain", "div", body) if unnamed else f"<article>{body}</article>" if style == "tags" else around("text", "div", body)
    after = ""
    if r.random() < 0.5:
        after += around("side", "aside", "".join(f"<div>{link(2, 9)}</div>" for _ in range(r.randint(2, 6))) + (f"<p>{words(10, r.choice((30, 120)))}</p>" if said else ""))
    if said and r.random() < 0.5:
        after += around("talk", "div", "".join(f"<div><b>{words(1, 2)}</b><p>{words(5, r.choice((60, 250)))}</p></div>" for _ in range(r.randint(1, 4))))
    if said and r.random() < 0.3:
        after += f"<form><label>{words(1, 3)}</label><input><button>{words(1, 2)}</button></form>"
    end = r.choice(("&copy; ", "Copyright ", "(c) ", "")) + words(2, r.choice((12, 80))) + r.choice((" all rights reserved", "", f" {link(1, 3)}"))
    foot = around("foot", "footer", f"<p>{end}</p>" if said else f"<p>&copy; {link(2, 5)}</p><p>{link(1, 3)}</p>")
    return f"<html><head><title>{words(2, 6)}</title></head><body>{top}{main}{after}{foot}</body></html>", content


def labelled(pages: range = range(900)) -> list[tuple]:
    """The labelled table: the features of each block of made-up pages, and 1 for content."""
    out = []
    for seed in pages:
        page, content = made_up_page(seed)
        found = blocks(page)
        out += [(*row, float(b.text in content)) for b, row in zip(found, features(found), strict=True)]
    return out


@dataclass
class Node:
    """An inner node (feature, threshold: at most it goes left) or a leaf (value)."""

    feature: int = -1
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None
    value: float = 0.0


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1) -> Node:
    """CART by Gini impurity; of equal splits the first feature and lowest threshold."""
    p = float(y.mean())
    if depth == 0 or p in (0.0, 1.0):
        return Node(value=p)
    best = (len(y) * p * (1 - p) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            side = x[:, f] <= t
            n = int(side.sum())
            if min(n, len(y) - n) < least:
                continue
            a, b = y[side].mean(), y[~side].mean()
            cost = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
            if cost < best[0] - 1e-12:
                best = (cost, f, float(t))
    if best[1] < 0:
        return Node(value=p)
    side = x[:, best[1]] <= best[2]
    return Node(best[1], best[2], grow(x[side], y[side], depth - 1, least), grow(x[~side], y[~side], depth - 1, least), p)


@functools.cache
def train(pages: range = range(900)) -> Node:
    """The tree of the labelled table of made-up pages."""
    table = np.array(labelled(pages), float)
    return grow(table[:, :-1], table[:, -1], depth=9, least=6)


def decide(tree: Node, row: tuple) -> bool:
    while tree.feature >= 0:
        tree = tree.left if row[tree.feature] <= tree.threshold else tree.right
    return tree.value >= 0.5


def features(found: list[Block]) -> list[tuple]:
    """FEATURES of the blocks of a page."""
    has_main = any(b.main and b.boiler < 1 for b in found)
    shape = [(0, 0.0), *((b.words, b.linked / b.words) for b in found), (0, 0.0)]
    return [(*shape[k + 1], *shape[k], *shape[k + 2], b.boiler, b.main, has_main, b.heading, _CUE.search(b.text) is not None) for k, b in enumerate(found)]


def classify(found: list[Block], tree: Node) -> list[bool]:
    return [decide(tree, row) for row in features(found)]


def main_text(page: str | None, tree: Node) -> str:
    found = blocks(page)
    return " ".join(b.text for b, keep in zip(found, classify(found, tree), strict=True) if keep)


def extract(pages: DataFrame, tree: Node | None = None, source: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the page source replaced by columns ``text`` (the main text; empty if there is none) and ``n_chars``.

    Null and empty pages give an empty text; broken and cut-off markup is read as far as it goes; whole pages of any
    length are taken; repeated rows stay; of an empty table there are no rows; columns called text or n_chars are replaced, and all
    others, whatever their names, pass through.
    """
    tree = tree or train()
    keep = [f for f in pages.schema.fields if f.name not in (source, text, "n_chars")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [main_text(p, tree) for p in b[source]]
            out = b[[f.name for f in keep]].copy()
            out[text] = got
            out["n_chars"] = [len(x) for x in got]
            yield out

    return map_in_pandas(pages.select(*(f"`{f.name}`" for f in keep), source), run, T.StructType([*keep, T.StructField(text, T.StringType()), T.StructField("n_chars", T.LongType())]))


def query(spark, sf_dir):
    """op9_html."""
    from ctxloom.llm._common import table

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
