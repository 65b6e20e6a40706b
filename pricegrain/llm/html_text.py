"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one for each block of the page, with blank lines where a page leaves or enters a part of
several lines. A line's weight is the length of its text, or nothing if it stands in boilerplate (menus, footers, forms,
adverts, comments and the like) or consists of links. Inside article or main it counts double, and no line there is
without weight. Weights are summed over a sliding window of lines; text surges where a window first outweighs SURGE and
dives where all weight is gone for a whole window. What lies between a surge and its dive is the main text, short lines
and lines of links included, with the headings right before it; only boilerplate goes. A part of the page whose windows
never surge, such as a box of short teasers, goes whatever its names are.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a window, and the characters in a window from which text surges.
WINDOW, SURGE = 2, 120
#: A line whose text is links to this share carries no weight; a line inside article or main carries INSIDE times its own.
LINKS, INSIDE = 0.6, 2.0

# Elements by their role in a page.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math canvas object".split())
BOILERPLATE = frozenset("head nav footer aside form menu dialog button select fieldset label search audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot adsense sponsor sponsored sponsors promo promos promotion promoted cookie cookies consent gdpr "
    "notice notices disclaimer alert newsletter subscribe subscription signup login signin register paywall sidebar rail widget widgets comment comments commentlist respond reply replies disqus discussion reviews "
    "related recommended recommendations recommend readmore trending popular teaser teasers share sharing social follow menu menus nav navbar navigation breadcrumb breadcrumbs footer colophon banner popup modal overlay "
    "toolbar pagination pager skip masthead topbar tags taglist hidden".split()
)
PARTS = frozenset("div section ul ol dl table blockquote figure details center article main".split())
HEADERS = frozenset("header masthead".split())

TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]*)|[\"'])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PART = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def is_boilerplate(tag: str, attributes: str, in_content: bool, names: bool) -> bool:
    """By tag, role or hiding; with `names`, also by the words of its class and id."""
    if tag in BOILERPLATE:
        return True
    if tag == "header" and not in_content:
        return True
    if not attributes or tag in ("html", "body") or tag in CONTENT:
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape("".join(values))
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return True
        if name == "role" and value.strip().lower() in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if names and name in ("class", "id"):
            parts = set(PART.split(HUMP.sub(" ", value).lower()))
            if parts & NAMES or not in_content and parts & HEADERS:
                return True
    return False


class Line(NamedTuple):
    """A block's text, its weight, what it stands in, its innermost part of the page, and the innermost part that holds all since the line before."""

    text: str
    weight: float
    boilerplate: bool
    heading: bool
    inside: bool
    part: int = 0
    shared: int = 0


class Open(NamedTuple):
    """An open element; solid counts the blocks, boilerplate and content among the elements up to it."""

    tag: str
    bad: bool
    content: bool
    solid: int


def lines(page: str, names: bool = True) -> tuple[list[Line], list[int]]:
    """The block lines with text, in page order, and the parent of each part of the page; part 0 is the whole.

    Without `names`, neither classes and ids nor an article inside another, as reader comments are, make boilerplate.
    """
    out: list[Line] = []
    parents = [0]
    around = [0]  # the open parts
    shared = 0
    held: list[str] = []  # text pieces of the line that is being read
    linked = 0  # characters of it inside links
    open_: list[Open | None] = []  # None: ended out of order
    places: dict[str, list[int]] = {}  # of a tag's open elements
    endless: set[str] = set()  # raw elements that never end from here on
    skipping = inside = links = heads = 0

    def flush() -> None:
        nonlocal linked, shared
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            weight = 0.0 if skipping or linked > LINKS * len(text) else len(text) * (INSIDE if inside else 1.0)
            out.append(Line(text, max(weight, 1.0) if inside else weight, skipping > 0, heads > 0, inside > 0, around[-1], shared))
            shared = around[-1]
        held.clear()
        linked = 0

    def text_of(piece: str) -> None:
        nonlocal linked
        if piece:
            held.append(piece)
            if links:
                linked += len(piece.strip())

    def ended(element: Open) -> None:
        nonlocal skipping, inside, links, heads, shared
        places[element.tag].pop()
        skipping -= element.bad
        inside -= element.content
        links -= element.tag == "a"
        heads -= element.tag in HEADINGS
        if element.tag in PARTS:
            if around.pop() == shared:
                shared = around[-1]

    def close(k: int) -> None:
        """Closes the open elements from position k on."""
        for element in reversed(open_[k:]):
            if element:
                ended(element)
        del open_[k:]

    at = 0
    while True:
        m = TOKEN.search(page, at)
        if not m:
            text_of(page[at:])
            break
        text_of(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        while open_ and not open_[-1]:
            open_.pop()
        if m[1]:
            if not places.get(tag):
                if tag in BLOCKS:
                    flush()
                continue
            k = places[tag][-1]
            if tag in BLOCKS:
                flush()
                close(k)
            elif open_[-1].solid > open_[k].solid or open_[k].bad or open_[k].content:  # an inline end tag never closes blocks
                if open_[k].bad:
                    flush()
                ended(open_[k])
                open_[k] = None
            else:
                close(k)
            continue
        if tag in RAW and tag not in endless:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            if tag not in ("svg", "math", "canvas", "object") or end:
                at = end.end() if end else len(page)
                if tag in BLOCKS:
                    flush()
                continue
            endless.add(tag)
        if tag in BLOCKS:
            flush()
            if tag == "p" and open_ and open_[-1].tag == "p" or tag in ("li", "option", "tr", "td", "th", "dt", "dd") and open_ and open_[-1].tag == tag:
                close(len(open_) - 1)
        if tag == "body":  # a head without an end ends here
            flush()
            close(0)
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCKS and tag != "a":
            continue
        content = tag in CONTENT
        bad = is_boilerplate(tag, m[3], inside > 0, names) or names and tag == "article" and bool(places.get(tag))
        if bad:
            flush()
        places.setdefault(tag, []).append(len(open_))
        before = open_[-1].solid if open_ and open_[-1] else 0
        open_.append(Open(tag, bad, content, before + (bad or content or tag in BLOCKS)))
        if tag in PARTS:
            parents.append(around[-1])
            around.append(len(parents) - 1)
        skipping += bad
        inside += content
        links += tag == "a"
        heads += tag in HEADINGS
    flush()
    return out, parents


def with_blanks(found: list[Line], parents: list[int]) -> list[Line]:
    """The lines, with a blank one for each part of several lines that the page leaves or enters between two of them.

    Inside article and main there are none: what is marked as one text is one, however it is divided.
    """
    size = [0] * len(parents)
    for line in found:
        size[line.part] += 1
    for part in range(len(parents) - 1, 0, -1):
        size[parents[part]] += size[part]
    deep = [0] * len(parents)  # parts of several lines around a part, itself included
    for part in range(1, len(parents)):
        deep[part] = deep[parents[part]] + (size[part] > 1)
    out = found[:1]
    for before, line in zip(found, found[1:], strict=False):
        if not (before.inside and line.inside):
            out += [Line("", 0.0, False, False, False)] * (deep[before.part] + deep[line.part] - 2 * deep[line.shared])
        out.append(line)
    return out


def main_text(page: str, window: int = WINDOW, surge: float = SURGE, names: bool = True) -> str:
    """The page's main text, its blocks joined by a space; empty if the page has no text of its own.

    Where names leave nothing of a page, they don't count.
    """
    found = with_blanks(*lines(page, names))
    weight = np.array([line.weight for line in found])
    if not any(line.weight and not line.boilerplate for line in found):
        return main_text(page, window, surge, False) if names else ""
    padded = np.concatenate((np.zeros(window - 1), weight, np.zeros(window - 1)))
    sums = np.convolve(padded, np.ones(window), "valid")  # sum k covers lines k - window + 1 to k
    edges = np.flatnonzero(np.diff(np.concatenate(([False], sums > 0, [False])).astype(np.int8)))
    spans = []  # (heaviest window, all weight, surge, dive), surge and dive as lines
    for start, stop in zip(edges[::2], edges[1::2], strict=True):
        a, b = start, stop - window + 1
        # A text's linked headings stand within a window of its first line.
        a = next((i for i in range(max(a - window, 0), a) if found[i].heading and not found[i].boilerplate), a)
        spans.append((sums[start:stop].max(), weight[a:b].sum(), a, b))
    surging = [s for s in spans if s[0] >= surge] or [max(spans, key=lambda s: (s[1], -s[2]))]
    return " ".join(found[i].text for _, _, a, b in surging for i in range(a, b) if found[i].text and not found[i].boilerplate)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns of the pages but the html, and text and n_chars; columns of these two names are replaced.

    A null html is the empty page, and a page without main text has the empty text and 0 characters. Rows are handled one
    by one, so repeated rows and nulls in other columns stay as they are. An empty table gives no rows.
    """
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    @F.pandas_udf("string")
    def text_of(values):  # noqa: ANN001
        return values.map(lambda page: main_text(page or ""))

    found = pages.select(*(F.col(f"`{c}`") for c in keep), text_of(F.col(html_col)).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
