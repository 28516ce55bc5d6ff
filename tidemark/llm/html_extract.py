"""Main text of web pages by the distribution of text over lines.

Markup is stripped to lines, one for each block of the page in page order. Outside of
articles there is an empty line where a container ends; the outermost article
(``<article>``, ``<main>``, ``role=main``) has a whole window of them at both edges. A
line weighs the length of its text, less nine tenths of what is in links. Markup adds
nothing to a weight, inside an article or outside, but lowers some:

* to ``MARKED`` of it what it names navigation, header, footer, sidebar, notice, advert,
  form or reader comments, and lines of controls only;
* to a tenth what lies outside of the articles of a page that has one;
* to nothing, outside of articles, lines of links only and lists of short names between
  bars or dots.

The weights are summed over sliding windows of ``window`` lines. Between two dives
(windows without weight) lies a surge; if one of its sums exceeds the threshold, all its
lines with weight are kept, and what does not reach it goes. The threshold is ``share``
of the largest sum and at most ``most``, so that one very long block does not raise it.
Marked lines have windows of their own, since an advert amid an article should neither
profit from the text around it nor cut it in two; their threshold is ``most`` itself, so
a marked block is main text only if it holds ``most / MARKED`` characters in a window. A
line of links between two kept lines is kept as well.

Character references are decoded, white space inside a block becomes one space, and
blocks are joined by two line feeds. Nulls, empty pages and pages without text give
the empty string. Broken markup (open tags at the end of a page or of a parent, stray
end tags) is read as browsers do: an end tag closes what is open inside it. If class
names would leave nothing, only element names count. Every page is worked on by itself and
whole, however long: repeated rows give repeated rows, an empty table gives none, and
columns other than page_id, url and html are not looked at, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Element names as HTML defines them.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody "
    "td tfoot th thead title tr ul noscript".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
RAW = "script|style|textarea|title|template|iframe|noembed|noframes"
OUTSIDE = frozenset("head nav header footer aside form menu dialog fieldset noscript".split())
CONTROLS = frozenset("button select canvas".split())
CONTAINERS = frozenset("div section table ul ol dl aside nav header footer form".split())
ARTICLE = frozenset("article main".split())
#: Words in class, id or role of what is not main text, and words that say nothing about it.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promotion banner nav "
    "navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidebars widget widgets cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations comment comments commentlist disqus replies respond footer header masthead topbar "
    "toolbar copyright search pagination pager skip complementary contentinfo dialog alertdialog".split()
)
NEUTRAL = frozenset(
    "area articles bar block body bottom box button buttons center col column container content div entry form global google group "
    "holder icons inner item items js left link links list main message module outer page panel policy post posts primary reader "
    "region right row secondary section site slot small story tag thread to top unit user wrap wrapper article blog".split()
)

TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?][^>]*>", re.S | re.I)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
MAIN_ROLE = re.compile(r"role\s*=\s*[\"']?main\b", re.I)
WORD = re.compile(r"[^a-z0-9]+")
SIZE = re.compile(r"\d+x\d+|[a-z]?\d+")
BARS = re.compile(r"\s*[|·•»/]\s+")
SPACE = re.compile(r"\s+")
#: What is left of the weight of a line that its markup names as other than main text.
MARKED = 0.02
#: End tags that browsers supply: a start tag of the first closes an open element of the second.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def marked(attributes: str) -> bool:
    """Whether class, id or role say that the element is not main text.

    A name does if one of its words is a mark and the others are marks, numbers or neutral.
    """
    for found in NAMES.finditer(attributes):
        for name in next((g for g in found.groups() if g is not None), "").lower().split():
            words = [w for w in WORD.split(name) if w and not w.isdigit()]
            if not MARKS.isdisjoint(words) and all(w in MARKS or w in NEUTRAL or SIZE.fullmatch(w) for w in words):
                return True
    return False


def worded(piece: str) -> bool:
    return any(c.isalnum() for c in html.unescape(piece))


class Line(NamedTuple):
    """A block's text and what the markup says of it."""

    text: str
    linked: float = 0  # share of the text in links
    links: bool = False  # links only
    outside: bool = True  # marked as other than main text
    article: bool = False


def lines(page: str, window: int, classes: bool = True) -> list[Line]:
    """The lines of a page, empty ones where containers end; ``classes``: heed class, id and role."""
    out: list[Line] = []
    stack: list[tuple[str, bool, bool]] = []  # name, outside, in an article
    parts: list[str] = []
    linked = pressed = at = links = controls = 0
    outside = article = words = False  # words: beside links and controls

    def flush() -> None:
        nonlocal linked, pressed, words
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                only_controls = 2 * pressed > len(text) and not words
                out.append(Line(text, min(1, linked / len(text)), 2 * linked > len(text) and not words, outside or only_controls, article))
            parts.clear()
        linked, pressed, words = 0, 0, False

    def close(k: int) -> None:
        """Close the open elements from ``k`` on."""
        nonlocal outside, article, links, controls
        held = article
        names = [name for name, *_ in stack[k:]]
        links -= names.count("a")
        controls -= sum(name in CONTROLS for name in names)
        del stack[k:]
        outside, article = stack[-1][1:] if stack else (False, False)
        if not article:
            out.extend([Line("")] * (window if held else sum(name in CONTAINERS for name in names)))

    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if controls:
                pressed += len(piece.strip())
            elif links:
                linked += len(piece.strip())
            else:
                words = words or worded(piece)
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append(" ")
        if name in BLOCKS:
            flush()
        if m[2]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if k is not None and (name in BLOCKS or not any(x[0] in BLOCKS for x in stack[k + 1 :])):
                close(k)
        elif name not in VOID and not m[0].endswith("/>"):
            if name in CLOSES:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in CLOSES[name]:
                        close(k)
                        break
                    if stack[k][0] in BLOCKS:
                        break
            elif name in BLOCKS and any(x[0] == "p" for x in stack[-3:]):
                close(max(i for i, x in enumerate(stack) if x[0] == "p"))
            begins = name in ARTICLE or bool(MAIN_ROLE.search(m[4]))
            if begins and not article:
                out.extend([Line("")] * window)
            off = outside or name in OUTSIDE or (name not in ("html", "body", "article", "main") and classes and bool(m[4]) and marked(m[4]))
            stack.append((name, off, article or begins))
            outside, article = stack[-1][1:]
            links += name == "a"
            controls += name in CONTROLS
    parts.append(page[at:])
    words = words or (not links and not controls and worded(page[at:]))
    flush()
    return out


def names_between_bars(text: str) -> bool:
    """Whether a line lists three or more short names between bars or dots."""
    names = BARS.split(text)
    return len(names) > 2 and all(len(n.split()) <= 3 for n in names)


def weights(rows: list[Line]) -> list[float]:
    """What each line counts in its windows."""
    has_article = any(r.article and not r.outside for r in rows)

    def weight(r: Line) -> float:
        w = len(r.text) * (1 - 0.9 * r.linked)
        if r.outside:
            return w * MARKED
        if not r.article:
            if r.links or names_between_bars(r.text):
                return 0
            return w * 0.1 if has_article else w
        return w

    return [weight(r) for r in rows]


def window_sums(weight: list[float], window: int) -> list[float]:
    """The sum of each line's weight and those of the ``window - 1`` lines before it."""
    return [sum(weight[max(0, i - window + 1) : i + 1]) for i in range(len(weight))]


def surges(weight: list[float], sums: list[float], level: float) -> Iterator[int]:
    """The lines with weight of every stretch between two dives that has a window above ``level``."""
    begin = 0
    for i, s in enumerate([*sums, 0]):
        if s <= 0:  # a dive
            if max(sums[begin:i], default=0) > level:
                yield from (k for k in range(begin, i) if weight[k] > 0)
            begin = i + 1


def main_blocks(page: str, window: int = 3, share: float = 0.2, most: int = 80) -> list[str]:
    """The blocks between surge and dive points."""
    rows = lines(page, window)
    if all(r.outside for r in rows):  # a wrapper's class names what it holds, not what it is
        rows = lines(page, window, classes=False)
    weight = weights(rows)
    # Marked lines stand apart; they leave empty lines outside of articles.
    plain = [i for i, r in enumerate(rows) if not (r.outside and r.article)]
    kept = [False] * len(rows)
    for places, marked_ones in ((plain, False), (range(len(rows)), True)):
        own = [weight[i] if rows[i].outside == marked_ones else 0 for i in places]
        sums = window_sums(own, window)
        level = most if marked_ones else min(share * max(sums, default=0), most)
        for k in surges(own, sums, level):
            kept[places[k]] = True
    main = list(kept)
    for i in range(1, len(rows) - 1):
        if rows[i].links and not rows[i].outside and main[i - 1] and main[i + 1]:
            kept[i] = True
    return [r.text for r, k in zip(rows, kept, strict=True) if k]


def main_text(page: str | None) -> str:
    """The main text of one page."""
    return "\n\n".join(main_blocks(page)) if page else ""


@pandas_udf(StringType())
def main_text_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pd.Series([main_text(p) for p in pages], dtype="object")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    return pages.select("page_id", "url", main_text_udf(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
