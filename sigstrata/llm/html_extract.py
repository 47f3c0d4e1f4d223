"""Main text of web pages by text-to-tag ratios.

The standard library's HTML parser streams events into lines (paragraphs, headings, list items, cells). A line's ratio
is its characters outside links for each tag in it. The logarithms of the ratios are smoothed with a Gaussian,
within stretches of lines that are alike marked, and two-means clustering of them sets the threshold above which lines
are content. Nothing else decides what is content: navigation, asides, footers, page headers, forms and what names
itself so by role, class or id is only marked, and a mark divides the logarithm by MARKED.

The content region is the element in which content weighs most against marked or linked lines. Its lines are the
result, short ones too, for a short paragraph between long ones is text of the article; but lines that are not
content go if they are marked or stand in a menu of links.

A name marks an element if it says nothing but boilerplate ("cookie-notice", "sidebar-right", "userComments"; not
"article-header", "side-by-side", "search-results"); never the page, an article, a heading or a paragraph. A mark
by name or of a form does not hold for an element with most of the page's text outside links and at least half of its
paragraphs and headings.

White space inside a line becomes one space and lines are joined by two newlines. Null html counts as empty: text ""
and n_chars 0; so does a page without content. Repeated rows are extracted each; an empty table gives an empty
result. Very long pages are parsed whole, in time and memory in proportion to the page, however deeply they nest.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sigstrata.llm.common import map_texts

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that start and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead"
    " title tr ul".split()
)
#: Elements that hold no text of the page.
SKIP = frozenset("script style noscript template head title button select textarea datalist iframe object svg canvas audio video map".split())
#: Elements and roles that are marked; a header only outside of articles.
MARKS = frozenset("nav aside footer form menu dialog fieldset header".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of a class or an id that name boilerplate, that name comments, that may stand beside them, and that name content.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr"
    " notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar side aside widget menu nav navbar navigation"
    " breadcrumb breadcrumbs pager pagination footer header masthead topbar toolbar social share sharing related recommended recommendations"
    " disclaimer discussion reply replies login search copyright skip".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond".split())
BESIDE = frozenset(
    "area bar block bottom box button buttons col column container fixed global group holder icons inner item items left link links list main"
    " outer page panel primary reader right row secondary section site slot sticky sub text top unit user wrap wrapper zone".split()
)
CONTENT = frozenset("article body content entry main post story text".split())
#: First words of a class that says what a page has, and classes that say what a post is about or allows.
ABOUT = frozenset("has with no without layout".split())
POST = re.compile(r"(category|tag)-.*|.*-open", re.S)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements that no name marks.
TEXT = frozenset("html body main article h1 h2 h3 h4 h5 h6 p".split())
PARAGRAPHS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: Elements that can be the content region.
SECTIONS = frozenset("article main section div td body".split())
#: An open element that an opening tag ends.
CLOSES = {
    "p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"},
    "option": {"option"}, "head": {"body"},
}
SIGMA = 2.0
MARKED = 10.0
#: Logarithms that lie closer than this are one cluster.
SPREAD = 0.3
#: Lines of links in a row that make a menu.
MENU = 3


@lru_cache(maxsize=4096)
def _names(name: str) -> str:
    """What a class or an id names: "content", "boilerplate" or ""."""
    words = [w.lower() for w in PARTS.findall(name)]
    if not words or words[0] in ABOUT or POST.fullmatch(name):
        return ""
    if not COMMENTS.isdisjoint(words):
        return "boilerplate"
    if not WORDS.isdisjoint(words):
        return "boilerplate" if WORDS.union(BESIDE).issuperset(words) else ""
    return "content" if CONTENT.union(BESIDE).issuperset(words) and not CONTENT.isdisjoint(words) else ""


class Line(NamedTuple):
    text: str
    plain: int  # characters outside links, without white space
    linked: int
    tags: int
    paragraph: bool  # a paragraph or a heading
    section: int  # the innermost section, or -1
    mark: int  # the innermost marked element, or -1


class Lines(HTMLParser):
    """Collects the lines of a page, and trees of its sections and of its marked elements (the parent of each, or -1)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.sections: list[int] = []
        self.marks: list[tuple[int, bool]] = []  # parent, and whether the mark gives way to most of the page's text
        # open elements: tag, and whether it is skipped, a section, marked; and the places of blocks among them
        self.open: list[tuple[str, bool, bool, bool]] = []
        self.blocks: list[int] = []
        self.here: Counter[str] = Counter()
        self.skipped = 0
        self.in_section: list[int] = [-1]
        self.in_mark: list[int] = [-1]
        self.clear()

    def clear(self) -> None:
        self.text: list[str] = []
        self.plain = self.linked = self.tags = 0

    def parse_html_declaration(self, i: int) -> int:
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # an unknown marked section is a comment, as browsers have it
            return self.parse_bogus_comment(i)

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            paragraph = bool(self.blocks) and self.open[self.blocks[-1]][0] in PARAGRAPHS
            self.lines.append(Line(text, self.plain, self.linked, self.tags, paragraph, self.in_section[-1], self.in_mark[-1]))
        self.clear()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.flush()
        else:
            self.tags += 1
            if tag == "br":
                self.text.append("\n")
        if tag in VOID:
            return
        if tag in BLOCKS and self.blocks and tag in CLOSES.get(self.open[self.blocks[-1]][0], ()):
            at = self.blocks[-1]  # inline elements left open inside a paragraph end with it
            while len(self.open) > at:
                self._pop()
        skip, marked, yields = self._judge(tag, attrs)
        if marked:
            self.flush()
            self.marks.append((self.in_mark[-1], yields))
            self.in_mark.append(len(self.marks) - 1)
        section = tag in SECTIONS
        if section:
            self.sections.append(self.in_section[-1])
            self.in_section.append(len(self.sections) - 1)
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append((tag, skip, section, marked))
        self.here[tag] += 1
        self.skipped += skip

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if self.here[tag]:
            while self._pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.skipped:
            return
        self.text.append(data)
        n = len(data) - sum(map(len, re.findall(r"\s+", data)))
        if self.here["a"]:
            self.linked += n
        else:
            self.plain += n

    def _pop(self) -> str:
        tag, skip, section, marked = self.open[-1]
        if tag in BLOCKS or marked:
            self.flush()
        self.open.pop()
        self.here[tag] -= 1
        self.skipped -= skip
        if section:
            self.in_section.pop()
        if marked:
            self.in_mark.pop()
        if self.blocks and self.blocks[-1] == len(self.open):
            self.blocks.pop()
        return tag

    def _judge(self, tag: str, attrs: list) -> tuple[bool, bool, bool]:
        """Whether an element is skipped, is marked, and whether the mark gives way to most of the page's text."""
        skip, marked = tag in SKIP, tag in MARKS and (tag != "header" or not (self.here["article"] or self.here["main"]))
        named, content = False, False
        for k, v in attrs:
            if k in ("class", "id"):
                said = [_names(x) for x in (v or "").split()]
                named, content = named or "boilerplate" in said, content or "content" in said
                continue
            v = (v or "").lower()
            skip = skip or k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and "display:none" in v.replace(" ", ""))
            marked = marked or (k == "role" and v in ROLES and tag not in ("html", "body", "main"))
        named = named and not content and tag not in TEXT
        return skip, marked or named, tag == "form" or not marked


def marked_lines(lines: list[Line], marks: list[tuple[int, bool]]) -> np.ndarray:
    """Whether each line stands in a marked element, but for those that give way to most of the page's text."""
    mass, paragraphs = [0] * len(marks), [0] * len(marks)
    for x in lines:
        if x.mark >= 0:
            mass[x.mark] += x.plain
            paragraphs[x.mark] += x.paragraph
    for i in range(len(marks) - 1, -1, -1):  # a parent comes before its children
        if marks[i][0] >= 0:
            mass[marks[i][0]] += mass[i]
            paragraphs[marks[i][0]] += paragraphs[i]
    total, every, holds = sum(x.plain for x in lines), sum(x.paragraph for x in lines), []
    for (parent, yields), m, n in zip(marks, mass, paragraphs, strict=True):
        holds.append(not (yields and 2 * m > total and 2 * n >= every) or (parent >= 0 and holds[parent]))
    return np.array([x.mark >= 0 and holds[x.mark] for x in lines], dtype=bool)


def ratios(lines: list[Line], marked: np.ndarray) -> np.ndarray:
    """The logarithm of each line's text-to-tag ratio, less where it is marked."""
    x = np.log1p(np.array([t.plain / (1 + t.tags) for t in lines]))
    return np.where(marked, x / MARKED, x)


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    r = math.ceil(3 * sigma)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, r, mode="edge"), k / k.sum(), mode="valid")


def threshold(x: np.ndarray, rounds: int = 50) -> float:
    """Midpoint of the two means of x."""
    lo, hi = float(x.min()), float(x.max())
    for _ in range(rounds):
        mid = (lo + hi) / 2
        low, high = x[x <= mid], x[x > mid]
        if not len(low) or not len(high):
            return mid
        new = float(low.mean()), float(high.mean())
        if new == (lo, hi):
            break
        lo, hi = new
    return (lo + hi) / 2


def content_lines(x: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Which lines are content: smoothed within stretches alike marked, above the threshold of two clusters."""
    if marked.all():
        return np.zeros(len(x), dtype=bool)
    cuts = np.flatnonzero(np.diff(marked.astype(int))) + 1
    soft = np.concatenate([smooth(part) for part in np.split(x, cuts)])
    return soft >= threshold(soft) if soft.max() - soft.min() > SPREAD else np.ones(len(x), dtype=bool)


def region(weights: np.ndarray, lines: list[Line], sections: list[int]) -> int:
    """The section whose lines weigh most, with those of the sections in it; -1 for the whole page."""
    mass = [0.0] * len(sections)
    for x, w in zip(lines, weights.tolist(), strict=True):
        if x.section >= 0:
            mass[x.section] += w
    for i in range(len(sections) - 1, -1, -1):
        if sections[i] >= 0:
            mass[sections[i]] += mass[i]
    best = max(range(len(sections)), key=mass.__getitem__, default=-1)
    return best if best >= 0 and mass[best] >= float(weights.sum()) else -1


def extract(html: str | None) -> str:
    page = Lines()
    page.feed(html or "")
    page.close()
    page.flush()
    lines = page.lines
    if not lines:
        return ""
    marked = marked_lines(lines, page.marks)
    content = content_lines(ratios(lines, marked), marked)
    linked = np.array([x.linked > 2 * x.plain for x in lines])
    size = np.array([len(x.text) for x in lines], dtype=float)
    weights = np.where(content, size, np.where(marked | linked, -size, size / 4))
    if weights.max() <= 0:
        return ""
    at = region(weights, lines, page.sections)
    inside = []
    for i, parent in enumerate(page.sections):
        inside.append(i == at or (parent >= 0 and inside[parent]))
    # a menu is a run of linked lines
    start = np.flatnonzero(np.diff(np.concatenate([[0], linked.astype(int), [0]])) == 1)
    stop = np.flatnonzero(np.diff(np.concatenate([[0], linked.astype(int), [0]])) == -1)
    menu = np.zeros(len(lines), dtype=bool)
    for a, b in zip(start.tolist(), stop.tolist(), strict=True):
        menu[a:b] = b - a >= MENU
    kept = content | ~(marked | menu)
    return "\n\n".join(x.text for x, k in zip(lines, kept.tolist(), strict=True) if k and (at < 0 or (x.section >= 0 and inside[x.section])))


def _extract(pages: list) -> list:
    texts = [extract(h) for h in pages]
    return [texts, list(map(len, texts))]


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return map_texts(pages.select("page_id", "url", "html"), _extract, fields, column="html", keep=["page_id", "url"])
