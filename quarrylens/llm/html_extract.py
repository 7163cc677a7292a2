"""Main text of web pages: flat text blocks with the word counts and link densities of their neighbours, and a decision tree.

A page is cut into blocks at block-level tags. A block has its words, its link density (words inside links by words), those of the block
before and after, and where it stands: inside an article, inside furniture (menu, header, footer, aside, form, comments, adverts,
told by element, role, class or id), or a heading. A decision tree of these features, trained here on a small labelled table,
keeps or drops the block; kept blocks are joined by line ends in page order.

Unclosed elements end where their parent does; an article's start also ends open furniture around it. A quote that never closes is a character
like any other; a tag that never ends is text. Null or empty pages give an empty text; repeated rows, each its own; an empty table, an
empty one. Nothing is bounded in length: a page is read once from end to end, and what is open is found by its name, not by a search.
"""

from __future__ import annotations

import functools
import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import map_rows

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
_CAMEL, _NOT_LETTERS = re.compile(r"(?<=[a-z])(?=[A-Z])"), re.compile(r"[^a-z]+")

#: Elements whose content is never page text; the first four hold raw characters.
_RAW = frozenset("script style textarea title".split())
_UNSEEN = _RAW | frozenset("head noscript template iframe object svg math button select datalist canvas audio video".split())
#: Elements that do not break a block.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE = frozenset("nav footer aside form menu dialog".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login sidebar related recommended share sharing social comment comments reply replies respond disqus breadcrumb breadcrumbs menu nav navbar navigation footer header masthead popup modal pagination pager toolbar widget copyright disclaimer".split()
)
_ABOUT = frozenset("has with no without layout main".split())
_ARTICLES = frozenset("article main".split())
#: A start of these ends an open one of the same set, up to the nearest container.
_SIBLINGS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "furniture", "heading", "in_article_page")


def _furniture(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _FURNITURE or tag == "header" and not in_article:
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for name, a, b, c, hidden in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c)
        if hidden or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body") and tag not in _ARTICLES:
            words = {w for v in (value, _CAMEL.sub(" ", value)) for w in _NOT_LETTERS.split(v.lower())}
            # "with-sidebar" or "main-layout no-footer" tell of a page, not of its furniture
            if words & _NAMES - ({"header"} if in_article else set()) and not words & _ABOUT:
                return True
    return False


def _tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" of an end tag, name, attributes) of what isn't text, in order; comments and the like have no name.

    The caller may send the place to go on from, for elements that hold raw characters.
    """
    at = 0
    unclosed: set[str] = set()  # quotes that don't come again
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            yield start, at, "", "", ""
            continue
        name = _NAME.match(page, start + 1)
        if not name and page[start + 1 : start + 2] not in ("!", "?"):
            at = start + 1
            continue
        at = name.end() if name else start + 2
        while stop := _STOP.search(page, at):
            at = stop.end()
            if stop[0] == ">":
                break
            if name and stop[0] not in unclosed:
                close = page.find(stop[0], at)
                if close < 0:
                    unclosed.add(stop[0])
                else:
                    at = close + 1
        if not stop:
            return
        at = (yield (start, at, name[1], name[2].lower(), page[name.end() : at - 1]) if name else (start, at, "", "", "")) or at


@dataclass(slots=True)
class _Element:
    tag: str
    furniture: int | None  # place of the outermost furniture that it is in
    article: bool
    open: bool = True


class _Open:
    """The open elements of a page. Inline elements can end before what is in them; all is found without a search."""

    def __init__(self):
        self.stack: list[_Element] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []  # places of those that aren't inline
        self.unseen = self.links = 0

    def _count(self, tag: str, by: int) -> None:
        self.unseen += by * (tag in _UNSEEN)
        self.links += by * (tag == "a")

    def push(self, tag: str, furniture: bool, article: bool) -> None:
        above = self.top()
        first = above.furniture if above.furniture is not None else len(self.stack) if furniture else None
        self.places[tag].append(len(self.stack))
        if tag not in _INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append(_Element(tag, first, above.article or article))
        self._count(tag, 1)

    def top(self) -> _Element:
        while self.stack and not self.stack[-1].open:
            self.stack.pop()
        return self.stack[-1] if self.stack else _Element("", None, False)

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            element = self.stack.pop()
            if element.open:
                self.places[element.tag].pop()
                if element.tag not in _INLINE:
                    self.blocks.pop()
                self._count(element.tag, -1)

    def end_inline(self, tag: str) -> None:
        """The innermost such element alone, not what is in it."""
        element = self.stack[self.places[tag].pop()]
        element.open = False
        self._count(tag, -1)

    def block(self) -> str:
        return self.stack[self.blocks[-1]].tag if self.blocks else ""


def blocks(page: str) -> list[dict]:
    """Text blocks of a page in order: text, words, links, article, furniture, heading."""
    out: list[dict] = []
    held = _Open()
    pieces: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        if text:
            n, top = len(text.split()), held.top()
            heading = any(e.open and len(e.tag) == 2 and e.tag[0] == "h" and e.tag[1] in "123456" for e in held.stack[-3:])
            out.append({"text": text, "words": n, "links": min(1.0, len(" ".join(linked).split()) / n), "article": top.article, "furniture": top.furniture is not None, "heading": heading})
        pieces.clear()
        linked.clear()

    def take(text: str) -> None:
        if text and not held.unseen:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if held.links:
                linked.append(text)

    at, tags, go_on = 0, _tags(page), None
    while True:
        try:
            start, end, slash, tag, attributes = tags.send(go_on)
        except StopIteration:
            break
        go_on = None
        take(page[at:start])
        at = end
        if not tag:
            continue
        inline = tag in _INLINE
        if not inline:
            flush()
        if slash:
            if places := held.places[tag]:
                # an inline end across blocks ends the inline element alone
                if inline and held.blocks and held.blocks[-1] > places[-1]:
                    held.end_inline(tag)
                else:
                    held.pop_to(places[-1])
            continue
        if tag == "br":
            take(" ")
        if tag in _VOID:
            continue
        if tag in _ARTICLES and held.top().furniture is not None:
            held.pop_to(held.top().furniture)
        if tag in _SIBLINGS:
            while held.block() in _SIBLINGS[tag]:
                held.pop_to(held.blocks[-1])
        elif not inline and held.block() == "p":
            held.pop_to(held.blocks[-1])
        if tag == "a" and held.places["a"]:  # links don't nest
            held.end_inline("a")
        if tag == "body" and held.places["head"]:  # an unclosed head ends
            held.pop_to(held.places["head"][0])
        if attributes.endswith("/") and tag in ("svg", "iframe", "a"):
            continue
        if tag in _RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = go_on = close.end() if close else len(page)
            continue
        held.push(tag, held.top().furniture is not None or _furniture(tag, attributes, held.top().article), tag in _ARTICLES)
    take(page[at:])
    flush()
    return out


def features(found: list[dict]) -> np.ndarray:
    """A row of FEATURES for each block; neighbours beyond the page have 0."""
    x = np.zeros((len(found), len(FEATURES)))
    if found:
        own = np.array([(b["words"], b["links"]) for b in found], float)
        x[:, :2], x[1:, 2:4], x[:-1, 4:6] = own, own[:-1], own[1:]
        x[:, 6:9] = [(b["article"], b["furniture"], b["heading"]) for b in found]
        x[:, 9] = x[:, 6].any()
    return x


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1) -> tuple:
    """A classification tree by Gini impurity: (feature, cut, left if <=, right) or the class of a leaf."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return (int(y.mean() >= 0.5),)
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        n, ones = np.arange(1, len(t)), np.cumsum(t)[:-1]
        left, right = ones / n, (t.sum() - ones) / (len(t) - n)
        score = n * left * (1 - left) + (len(t) - n) * right * (1 - right)
        score = np.where((v[1:] > v[:-1]) & (n >= least) & (len(t) - n >= least), score, np.inf)
        k = int(score.argmin())
        if score[k] < best[0] - 1e-12:
            best = (float(score[k]), f, float((v[k] + v[k + 1]) / 2))
    if best[0] == np.inf:
        return (int(y.mean() >= 0.5),)
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], fit_tree(x[low], y[low], depth - 1, least), fit_tree(x[~low], y[~low], depth - 1, least)


def classify(tree: tuple, row: list[float]) -> int:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


# The labelled table, a block a row as (words, links, article, furniture, heading, label), a page a list.
LABELLED = [
    [(6, 1, 0, 1, 0, 0), (9, 0, 0, 1, 0, 0), (7, 0, 1, 0, 1, 1), (2, 0, 1, 0, 0, 1), (80, 0.02, 1, 0, 0, 1), (14, 0, 0, 1, 0, 0)],
    [(1, 1, 0, 1, 0, 0), (1, 1, 0, 1, 0, 0), (9, 0, 1, 0, 1, 1), (60, 0, 1, 0, 0, 1), (45, 0, 1, 1, 0, 0), (30, 0.5, 1, 0, 0, 1), (25, 0, 0, 1, 0, 0)],
    [(3, 1, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0), (8, 0, 0, 0, 1, 1), (70, 0, 0, 0, 0, 1), (55, 0.05, 0, 0, 0, 1), (5, 0.8, 0, 0, 0, 0), (4, 0, 0, 0, 0, 0)],
    [(4, 0, 0, 0, 0, 0), (3, 1, 0, 0, 0, 0), (40, 0, 0, 0, 0, 1), (12, 0, 0, 0, 0, 1), (90, 0.03, 0, 0, 0, 1), (9, 0.6, 0, 0, 0, 0), (5, 0, 0, 0, 0, 0), (3, 0.7, 0, 0, 0, 0)],
    [(10, 0, 0, 1, 0, 0), (60, 0, 0, 1, 0, 0), (35, 0, 0, 0, 0, 1), (28, 0, 0, 0, 0, 1), (15, 0, 0, 0, 0, 1), (22, 0.9, 0, 0, 0, 0), (18, 0.1, 0, 1, 0, 0)],
    [(5, 0, 0, 0, 1, 1), (33, 0.2, 0, 0, 0, 1), (7, 1, 0, 0, 0, 0), (6, 1, 0, 0, 0, 0), (20, 0.7, 0, 1, 0, 0)],
    [(12, 0, 0, 0, 0, 0), (3, 0, 1, 0, 1, 1), (1, 0, 1, 0, 0, 1), (4, 1, 1, 0, 0, 1), (3, 0, 1, 0, 0, 1), (50, 0, 0, 0, 0, 0), (70, 0, 0, 0, 0, 0)],
    [(30, 0, 0, 0, 0, 0), (5, 0, 1, 0, 0, 1), (28, 0, 1, 1, 0, 0), (10, 0, 1, 0, 0, 1), (8, 0, 0, 0, 1, 0), (16, 0.2, 0, 0, 0, 0)],
    [(2, 0, 0, 0, 0, 1), (26, 0, 0, 0, 0, 1), (2, 1, 0, 0, 0, 0)],
    [(5, 0, 1, 0, 1, 1), (90, 0, 1, 0, 0, 1), (12, 0, 1, 0, 0, 1), (35, 0, 1, 0, 0, 1), (4, 0, 0, 0, 0, 0)],
    [(20, 0, 0, 0, 0, 0), (1, 0, 1, 0, 0, 1), (2, 1, 1, 0, 0, 1), (30, 0.3, 1, 0, 0, 1), (6, 0, 1, 0, 0, 1), (40, 0, 0, 0, 0, 0), (25, 0, 0, 0, 0, 0)],
    [(8, 0, 0, 0, 0, 0), (15, 0, 0, 0, 0, 0), (70, 0, 1, 0, 0, 1), (3, 0, 1, 0, 0, 1), (9, 0, 0, 0, 1, 0), (33, 0, 0, 0, 0, 0), (1, 0, 0, 0, 0, 0)],
    [(60, 0, 1, 0, 0, 1), (11, 0, 1, 0, 0, 1), (65, 0, 1, 1, 0, 0), (14, 0, 1, 0, 0, 1)],
    [(3, 0, 1, 0, 0, 1), (2, 0, 1, 0, 0, 1), (12, 0, 0, 0, 0, 0)],
    [(2, 0, 1, 0, 1, 1), (2, 0, 1, 0, 0, 1), (12, 0, 0, 1, 0, 0)],
    [(5, 1, 0, 1, 0, 0), (30, 0, 0, 1, 0, 0), (25, 0, 1, 0, 1, 1), (25, 0, 1, 0, 0, 1), (8, 0, 0, 1, 0, 0)],
    [(24, 0, 0, 0, 0, 1)],
    [(14, 0, 0, 0, 0, 1)],
    [(6, 0, 0, 0, 0, 1)],
    [(2, 0, 0, 0, 0, 1)],
    [(30, 0, 0, 0, 0, 1), (18, 0, 0, 0, 0, 1)],
    [(9, 0, 0, 0, 0, 1), (12, 0.1, 0, 0, 0, 1), (40, 0, 0, 0, 0, 1)],
    [(2, 1, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0), (22, 0, 0, 0, 0, 1), (19, 0, 0, 0, 0, 1), (3, 1, 0, 0, 0, 0), (4, 1, 0, 0, 0, 0)],
    [(75, 0, 0, 0, 0, 1), (66, 0, 0, 0, 0, 1), (48, 0, 0, 0, 0, 1), (52, 0, 0, 0, 0, 1)],
    [(5, 0, 0, 0, 1, 1), (14, 0, 0, 0, 0, 1), (11, 0, 0, 0, 0, 1), (16, 0.1, 0, 0, 0, 1), (3, 1, 0, 1, 0, 0)],
]


@functools.lru_cache(maxsize=1)
def trained() -> tuple:
    pages = [[dict(zip(("words", "links", "article", "furniture", "heading", "label"), row, strict=True)) for row in page] for page in LABELLED]
    return fit_tree(np.concatenate([features(p) for p in pages]), np.array([b["label"] for p in pages for b in p]))


def main_text(page: str | None, tree: tuple | None = None) -> str:
    found = blocks(page or "")
    tree = tree or trained()
    return "\n".join(b["text"] for b, row in zip(found, features(found).tolist(), strict=True) if classify(tree, row))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each whole page. No shuffle."""

    def make():
        tree = trained()

        def one(i, url, page):
            text = main_text(page, tree)
            return i, url, text, len(text)

        return one

    return map_rows(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), make, "page_id long, url string, text string, n_chars long")
