"""Main text of HTML pages by a maximum-scoring subsequence of words and tags.

A page is cut into words and tags. Words score +1 and tags minus their weight; one linear scan finds the contiguous region
with the largest sum. Weights come from labelled pages: pages that mark their article or main element, which
say how often each tag stands inside and outside of it. They are counted over about
``sample`` pages at most, drawn by a hash of their ids (a bounded sample of labelled
rows); without labelled pages the default weights hold.

Elements that are seldom an article's text (menus, page headers, footers, sidebars, forms, adverts, notices, reader comments; by
their tag or by the words of their class, id and role) are scored apart: inside the region around them they cost as many words as they
hold, up to ``BARRIER``, and none of their text is taken; but what they hold is a candidate of its own, with its score
reduced (``GUESS``). So an article in a badly named or never closed element wins where there is no better text; an advert alone or
readers' comments never do. An element named weakly (related, search, widget) that holds prose, not links, counts as text.

Where the region lies in an article or main element, it is widened to that element (short
first and last blocks belong to it); else to whole blocks. Scripts,
styles and comments are left out; character references are decoded; white space inside a
block becomes one space; blocks are joined by one line feed. Nothing else is dropped or cut.

The reader is linear in the page. An element ends with its end tag or its parent's; a tag that never ends is left out up to the next
one; an unclosed script or style takes the rest of the page, any other unclosed thing nothing but itself. Null counts as an empty
page: an empty text. Empty tables give empty results; repeated rows and ids, and null ids, are each reported. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

# Elements by what they hold.
RAW = ("script", "style", "title", "textarea", "iframe", "xmp", "noembed", "noframes")
DROPPED = (*RAW, "noscript", "template", "select", "option", "datalist", "svg", "math", "object", "canvas", "audio", "video", "map")
EXCLUDED = ("nav", "footer", "aside", "form", "menu", "dialog", "button", "label", "fieldset", "header")
CONTAINERS = ("article", "main")
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot",
    "th", "thead", "tr", "ul",
)
INLINE = (
    "a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span",
    "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "button", "label", "input",
)
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
# First or last words of class, id and role names that mark an element.
STRONG = (
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "sponsors", "promo", "promotion", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "masthead", "siteheader", "pageheader", "sitefooter", "footer", "sidebar", "notice", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "newsletter", "subscribe", "share", "sharing", "social",
    "login", "signup", "toolbar", "pagination", "pager", "contentinfo", "complementary", "alert", "alertdialog",
)
READERS = ("comment", "comments", "commentlist", "disqus", "respond", "replies")
WEAK = ("related", "search", "widget")
# Words that say what an element is for or has beside it; such a name marks nothing.
QUALIFIERS = ("with", "without", "has", "have", "no", "non", "not")
DEFAULT_WEIGHTS = {"p": 0.1, "b": 0.1, "br": 0.1, "i": 0.1, "em": 0.1, "strong": 0.1, "span": 0.2, "h1": 0.1, "h2": 0.1, "h3": 0.1, "blockquote": 0.1, "article": 0.1, "main": 0.1, "a": 1.0, "li": 1.0, "ul": 1.0, "div": 0.5}
OTHER_WEIGHT = 0.5
#: What a marked element costs at most, in words, in the text around it.
BARRIER = 30.0
#: By what the score of a marked element's own text is reduced; the last is for an article inside of one.
GUESS = {"strong": 0.05, "readers": 0.0, "weak": 0.3, "article": 0.5}
#: The reduced score from which a marked element's text is taken at all: some 50 words where the mark is strong.
LEAST_GUESS = 2.5
#: A weakly marked element of that many words, of which fewer than that share are links, is text.
PROSE_WORDS, PROSE_LINKS = 20, 0.3

_RAW, _DROPPED, _EXCLUDED, _CONTAINERS, _BLOCKS, _VOID = map(frozenset, (RAW, DROPPED, EXCLUDED, CONTAINERS, BLOCKS, VOID))
_KNOWN = frozenset((*DROPPED, *EXCLUDED, *BLOCKS, *INLINE))
_ALONE = {t: frozenset(g) for g in (("li",), ("dt", "dd"), ("tr",), ("td", "th"), ("option",)) for t in g}
_TAG = re.compile(
    r"""<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:((?:[^<>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+)>|([^<>]*+)>?)|(!--|!\[CDATA\[)|[!?/][^>]*+>?)"""
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PART = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_END = {t: re.compile(f"</{t}(?=[\\s/>])[^>]*>?", re.I) for t in RAW}


def mark(tag: str, attrs: str, inside: bool) -> str:
    """'strong', 'readers' or 'weak' if the element is marked, else ''. ``inside``: in an article or main element."""
    if tag in _EXCLUDED and not (tag == "header" and inside):
        return "strong"
    if "=" not in attrs or tag in ("body", "html"):
        return ""
    found = ""
    for _, a, b, c in _ATTR.findall(attrs):
        for name in (a or b or c).split():
            parts = [x.lower() for x in _PART.findall(_CAMEL.sub("-", name))]
            if not parts or not {*parts}.isdisjoint(QUALIFIERS):
                continue
            ends = (parts[0], parts[-1], "".join(parts[:2]))
            if any(x in READERS for x in ends):
                return "readers"
            if tag not in _CONTAINERS and tag != "p" or ends[0] in ("ad", "ads", "advert", "notice", "cookie", "cookies"):
                if any(x in STRONG for x in ends):
                    found = "strong"
                elif not found and any(x in WEAK for x in ends):
                    found = "weak"
    return found


class Page:
    """Tokens (kind, value, group, box): kind 't' text or tag name for 'o' (open) and 'c' (close). Group 0 is unmarked, -1 is never text, any
    other one is a marked element's; box: number of the innermost article or main element around, 0 for none."""

    def __init__(self, html: str):
        self.tokens: list[tuple[str, str, int, int]] = []
        self.guess = [1.0]
        self.parent = [0]
        self.kind = [""]
        self.words = [0]
        self.linked = [0]
        self.stack: list[tuple[str, int, int]] = []  # tag, group and box outside of it
        self.open: dict[str, int] = {}
        self.group = self.box = self.boxes = self.links = 0
        self._read(html)

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        endless: set[str] = set()  # what has no end from here on
        while at < size:
            m = _TAG.search(html, at)
            self._text(html[at : m.start() if m else size])
            if not m:
                return
            at = m.end()
            if m[5]:
                end = "-->" if m[5] == "!--" else "]]>"
                to = -1 if end in endless else html.find(end, at)
                if to < 0:
                    endless.add(end)
                    to = html.find(">", at)
                    at = size if to < 0 else to + 1
                else:
                    at = to + 3
                continue
            if m[2] is None:
                continue
            tag, attrs = m[2].lower(), m[3] or m[4] or ""
            if m[1]:
                self._close(tag)
                continue
            if tag in _RAW:
                end = None if tag in endless else _END[tag].search(html, at)
                if end or tag in ("script", "style"):
                    at = end.end() if end else size
                else:
                    endless.add(tag)
                self.tokens.append(("o", tag, -1, self.box))
                continue
            self._open(tag, attrs, tag in _VOID or attrs.endswith("/"))

    def _text(self, text: str) -> None:
        if text:
            if self.group >= 0:
                n = len(text.split())
                self.words[self.group] += n
                if self.links > 0:
                    self.linked[self.group] += n
            self.tokens.append(("t", text, self.group, self.box))

    def _pop(self) -> None:
        tag, self.group, self.box = self.stack.pop()
        self.open[tag] -= 1
        if tag == "a":
            self.links -= 1

    def _open(self, tag: str, attrs: str, void: bool) -> None:
        if void:
            self.tokens.append(("o", tag, self.group, self.box))
            return
        if tag in _BLOCKS and self.open.get("p"):
            k = next((k for k in range(1, 1 + min(10, len(self.stack))) if self.stack[-k][0] in _BLOCKS), 0)
            if k and self.stack[-k][0] == "p":
                for _ in range(k):
                    self._pop()
        if tag in _ALONE and self.stack and self.stack[-1][0] in _ALONE[tag]:
            self._pop()
        self.stack.append((tag, self.group, self.box))
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag == "a":
            self.links += 1
        if self.group >= 0:
            kind = "" if tag in _DROPPED else mark(tag, attrs, self.box > 0)
            if tag in _DROPPED:
                self.group = -1
            elif kind:
                self._new(kind, self.guess[self.group] * GUESS[kind])
            elif tag in _CONTAINERS:
                if self.group and self.kind[self.group] not in ("readers", "article"):
                    self._new("article", max(self.guess[self.group], GUESS["article"]))
                self.boxes += 1
                self.box = self.boxes
        self.tokens.append(("o", tag, self.group, self.box))

    def _new(self, kind: str, guess: float) -> None:
        for rows, x in ((self.guess, guess), (self.parent, self.group), (self.kind, "readers" if self.kind[self.group] == "readers" else kind), (self.words, 0), (self.linked, 0)):
            rows.append(x)
        self.group, self.box = len(self.guess) - 1, 0 if kind != "article" else self.box

    def _close(self, tag: str) -> None:
        self.tokens.append(("c", tag, self.group, self.box))
        if not self.open.get(tag):
            return
        if tag not in _BLOCKS and tag not in _DROPPED:
            # an inline element ends nothing but inline elements, and those not far up
            for k in range(1, 1 + min(50, len(self.stack))):
                if self.stack[-k][0] == tag:
                    break
                if self.stack[-k][0] in _BLOCKS:
                    return
            else:
                return
        while self.stack[-1][0] != tag:
            self._pop()
        self._pop()

    def prose(self) -> None:
        """Weakly marked elements that hold prose become part of what is around them."""
        to = list(range(len(self.guess)))
        for g in range(1, len(to)):
            plain = self.kind[g] == "weak" and self.words[g] >= PROSE_WORDS and self.linked[g] < PROSE_LINKS * self.words[g]
            to[g] = to[self.parent[g]] if plain else g
            self.parent[g] = to[self.parent[g]]
        if to != list(range(len(to))):
            self.tokens = [(k, v, to[g] if g > 0 else g, b) for k, v, g, b in self.tokens]


def best_region(scores: list[float]) -> tuple[float, int, int]:
    """(sum, first, end) of the contiguous scores with the largest sum; (0, 0, 0) if none is positive."""
    best = total = 0.0
    first, found = 0, (0, 0)
    for i, x in enumerate(scores):
        total += x
        if total <= 0:
            total, first = 0.0, i + 1
        elif total > best:
            best, found = total, (first, i + 1)
    return best, *found


def group_scores(page: Page, weights: dict[str, float]) -> dict[int, tuple[list[float], list[int]]]:
    """(scores, token numbers) of each group: its words and tags, and what it costs to pass over marked elements inside."""
    out: dict[int, tuple[list[float], list[int]]] = {}
    last = 0
    inner = 0.0
    for i, (kind, value, g, _) in enumerate(page.tokens):
        if g < 0:
            continue
        scores, places = out.setdefault(g, ([], []))
        if g != last:
            # back from marked elements inside of this one: groups are numbered as they begin
            if g < last and scores:
                scores.append(-min(BARRIER, inner))
                places.append(i)
            inner, last = 0.0, g
        n = len(value.split()) if kind == "t" else 0
        scores.append(float(n) if kind == "t" else -weights.get(value, OTHER_WEIGHT))
        places.append(i)
        inner += n
    return out


def _region(page: Page, weights: dict[str, float]) -> tuple[int, int, int]:
    """(group, first, end): the best region of the best candidate."""
    best, found = 0.0, (0, 0, 0)
    for g, (scores, places) in sorted(group_scores(page, weights).items()):
        total, first, end = best_region(scores)
        if total * page.guess[g] > best and (not g or total * page.guess[g] >= LEAST_GUESS):
            best, found = total * page.guess[g], (g, places[first], places[end - 1] + 1)
    return found


def _widen(toks: list[tuple], group: int, first: int, end: int) -> tuple[int, int, set[int] | None]:
    """(first, end, boxes that the text is taken from or None for all)."""
    words: dict[int, int] = {}
    for kind, value, g, box in toks[first:end]:
        if kind == "t" and g == group:
            words[box] = words.get(box, 0) + len(value.split())
    loose = words.pop(0, 0)
    boxes = {b for b, n in words.items() if n}
    if boxes and sum(words.values()) >= loose:
        at = [i for i, t in enumerate(toks) if t[3] in boxes and t[2] == group]
        return at[0], at[-1] + 1, boxes
    while first and not (toks[first - 1][0] != "t" and toks[first - 1][1] in _BLOCKS):
        first -= 1
    while end < len(toks) and not (toks[end][0] != "t" and toks[end][1] in _BLOCKS):
        end += 1
    return first, end, None


def main_text(html: str | None, weights: dict[str, float] | None = None) -> str:
    page = Page(html or "")
    page.prose()
    group, first, end = _region(page, weights or DEFAULT_WEIGHTS)
    if first == end:
        return ""
    first, end, boxes = _widen(page.tokens, group, first, end)
    blocks: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if now:
            s = " ".join(unescape("".join(now)).split())
            now.clear()
            if s:
                blocks.append(s)

    for kind, value, g, box in page.tokens[first:end]:
        if kind != "t":
            if value in _BLOCKS:
                flush()
            elif value == "br" and g == group:
                now.append(" ")
        elif g == group and (boxes is None or box in boxes):
            now.append(value)
    flush()
    return "\n".join(blocks)


def fit_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = 2000) -> dict[str, float]:
    """Weights of tags from about ``sample`` labelled pages at most."""
    html = F.lower(F.coalesce(F.col(html_col), F.lit("")))
    labelled = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).filter(F.contains(html, F.lit("<article")) | F.contains(html, F.lit("<main")))
    share = min(1.0, sample / max(1, labelled.count()))
    some = labelled.filter(F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def fn(b):
        n: dict[str, list[int]] = {}
        for h in b.column(1).to_pylist():
            for kind, value, group, box in Page(h).tokens:
                if kind != "t":
                    n.setdefault(value if value in _KNOWN else "other", [0, 0])[0 if not group and box else 1] += 1
        return {"tag": list(n), "inside": [v[0] for v in n.values()], "outside": [v[1] for v in n.values()]}

    counts = map_arrow(some, fn, "tag string, inside long, outside long").groupBy("tag").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()
    weights = dict(DEFAULT_WEIGHTS)
    for tag, i, o in counts:
        # log-odds of standing outside, between a small cost and that of a few words
        weights[tag] = min(4.0, max(0.05, 1.0 + math.log((o + 0.5) / (i + 0.5))))
    return weights


def extract_text(pages: DataFrame, weights: dict[str, float] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text, n_chars."""
    w = weights if weights is not None else fit_weights(pages, id_col, html_col)

    def fn(b):
        made = [main_text(h, w) for h in b.column(2).to_pylist()]
        return {id_col: b.column(0), url_col: b.column(1), "text": made, "n_chars": [len(x) for x in made]}

    return map_arrow(pages.select(id_col, url_col, html_col), fn, f"{id_col} long, {url_col} string, text string, n_chars long")
