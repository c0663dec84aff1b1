"""Benchmark decontamination by template windows.

Texts and items are reduced to templates: words in lower case, with typed placeholders for
numbers, units after a number, and names (capitalised words within a sentence). A capitalised word that starts a
sentence is read both as itself and as a name, unless it is a common word that is never capitalised within one;
names are read as plain words too, so that texts in another case match. Windows
of ``width`` template tokens of the items are hash-joined with those of the documents. Windows
on one diagonal (document place less item place) form an alignment; in it the values behind the
placeholders are compared: windows with equal ones are exact, and a run of windows in which each value is renamed to one other
is a re-parameterised question (two values may become the same); an alignment counts with its exact windows or its longest
such run, whichever cover more. A document holds an item if its alignments cover ``coverage`` of the item's tokens.

The items are joined as broadcast hash tables of at most ``block_windows`` windows each, one
after the other: one table is enough for most benchmarks, and larger ones take more passes
over the documents, not more memory. A document is cut into tokens once a pass, and templates are made only where
a run of tokens that could all stand in an item has the longest
word of a window and its neighbours among them: every window that matches lies around such a word.

Items of fewer than ``width`` tokens have one window, the whole item; items of fewer than
``min_tokens`` tokens are too short to be told from chance, and windows with fewer than 3 words proper
(or only words, if shorter) aren't joined. Null counts as empty. Repeated items and documents are reported each, and so are
rows without an id. Empty tables give empty results; extra columns of both tables are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

# Units that may follow a number.
UNITS = frozenset(
    "mm cm m km in ft mi yd g kg mg lb oz t s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "kb mb gb tb hz khz mhz ghz v w kw mw j kj cal kcal c f k l ml usd eur gbp dollar dollars euro euros cent cents pound pounds percent pct mph kmh "
    "apples degrees meter meters metre metres mile miles inch inches foot feet gram grams liter liters litre litres".split()
)
# Number words.
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())
# Words that start sentences and are no names.
COMMON = frozenset(
    "the an in on at of to for from by with as if is are was were be been do does did has have had can could will would shall should may might must not no yes and or but so then than "
    "it its he she we you they his her our your their my this that these those there here what when where which who whom whose why how all any both each every few many more most much "
    "some such one two three after before during while since until because although though however also only just now let given find suppose consider assume calculate compute determine "
    "solve write show prove explain use note please first second next last finally later if about over under into out up down".split()
)
NUM, UNIT, NAME = "\x01n", "\x01u", "\x01p"
_TOKEN = re.compile(r"[0-9]+(?:[.,][0-9]+)*|[^\W\d_]+|\d+")
_END = re.compile(r"[.!?:;|\n\"“”]")
MIN_LITERALS = 3


def read(text: str, tokens: list[re.Match], a: int, b: int, named: Callable[[str], bool]) -> tuple[list[str], list[str], list[int]]:
    """Of tokens a to b: (template tokens, values, places of words that start a sentence and may be names). A value is the
    lower-case token itself; ``named`` tells if a common word is a name elsewhere in the text."""
    out, values, maybe = [], [], []
    number = False
    if a:
        w = tokens[a - 1].group()
        number = w[0].isdigit() or w.lower() in NUMBERS
    for k in range(a, b):
        w = tokens[k].group()
        low = w.lower()
        if w[0].isdigit() or low in NUMBERS:
            kind = NUM
        elif number and low in UNITS:
            kind = UNIT
        elif len(w) > 1 and w[0].isupper() and not w.isupper():
            kind = NAME
            if begins(text, tokens, k):
                kind = low
                if low not in COMMON or named(low):
                    maybe.append(k - a)
        else:
            kind = low
        number = kind is NUM
        out.append(kind)
        values.append(low)
    return out, values, maybe


def begins(text: str, tokens: list[re.Match], k: int) -> bool:
    """True if token k starts a sentence."""
    return not k or _END.search(text, tokens[k - 1].end(), tokens[k].start()) is not None


def names_of(text: str, tokens: list[re.Match]) -> Callable[[str], bool]:
    """A test for words that are capitalised within a sentence of the text; they are looked for when first asked for."""
    names: set[str] | None = None

    def named(low: str) -> bool:
        nonlocal names
        if names is None:
            names = set()
            for k, m in enumerate(tokens):
                w = m.group()
                if len(w) > 1 and w[0].isupper() and not w.isupper() and w.lower() in COMMON and w.lower() not in NUMBERS and not begins(text, tokens, k):
                    names.add(w.lower())
        return low in names

    return named


def readings(text: str) -> tuple[list[str], list[str], list[int]]:
    """``read`` of a whole text."""
    tokens = list(_TOKEN.finditer(text))
    return read(text, tokens, 0, len(tokens), names_of(text, tokens))


def template(text: str) -> tuple[list[str], list[str]]:
    """(template tokens, values)."""
    return readings(text)[:2]


def window_readings(t: list[str], v: list[str], maybe: list[int], i: int, n: int) -> Iterator[list[str]]:
    """The window of n tokens from i on: with each choice of names among ``maybe``, and with all names as plain words."""
    w = t[i : i + n]
    yield w
    some = [p - i for p in maybe if i <= p < i + n]
    for k in range(1, len(some) + 1):
        for picks in combinations(some, k):
            x = w.copy()
            for p in picks:
                x[p] = NAME
            yield x
    if NAME in w:
        yield [b if a is NAME else a for a, b in zip(w, v[i : i + n], strict=True)]


def _useful(window: list[str], width: int) -> bool:
    words = sum(t[0] != "\x01" for t in window)
    return words >= MIN_LITERALS or words == len(window) > 0 and len(window) < width


class ItemTable:
    """Windows of some items, and the tests that let most documents pass at once."""

    def __init__(self, items: list[tuple[int, str]], width: int, min_tokens: int):
        self.width = width
        self.items: dict[int, tuple[int, list[str], list[str]]] = {}  # id, kinds of slots (else the word), values
        self.windows: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.sizes: set[int] = set()
        words: set[str] = set()
        anchors: dict[str, set[tuple[str | None, str | None]]] = defaultdict(set)
        for k, (item, text) in enumerate(items):
            t, v, maybe = readings(text)
            if len(t) < min_tokens:
                continue
            slots = t.copy()
            for p in maybe:
                slots[p] = NAME
            self.items[k] = (item, slots, v)
            n = min(width, len(t))
            self.sizes.add(n)
            words.update(v)
            for i in range(len(t) - n + 1):
                for x in window_readings(t, v, maybe, i, n):
                    if not _useful(x, width):
                        continue
                    self.windows["\x00".join(x)].append((k, i))
                    w = [None if y[0] == "\x01" else y for y in x]
                    at = max((j for j in range(n) if w[j]), key=lambda j: (len(w[j]), w[j]))
                    anchors[w[at]].add((w[at - 1] if at else None, w[at + 1] if at + 1 < n else None))
        self.shortest = min(self.sizes, default=0)
        self.anchors = anchors
        self.run = re.compile(b"[\1\2]{%d,}" % max(1, self.shortest))
        self.flag = _Flags(words, set(anchors), {x for _, kinds, _ in self.items.values() for x in kinds if x[0] == "\x01"})

    def hits(self, text: str, width: int, coverage: float) -> list[tuple[int, str, int, int]]:
        """(item, kind, covered tokens, item tokens) of the items that the text holds."""
        starts = self._starts(text) if self.windows else {}
        if not starts:
            return []
        tokens = list(_TOKEN.finditer(text))
        named = names_of(text, tokens)
        v: dict[int, str] = {}
        lines: dict[tuple[int, int], set[int]] = defaultdict(set)
        for n, some in starts.items():
            at = 0
            while at < len(some):
                # windows that overlap are read together
                to = at + 1
                while to < len(some) and some[to] <= some[to - 1] + n:
                    to += 1
                a = some[at]
                t, low, maybe = read(text, tokens, a, some[to - 1] + n, named)
                v.update(enumerate(low, a))
                for i in some[at:to]:
                    for x in window_readings(t, low, [p for p in maybe if i - a <= p < i - a + n], i - a, n):
                        for k, place in self.windows.get("\x00".join(x), ()):
                            if n == min(width, len(self.items[k][1])):
                                lines[k, i - place].add(place)
                at = to
        found: dict[int, tuple[set[int], bool]] = {}
        for (k, shift), starts in lines.items():
            places, same = self._consistent(k, shift, sorted(starts), v)
            if places:
                covered, exact = found.get(k, (set(), True))
                found[k] = (covered | places, exact and same)
        out = []
        for k, (covered, exact) in sorted(found.items()):
            item, it, _ = self.items[k]
            if len(covered) >= coverage * len(it):
                out.append((item, "exact" if exact else "re-parameterised", len(covered), len(it)))
        return out

    def _starts(self, text: str) -> dict[int, list[int]]:
        """Window size -> first tokens of the windows that may match: those that hold the longest word of one of the items' windows
        with its neighbours, in a run of item tokens."""
        flags = b"".join(map(self.flag.__getitem__, text.split()))
        found: list[str] | None = None
        starts: dict[int, set[int]] = defaultdict(set)
        for run in self.run.finditer(flags):
            first, end = run.span()
            at = flags.find(b"\2", first, end)
            while at >= 0:
                if found is None:
                    found = _TOKEN.findall(text)
                before, after = found[at - 1].lower() if at else "", found[at + 1].lower() if at + 1 < len(found) else ""
                if any((a is None or a == before) and (b is None or b == after) for a, b in self.anchors[found[at].lower()]):
                    for n in self.sizes:
                        starts[n].update(range(max(first, at - n + 1), min(at, end - n) + 1))
                at = flags.find(b"\2", at + 1, end)
        return {n: sorted(x) for n, x in starts.items() if x}

    def _consistent(self, k: int, shift: int, starts: list[int], v: dict[int, str]) -> tuple[set[int], bool]:
        """(places, True if all values there are equal): those of the windows with equal values, or of the longest run of windows
        in which each value of the item stands for one of the text, whichever are more. Two values may become one."""
        _, kinds, iv = self.items[k]
        n = min(self.width, len(iv))
        places = lambda some: {p for a in some for p in range(a, a + n)}
        best = places([a for a in starts if iv[a : a + n] == [v[p + shift] for p in range(a, a + n)]])
        same = True
        last: dict[tuple[str, str], dict[str, int]] = defaultdict(dict)  # what a value became, and in which window last
        begin = 0
        for r in range(len(starts) + 1):
            cut = begin
            if r == len(starts):
                cut = r
            else:
                now: dict[tuple[str, str], str] = {}
                for p in range(starts[r], starts[r] + n):
                    if kinds[p][0] == "\x01":
                        slot, b = (kinds[p], iv[p]), v[p + shift]
                        if now.setdefault(slot, b) != b:
                            cut = r + 1
                        cut = max([cut, *(x + 1 for c, x in last[slot].items() if c != b)])
                if cut <= r:
                    for slot, b in now.items():
                        last[slot][b] = r
            if cut > begin:
                run = places(starts[begin:r])
                if len(run) > len(best):
                    best, same = run, False
                begin = cut
        return best, same


class _Flags(dict):
    """Piece between blanks -> a byte for each of its tokens: 1 if the token can stand in an item, as one of
    its words or under a placeholder that the items have; 2 if it is the longest word of a window."""

    def __init__(self, words: set[str], anchors: set[str], slots: set[str]):
        self.words, self.anchors, self.slots = words, anchors, slots

    def _can(self, w: str) -> int:
        low = w.lower()
        if low in self.words:
            return 1 + (low in self.anchors)
        if w[0].isdigit() or low in NUMBERS:
            return int(NUM in self.slots)
        if low in UNITS and UNIT in self.slots:
            return 1
        return int(NAME in self.slots and w[0].isupper() and not w.isupper())

    def __missing__(self, piece: str) -> bytes:
        f = bytes([self._can(w) for w in _TOKEN.findall(piece)])
        if len(self) > 600_000:
            self.clear()
        if len(piece) <= 64:
            self[piece] = f
        return f


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 8, coverage: float = 0.5, min_tokens: int = 5, block_windows: int = 500_000) -> DataFrame:
    """id_col, item_id, kind, covered, item_tokens: a row for each document and item that it holds."""
    spark = docs.sparkSession
    schema = f"{id_col} long, item_id long, kind string, covered int, item_tokens int"
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    # blocks by size: an item has about as many windows as words, in up to three readings each
    total = items.agg(F.sum(F.size(F.split("text", r"(?U)\W+")))).first()[0] or 0
    blocks = max(1, -(-3 * total // block_windows))
    out = None
    for k in range(blocks):
        some = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).orderBy("item", "text").collect()]
        table = spark.sparkContext.broadcast(some)
        made: list[ItemTable] = []

        def fn(b, table=table, made=made):
            if not made:
                made.append(ItemTable(table.value, width, min_tokens))
            rows = [(i, *h) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for h in made[0].hits(t, width, coverage)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            return dict(zip((id_col, "item_id", "kind", "covered", "item_tokens"), cols, strict=True))

        part = map_arrow(docs.select(id_col, text_col), fn, schema)
        out = part if out is None else out.union(part)
    return out
