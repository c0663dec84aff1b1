"""Token counts by prefix dynamic programming, for BPE vocabularies with word ends.

``count[i]`` is the exact number of tokens of the first i characters of a text, for every i, as the library counts
them for that prefix alone. It is stored in two levels: where each word of the text begins, with the tokens before it,
and for each word the counts of its own prefixes. Totals, truncation to a budget and counts of prefixes are read from there;
nothing is encoded again.

A word's counts come from a dynamic programme over its bytes. The last token of a prefix's encoding, t, and the
encoding before it are right exactly if t stands after the last token of that shorter prefix, i.e. if merging the two by the
vocabulary's ranks gives the two back; one token fits for each prefix, and its count is that of the shorter prefix plus one. Whether two
tokens stand side by side is told by undoing their merges from the latest on (``MergeTable.beside``). Each prefix is closed
by a token with the word end. Words are kept in a bounded memo of each task.

Prefixes are those of the text as given. The vocabulary's normaliser (NFC, white space, lower case) may change the last
characters of a prefix when more follow; such prefixes are counted by the words of their own normal form. Special strings inside texts count as one
token, as by the library's default, and their prefixes as ordinary text. Kinds and cases of characters are the library's: where
its version of Unicode differs, the character is looked up there, once a task.

Null counts as an empty text: 0 tokens. Texts and words of any length are read whole. Repeated rows and ids, and null ids, are each
reported. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate
from operator import itemgetter

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, only

MEMO_WORDS = 800_000
MEMO_PAIRS = 500_000
END = "</w>"
# Runs of letters, single digits and runs of the rest in the vocabulary's splitting pattern.
CLASSES = (r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+")


class MergeTable:
    """Tokens by number: bytes, bytes that end a word (256 on), then the merges in their order (512 on)."""

    def __init__(self, merges: list):
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(shown)]
        letter = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(other)}
        number = {c: b for c, b in letter.items()} | {c + END: 256 + b for c, b in letter.items()}
        self.rank, self.left, self.right = [-1] * 512, [-1] * 512, [-1] * 512
        self.pairs: dict[int, int] = {}
        spelled = [chr(b % 256) for b in range(512)]
        for r, pair in enumerate(merges):
            a, b = (number[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            name = (pair.replace(" ", "") if isinstance(pair, str) else "".join(pair))
            if name in number:
                raise ValueError("two merges make the same token")
            number[name] = len(self.rank)
            for rows, x in ((self.rank, r), (self.left, a), (self.right, b)):
                rows.append(x)
            self.pairs[a << 20 | b] = r
            spelled.append(spelled[a] + spelled[b])
        closed = [256 <= k < 512 for k in range(512)]
        for k in range(512, len(self.rank)):
            closed.append(closed[self.right[k]])
        # spelling -> (token within a word, token that ends one), -1 for none; every prefix of a token is a key
        self.walk: dict[str, tuple[int, int]] = {}
        sound = [True] * 512
        for k in range(len(self.rank)):
            if k >= 512:
                a, b = self.left[k], self.right[k]
                sound.append(sound[a] and sound[b] and self.beside(a, b, self.rank[k]))
            s = spelled[k]
            for n in range(1, len(s)):
                self.walk.setdefault(s[:n], (-1, -1))
            o, c = self.walk.get(s, (-1, -1))
            if sound[k]:
                o, c = (o, k) if closed[k] else (k, c)
            self.walk[s] = o, c
        self.known: dict[int, bool] = {}

    def beside(self, a: int, b: int, before: float = float("inf")) -> bool:
        """True if merging the bytes of a and b by ranks (below ``before``) gives a and b.

        The two meet as a whole last of all; undoing the later of their merges (of equal ones that of b, as the left one
        comes first) tells which parts met before that, and until when. They stay apart if no such meeting is a merge that comes sooner.
        """
        rank, pairs = self.rank, self.pairs
        while True:
            r = pairs.get(a << 20 | b)
            if r is not None and r < before:
                return False
            x, y = rank[a], rank[b]
            if x < 0 and y < 0:
                return True
            if y >= x:
                before, b = y + 1, self.left[b]
            else:
                before, a = x, self.right[a]

    def prefixes(self, word: str) -> list[int]:
        """For each character: the tokens of the word up to it."""
        raw = word.encode("utf-8", "surrogatepass")
        s, size = raw.decode("latin-1"), len(raw)
        last, inner, closed = [-1] * (size + 1), [0] * (size + 1), [0] * (size + 1)
        walk, known, beside = self.walk.get, self.known, self.beside
        for j in range(size):
            before, n = last[j], inner[j] + 1
            if before < 0 and j:
                continue
            for e in range(j + 1, size + 1):
                found = walk(s[j:e])
                if found is None:
                    break
                o, c = found
                # starts come in order, so the longest token that ends here is tried first; one alone fits
                if o >= 0 and last[e] < 0:
                    if j:
                        key = before << 20 | o
                        ok = known.get(key)
                        if ok is None:
                            ok = known[key] = beside(before, o)
                        if ok:
                            last[e], inner[e] = o, n
                    else:
                        last[e], inner[e] = o, n
                if c >= 0 and not closed[e]:
                    if j:
                        key = before << 20 | c
                        ok = known.get(key)
                        if ok is None:
                            ok = known[key] = beside(before, c)
                        if ok:
                            closed[e] = n
                    else:
                        closed[e] = n
        if len(known) > MEMO_PAIRS:
            known.clear()
        if size == len(word):
            return closed[1:]
        return [closed[e] for e in accumulate(len(c.encode("utf-8", "surrogatepass")) for c in word)]


class PrefixCounter:
    """Counts of one vocabulary file (type BPE, normaliser NFC + white space + lower case, a splitting pattern)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        steps = spec["normalizer"]["normalizers"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("this counter needs the normaliser NFC, Replace, Lowercase")
        if spec["model"]["end_of_word_suffix"] != END or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("this counter needs word ends and plain added tokens")
        # white space is in no word, so what it is replaced by makes no difference to a count
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if any(x not in self.pattern for x in CLASSES):
            raise ValueError("this counter needs words of letters, digits and other characters")
        self.words = self.odd_words = regex.compile(self.pattern)
        self.library = Tokenizer.from_file(path)
        self.met = {chr(c) for c in range(128)}
        self.kinds: dict[str, str] = {}  # characters of another kind in the library than here
        self.forms: set[str] = set()  # characters with another normal form there
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = tuple(special)
        self.split = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))).finditer
        self.merges = MergeTable(spec["model"]["merges"])
        self.memo = _Memo(self)

    def meet(self, text: str) -> bool:
        """True if the text has characters that the library reads by another version of Unicode. Each is looked up there once."""
        here = set(text)
        for c in here - self.met:
            self.met.add(c)
            try:
                pieces = [len(self.library.pre_tokenizer.pre_tokenize_str(x + c)) for x in ("a", "!")]
                form = self.library.normalizer.normalize_str(c)
            except (UnicodeEncodeError, TypeError):
                continue
            kind = "L" if pieces[0] == 1 and pieces[1] == 2 else "N" if pieces == [2, 2] else "O" if pieces[0] == 2 else "S"
            if kind != ("L" if regex.match(r"\p{L}", c) else "N" if regex.match(r"\p{N}", c) else "S" if regex.match(r"\s", c) else "O"):
                self.kinds[c] = kind
                self.odd_words = self._pattern()
            if form != self.lower(unicodedata.normalize("NFC", c)) and not c.isspace():
                self.forms.add(c)
        return bool(self.kinds) and not here.isdisjoint(self.kinds) or bool(self.forms) and not here.isdisjoint(self.forms)

    def _pattern(self):
        def having(kind: str) -> str:
            some = "".join(regex.escape(c) for c in sorted(self.kinds) if self.kinds[c] == kind)
            return f"[{some}]" if some else r"(?!)"

        odd = "[" + "".join(regex.escape(c) for c in sorted(self.kinds)) + "]"
        made = self.pattern
        for plain, kind, chars, many in zip(CLASSES, "LNO", (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]"), ("+", "", "+"), strict=True):
            made = made.replace(plain, f"(?:{having(kind)}|(?!{odd}){chars}){many}")
        return regex.compile(made)

    def find(self, text: str) -> list[str]:
        """Words of a normalised text."""
        return (self.words if text.isascii() or not self.meet(text) else self.odd_words).findall(text)

    def iter(self, text: str):
        return (self.words if text.isascii() or not self.meet(text) else self.odd_words).finditer(text)

    def lower(self, text: str) -> str:
        # as the library lower-cases: each character alone, without the rule for a final sigma
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def normalise(self, text: str) -> str:
        if not text.isascii() and self.meet(text) and not self.forms.isdisjoint(text):
            return self.library.normalizer.normalize_str(text)
        return self.lower(text if text.isascii() else unicodedata.normalize("NFC", text))

    def plain_count(self, text: str) -> int:
        """Tokens of a text without special strings, by its words' last counts."""
        memo = self.memo
        n = sum(map(itemgetter(-1), map(memo.__getitem__, self.find(self.normalise(text)))))
        if len(memo) > MEMO_WORDS:
            memo.clear()
        return n

    def parts(self, text: str) -> list[tuple[str, str]]:
        """(ordinary text, special string after it) in order; the last one has none."""
        out, at = [], 0
        if any(s in text for s in self.special):
            for m in self.split(text):
                out.append((text[at : m.start()], m.group()))
                at = m.end()
        return [*out, (text[at:], "")]

    def count(self, text: str) -> int:
        parts = self.parts(text)
        return sum(self.plain_count(s) for s, _ in parts) + len(parts) - 1

    def table(self, text: str) -> "TextTable":
        return TextTable(self, text)

    def fit(self, text: str, budget: int) -> int:
        """The most characters that a prefix of at most ``budget`` tokens can have; reads no further than these where it can."""
        return TextTable(self, text, budget).fit(budget)


class _Memo(dict):
    """Word -> the counts of its prefixes, by character."""

    def __init__(self, counter: PrefixCounter):
        self.counter = counter

    def __missing__(self, word: str):
        counts = self.counter.merges.prefixes(word)
        # a contraction is a word of its own only when it is whole
        if word[0] == "'" and 1 < len(word) <= 3 and word[1].isalpha():
            counts[:-1] = [sum(self[x][-1] for x in self.counter.find(word[:n])) for n in range(1, len(word))]
        entry = bytes(counts) if max(counts) < 256 else array("l", counts)
        if len(word) <= 64:
            self[word] = entry
        return entry


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Characters that may change with what stands before them under NFC."""
    second = {chr(int(d.split()[1], 16)) for d in (unicodedata.decomposition(chr(c)) for c in range(0x110000)) if len(d.split()) == 2 and d[0] != "<"}
    return frozenset(second | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))})


class TextTable:
    """The two-level table of one text: its words (first character, tokens before them, counts of their prefixes) and what
    differs from that: prefixes that end within a character sequence of which NFC or lower case makes something else."""

    def __init__(self, counter: PrefixCounter, text: str, enough: int | None = None):
        """``enough``: words after that many tokens may be left out of a text without special strings."""
        self.size = len(text)
        self.starts: list[int] = []
        self.before: list[int] = []
        self.entries: list = []
        self.other: dict[int, int] = {}
        at = base = 0
        parts = counter.parts(text)
        self.steady = len(parts) == 1  # no string whose prefixes have more tokens than itself
        for plain, special in parts:
            whole = plain + special[:-1]
            total = self._plain(counter, whole, at, base, len(plain), enough if self.steady else None)
            at += len(plain) + len(special)
            if special:
                # the string as a whole is one token: a word without a prefix of its own
                self.starts.append(at - 1)
                self.before.append(base + total)
                self.entries.append(b"\1")
            base += total + bool(special)
        self.total = base

    def _plain(self, counter: PrefixCounter, text: str, at: int, base: int, upto: int, enough: int | None) -> int:
        """Adds the words of a stretch without special strings; returns the tokens of its first ``upto`` characters."""
        n, total, last = base, 0, 0
        if text.isascii() or not counter.meet(text) and unicodedata.is_normalized("NFC", text) and len(counter.lower(text)) == len(text):
            for m in counter.iter(counter.lower(text)):
                entry = counter.memo[m.group()]
                if m.start() < upto:
                    total = n - base + entry[min(m.end(), upto) - m.start() - 1]
                self.starts.append(at + m.start())
                self.before.append(n)
                self.entries.append(entry)
                n += entry[-1]
                if enough is not None and n > enough:
                    return n
            if len(counter.memo) > MEMO_WORDS:
                counter.memo.clear()
            return total
        # the text by steps that NFC treats alone; places in the normal form -> places in the text
        joining = _joining()
        cuts = [i for i, c in enumerate(text) if not i or not unicodedata.combining(c) and c not in joining] + [len(text)]
        norm, to = [], []
        odd: list[tuple[int, int, str]] = []  # characters read, length of the normal form before the step, normal form of the rest
        size = 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            made = counter.normalise(text[a:b])
            for i in range(a + 1, b):
                odd.append((i, size, counter.normalise(text[a:i])))
            to += [b] * len(made)
            if made:
                norm.append(made)
            size += len(made)
        whole = "".join(norm)
        words = [(m.start(), m.end()) for m in counter.iter(whole)]
        counts = {0: 0}
        ends, sums = [0], [0]
        for a, b in words:
            entry = counter.memo[whole[a:b]]
            for k in range(b - a):
                # of characters that become several, the last one counts
                counts[to[a + k]] = sums[-1] + entry[k]
            ends.append(b)
            sums.append(sums[-1] + entry[-1])
        firsts = [a for a, _ in words]
        for i, head, tail in odd:
            k = max(0, bisect_left(firsts, head) - 1)
            while k and (ends[k] == firsts[k] and whole[firsts[k - 1] : firsts[k]] == "'"):
                k -= 1
            start = firsts[k] if firsts and firsts[k] < head else head
            before = sums[k] if start < head else sums[bisect_left(firsts, head)]
            counts[i] = before + sum(counter.memo[w][-1] for w in counter.find(whole[start:head] + tail))
        for i in range(1, len(text) + 1):
            # blanks add nothing
            last = counts[i] if i in counts else last
            self.other[at + i] = base + last
            if i == upto:
                total = last
        return total

    def count(self, chars: int) -> int:
        """Tokens of the first ``chars`` characters."""
        if chars in self.other:
            return self.other[chars]
        k = bisect_left(self.starts, chars) - 1
        if k < 0:
            return 0
        entry = self.entries[k]
        return self.before[k] + entry[min(chars - self.starts[k], len(entry)) - 1]

    def counts(self) -> array:
        """The table as one row: the count of every prefix, from none to all characters."""
        out = array("l", [0]) * (self.size + 1)
        ends = [*self.starts[1:], self.size][: len(self.starts)]
        for s, e, n, entry in zip(self.starts, ends, self.before, self.entries, strict=True):
            for k, x in enumerate(entry, 1):
                out[s + k] = n + x
            out[s + len(entry) + 1 : e + 1] = array("l", [n + entry[-1]]) * (e - s - len(entry))
        for i, x in self.other.items():
            out[i] = x
        return out

    def fit(self, budget: int) -> int:
        """The most characters that a prefix of at most ``budget`` tokens can have."""
        if self.total <= budget:
            return self.size
        if self.other or not self.steady:
            return max(i for i, x in enumerate(self.counts()) if x <= budget)
        # tokens before a word never get fewer, and a word has one at least: only the last word with room before it matters
        k = bisect_left(self.before, budget) - 1
        if k < 0:
            return self.starts[0]
        entry, n = self.entries[k], self.before[k]
        if n + entry[-1] <= budget:
            return self.starts[k + 1] if k + 1 < len(self.starts) else self.size
        return self.starts[k] + max((i for i, x in enumerate(entry, 1) if n + x <= budget), default=0)


def counter(path: str) -> PrefixCounter:
    return only(("tokens", path), lambda: PrefixCounter(path))


def prefix_tables(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, counts array<int>: the tokens of every prefix of the text, the empty one first. To be stored and asked by
    ``prefix_count`` and ``fit_chars``."""

    def fn(b):
        return {id_col: b.column(0), "counts": [counter(path).table(t or "").counts() for t in b.column(1).to_pylist()]}

    return map_arrow(docs.select(id_col, text_col), fn, f"{id_col} long, counts array<int>")


def prefix_count(counts: Column, chars: Column) -> Column:
    """Tokens of the first ``chars`` characters, from a stored table."""
    return F.get(counts, F.least(chars, F.size(counts) - 1))


def fit_chars(counts: Column, budget: Column) -> Column:
    """The most characters that a prefix of at most ``budget`` tokens can have, from a stored table."""
    places = F.transform(counts, lambda x, i: F.when(x <= budget, i))
    return F.array_max(places)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit, fit_chars (the most characters that a prefix of at most ``limit`` tokens can have)."""

    def fn(b):
        c = counter(path)
        texts = [t or "" for t in b.column(1).to_pylist()]
        n = [c.count(t) for t in texts]
        fit = [len(t) if k <= limit else c.fit(t, limit) for t, k in zip(texts, n, strict=True)]
        return {id_col: b.column(0), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [k > limit for k in n], "fit_chars": fit}

    return map_arrow(docs.select(id_col, text_col), fn, f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
