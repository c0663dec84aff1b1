"""Spelling variants: pairs of words one edit apart, by merging the subtrees of a trie that holds one error.

The sorted words are dealt out in ranges; each task holds the trie of its range (as intervals of its sorted list).
At every node the largest child is heavy, the others (and the end of a word) are light. The light subtrees are
merged into the heavy one and into the node itself with one character replaced or skipped, and where the ends of two words then coincide, the
words are one edit apart:

* replaced: a light word with the heavy character in place of its own, or two light words that are equal but for that character;
* skipped: a light word without that character, or with the heavy character put in before it.

A word is in a light subtree at most log2(words) times, so that many look-ups find all of its pairs. Of a run of equal characters
only the last is skipped, so each pair comes once.

Nodes above a range's first or last word are shared with other ranges. There every child is light, and the merged ends are
keys: of a word with a wildcard in place of its character, and of the word without it. Spark joins them; a wildcard's group has at most
as many words as the alphabet has letters (``LETTERS``). Keys of over ``KEY`` characters are replaced by polynomial fingerprints modulo
2^127 - 1, so that long words cost time in step with their length. No other bound or sample is used: ranges are only as many as words ask for.

Null texts have no words. Rows without an id are read as if their id were the empty text. Repeated rows count each. Empty tables give an empty result; extra columns
are ignored. Very long texts and words are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, keep, small_batches

# Fixed values of the contract: letters, the planted slips and the least length, count and ratio.
LETTER = "A-Za-zÀ-ÿ"
LETTERS = 26 + 64
SLIP = 31
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10

RANGE_WORDS = 100_000
KEY = 64
_PRIME, _BASE = (1 << 127) - 1, 0x3C6EF372FE94F82A2B7E151628AED2A7


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n): runs of letters in A-Z lower case, one in ``slip`` with one letter taken out (by the checksum of id and run)."""
    run = F.regexp_extract_all(text_col, F.lit(f"[{LETTER}]{{{min_length},}}+"), F.lit(0))
    w = F.col("w")
    # lower() would also change letters beyond A-Z
    low = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(run).alias("w")).withColumn("w", F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER)))
    h = low.withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), w), "utf-8")))
    at = (F.col("h") % F.length(w)).cast("int")
    cut = F.concat(F.substring(w, F.lit(1), at), F.substr(w, at + 2))
    slipped = h.select(F.when(F.col("h") % slip == 0, cut).otherwise(w).alias("word"))
    return slipped.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


class Keys:
    """Keys of one word with the character at a place replaced by a wildcard, or taken out."""

    def __init__(self, word: str):
        self.word = word
        if len(word) > KEY:
            pre, power = [0], [1]
            for ch in word:
                pre.append((pre[-1] * _BASE + ord(ch)) % _PRIME)
                power.append(power[-1] * _BASE % _PRIME)
            self.pre, self.power = pre, power

    def _mark(self, length: int, value: int) -> str:
        return f"{length}:{value:032x}"

    def whole(self) -> str:
        w = self.word
        return w if len(w) <= KEY else self._mark(len(w), self.pre[-1])

    def wildcard(self, d: int) -> str:
        w, n = self.word, len(self.word)
        if n <= KEY:
            return f"{w[:d]}?{w[d + 1 :]}"
        return "?" + self._mark(n, (self.pre[-1] - ord(w[d]) * self.power[n - d - 1]) % _PRIME) + f":{d}"

    def without(self, d: int) -> str:
        w, n = self.word, len(self.word)
        if n - 1 <= KEY:
            return w[:d] + w[d + 1 :]
        tail = self.pre[n] - self.pre[d + 1] * self.power[n - d - 1]
        return self._mark(n - 1, (self.pre[d] * self.power[n - d - 1] + tail) % _PRIME)


def _common(a: str, b: str, at: int = 0) -> int:
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    while at < n and a[at] == b[at]:
        at += 1
    return at


def local_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """Places of words one edit apart whose tries part at a node within the sorted list ``words``: not above its first or last word."""
    place = {w: i for i, w in enumerate(words)}
    get = place.get
    todo = [(0, len(words), 0)]
    while todo:
        lo, hi, d = todo.pop()
        if hi - lo < 2:
            continue
        d = _common(words[lo], words[hi - 1], d)
        ends = len(words[lo]) == d
        kids, at = [], lo + ends
        while at < hi:
            ch, e = words[at][d], at + 1
            if words[hi - 1][d] == ch:
                e = hi
            else:
                while e < hi and words[e][d] == ch:
                    e += 1
            kids.append((at, e, ch))
            at = e
        todo.extend((a, e, d + 1) for a, e, _ in kids)
        if lo == 0 or hi == len(words):
            continue
        heavy = max(kids, key=lambda k: k[1] - k[0])
        h = heavy[2]
        light = [k for k in kids if k is not heavy]
        if ends:
            j = get(words[lo] + h)
            if j is not None:
                yield lo, j
        wild: dict[str, list[int]] | None = {} if len(light) > 1 else None
        for a, e, ch in light:
            for i in range(a, e):
                w = words[i]
                v, s = w[:d], w[d + 1 :]
                j = get(v + h + s)
                if j is not None:
                    yield i, j
                if s[:1] != ch:
                    j = get(v + s)
                    if j is not None:
                        yield i, j
                j = get(v + h + w[d:])
                if j is not None:
                    yield i, j
                if wild is not None:
                    same = wild.setdefault(s, [])
                    for j in same:
                        yield i, j
                    same.append(i)


def shared_keys(words: list[str]) -> Iterator[tuple[str, int, int]]:
    """(key, kind, place) of nodes above the first or last word: kind 1 one character out, 2 a wildcard."""
    first, last = words[0], words[-1]
    for i, w in enumerate(words):
        k, n = Keys(w), len(w)
        for d in range(min(n, max(_common(w, first), _common(w, last)) + 1)):
            yield k.wildcard(d), 2, i
            if w[d + 1 : d + 2] != w[d]:
                yield k.without(d), 1, i


def errata(words: DataFrame, range_words: int = RANGE_WORDS) -> DataFrame:
    """From (word, n) rows of three kinds, by ids in code-point order of the words: 0 the words (id, n, word, key), 1 and 2 keys of ``shared_keys`` (id, n, key),
    3 what is found within a range (id, near, best_n, best)."""
    small_batches(words.sparkSession, 10_000)
    schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("word", pa.string()), ("key", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.int64())])

    def batch(k: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(k, f.type) for f in schema], schema=schema)

    def run(batches):
        ws: list[str] = []
        ns: list[int] = []
        for b in batches:
            ws += b.column(0).to_pylist()
            ns += b.column(1).to_pylist()
        if not ws:
            return
        # ranges are in order of their partitions, words in order within these
        first = TaskContext.get().partitionId() << 32
        near: dict[int, list] = {}
        for pair in local_pairs(ws):
            for i, j in (pair, pair[::-1]):
                x = near.get(i)
                if x is None:
                    near[i] = [1, j]
                else:
                    x[0] += 1
                    if (-ns[j], j) < (-ns[x[1]], x[1]):
                        x[1] = j
        best = [x[1] for x in near.values()]
        yield batch(len(near), kind=[3] * len(near), id=[first + i for i in near], near=[x[0] for x in near.values()], best_n=[ns[j] for j in best], best=[first + j for j in best])
        for at in range(0, len(ws), 10_000):
            part = range(at, min(len(ws), at + 10_000))
            yield batch(len(part), kind=[0] * len(part), id=[first + i for i in part], n=[ns[i] for i in part], word=[ws[i] for i in part], key=[Keys(ws[i]).whole() for i in part])
        kinds, at, keys = [], [], []
        for key, kind, i in chain(shared_keys(ws), [(None, 0, 0)]):
            if key is None or len(keys) == 50_000:
                yield batch(len(keys), kind=kinds, id=[first + i for i in at], n=[ns[i] for i in at], key=keys)
                kinds, at, keys = [], [], []
            kinds.append(kind)
            at.append(i)
            keys.append(key)

    # ranges by number: Spark neither joins nor splits these partitions, so each task has all words of its range
    ranges = max(1, -(-words.count() // range_words))
    dealt = words.select("word", "n").repartitionByRange(ranges, "word").sortWithinPartitions("word")
    return dealt.mapInArrow(run, "kind int, id long, n long, word string, key string, near long, best_n long, best long")


def near_words(words: DataFrame, range_words: int = RANGE_WORDS) -> DataFrame:
    """(word, n, n_near, best_n, best): the number of words one edit apart and of these the most frequent (ties: the first in code-point order)."""
    found = keep(errata(words, range_words), "errata")
    local = found.filter("kind = 3").select("id", "near", "best_n", "best")
    whole = found.filter("kind = 0").select("key", F.col("id").alias("other"), F.col("n").alias("other_n"))
    pairs = found.filter("kind = 1").select("key", "id", "n").join(whole.hint("shuffle_hash"), "key")
    one = F.lit(1).cast("long").alias("near")
    skipped = pairs.select("id", one, F.col("other_n").alias("best_n"), F.col("other").alias("best"))
    put_in = pairs.select(F.col("other").alias("id"), one, F.col("n").alias("best_n"), F.col("id").alias("best"))
    # of a wildcard's words, LETTERS at most, the best comes first: it is that of all others, and the second is its own
    group = found.filter("kind = 2").groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "id"))).alias("g")).filter(F.size("g") > 1)
    member = group.select("g", F.posexplode("g").alias("at", "x"))
    best = F.when(F.col("at") == 0, F.get("g", F.lit(1))).otherwise(F.get("g", F.lit(0)))
    replaced = member.select(F.col("x.id").alias("id"), (F.size("g") - 1).cast("long").alias("near"), (-best["m"]).alias("best_n"), best["id"].alias("best"))
    all_ = local.unionByName(skipped).unionByName(put_in).unionByName(replaced)
    top = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    near = all_.groupBy("id").agg(F.sum("near").alias("n_near"), top.alias("top")).select("id", "n_near", (-F.col("top.m")).alias("best_n"), F.col("top.w").alias("best"))
    names = found.filter("kind = 0").select("id", "word", "n")
    rows = names.join(near.hint("shuffle_hash"), "id", "left")
    return rows.join(names.select(F.col("id").alias("best"), F.col("word").alias("best_word")).hint("shuffle_hash"), "best", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "best_n", F.col("best_word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form), both not null: the last of word -> form -> its form ... Each round doubles the steps; forms lead
    to ever larger counts, so a chain has at most as many steps as counts have digits."""
    now = keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = keep(now.join(far.hint("shuffle_hash"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if then.filter("moved").isEmpty():
            return now
        now = then.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, range_words: int = RANGE_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row a word."""
    near = near_words(keep(word_counts(docs, id_col, text_col), "words"), range_words)
    is_form = F.col("best_n") >= F.col("n") * ratio
    rows = keep(near.select("word", F.when(is_form, F.col("best")).alias("form"), "n", "n_near", F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    last = roots(rows.filter("form is not null").select("word", "form"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
