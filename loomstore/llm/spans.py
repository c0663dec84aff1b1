"""Spans of regular expressions as Column expressions: no Python code on the executors.

``spans(text, pattern)`` is the array of (start, end, value) of the leftmost
non-overlapping matches, in code points, end exclusive. Spark gives the matches
(``regexp_extract_all``) and what lies between them (``split``) but no places; the
running sum of the lengths of both gives these.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


SPANS = "array<struct<start:int,end:int,value:string>>"
#: Code points in a piece of a text.
PIECE = 1024


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans(text: Column, pattern: str, hint: Column | None = None) -> Column:
    """``hint``: a cheap test that is true wherever the pattern matches; other texts skip the pattern.

    Running sums are made in blocks of about the root of the number of matches: an array that grows by one at
    each step is copied each time, so a block costs its square, and n matches together n times their root.
    """
    matches = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern, -1)
    none = F.expr(f"cast(array() as {SPANS})")

    def places(x: Column) -> Column:
        n = F.size(x["m"])
        return once(F.struct(x["m"].alias("m"), x["l"].alias("l"), F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1)).alias("b"), n.alias("n")), blocks)

    def blocks(x: Column) -> Column:
        """x: matches m, the length of each with the gap before it l, the block's size b."""
        numbers = F.sequence(F.lit(0), F.floor((x["n"] - 1) / x["b"]).cast("int"))
        total = lambda k: F.aggregate(F.slice(x["l"], k * x["b"] + 1, x["b"]), F.lit(0), lambda a, v: a + v)
        zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        starts = F.aggregate(numbers, zero, lambda acc, k: F.struct((acc["at"] + total(k)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(numbers, starts, lambda k, at: block(F.slice(x["m"], k * x["b"] + 1, x["b"]), F.slice(x["l"], k * x["b"] + 1, x["b"]), at)))

    def block(m: Column, lengths: Column, at: Column) -> Column:
        def step(acc: Column, v: Column) -> Column:
            end = acc["at"] + v["l"]
            one = F.struct((end - F.length(v["m"])).alias("start"), end.alias("end"), v["m"].alias("value"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        zero = F.struct(at.alias("at"), none.alias("out"))
        return F.aggregate(F.arrays_zip(m.alias("m"), lengths.alias("l")), zero, step, lambda acc: acc["out"])

    both = F.struct(matches.alias("m"), gaps.alias("g"))
    # the last gap has no match behind it
    measured = once(both, lambda x: F.struct(x["m"].alias("m"), F.zip_with(x["m"], F.slice(x["g"], 1, F.size(x["m"])), lambda m, g: F.length(g) + F.length(m)).alias("l")))
    found = once(measured, lambda x: F.when(F.size(x["m"]) == 0, none).otherwise(places(x)))
    return found if hint is None else F.when(hint, found).otherwise(none)


def pieces(text: Column) -> Column:
    """The text in pieces of PIECE code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{PIECE}}})"), F.lit(1))


def around(parts: Column, start: Column, length: Column) -> Column:
    """``length`` code points (PIECE at most) from ``start`` on, from the pieces: a place far into a text costs no more than one at its start."""
    k = F.floor(start / PIECE).cast("int")
    return F.substr(F.concat(F.coalesce(F.get(parts, k), F.lit("")), F.coalesce(F.get(parts, k + 1), F.lit(""))), start - k * PIECE + 1, length)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    d = F.split(F.reverse(number), "")

    def add(i: Column) -> Column:
        v = F.get(d, i).cast("int")
        w = F.when(i % 2 == 1, v * 2).otherwise(v)
        return F.when(w > 9, w - 9).otherwise(w)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.length(number) - 1), add), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """True if an IBAN (no blanks, upper case) has remainder 1: its digits are fed one by one."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def feed(r: Column, ch: Column) -> Column:
        code = F.ascii(ch)
        return F.when(code >= 65, (r * 100 + (code - 55)) % 97).otherwise((r * 10 + (code - 48)) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), feed) == 1


def render(kind: str, arr: Column) -> Column:
    """'kind:start:end' of each span."""
    return F.transform(arr, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))
