"""Template windows against a naive version without hash tables, prefilter or blocks; odd rows."""

import random

import pytest

from loomstore.llm import decontaminate as d

WORDS = "train leaves station after hours carries people box red blue apples and the of town".split()
NAMES = "Tom Ann Eva Lea Paris Rome".split()


def sentence(r):
    out = []
    for _ in range(r.randint(4, 9)):
        x = r.random()
        out.append(r.choice(NAMES) if x < 0.2 else f"{r.randint(2, 5)} {r.choice(['km', 'apples', 'hours'])}" if x < 0.35 else r.choice(["two", "7", "3.5"]) if x < 0.4 else r.choice(WORDS))
    s = " ".join(out)
    return s[0].upper() + s[1:] + r.choice([". ", "? ", "\n", ", "])


def changed(r, text):
    """Other numbers and names, each value by one other, sometimes not; sometimes in another case or with a word changed."""
    to = {x: r.choice(NAMES) for x in NAMES} | {str(k): str(r.randint(2, 9)) for k in range(2, 6)}
    words = [to.get(w, w) if r.random() < 0.95 else w for w in text.split(" ")]
    if r.random() < 0.3:
        words[r.randrange(len(words))] = r.choice(WORDS)
    out = " ".join(words)
    return r.choice([out, out, out.upper(), out.lower()])


def naive(item, text, width=8, coverage=0.5, least=5):
    it, iv, im = d.readings(item)
    t, v, m = d.readings(text)
    if len(it) < least:
        return None
    n = min(width, len(it))
    kinds = [d.NAME if p in im else k for p, k in enumerate(it)]
    all_readings = lambda t, v, m, i: {tuple(x) for x in d.window_readings(t, v, m, i, n) if sum(w[0] != "\x01" for w in x) >= 3 or n < width and all(w[0] != "\x01" for w in x)}
    mine = [all_readings(it, iv, im, a) for a in range(len(it) - n + 1)]
    shifts = {}
    for i in range(len(t) - n + 1):
        have = all_readings(t, v, m, i)
        for a, x in enumerate(mine):
            if x & have:
                shifts.setdefault(i - a, []).append(a)
    covered, exact = set(), True
    for shift, starts in shifts.items():
        starts.sort()
        places = lambda some: {p for a in some for p in range(a, a + n)}
        best = places([a for a in starts if all(iv[p] == v[p + shift] for p in range(a, a + n))])
        same = True
        for lo in range(len(starts)):
            for hi in range(lo, len(starts)):
                run = places(starts[lo : hi + 1])
                to = {}
                ok = all(to.setdefault((kinds[p], iv[p]), v[p + shift]) == v[p + shift] for p in sorted(run) if kinds[p][0] == "\x01")
                if ok and len(run) > len(best):
                    best, same = run, False
        if best:
            covered |= best
            exact &= same
    return ("exact" if exact else "re-parameterised", len(covered), len(it)) if covered and len(covered) >= coverage * len(it) else None


@pytest.mark.parametrize("seed", range(6))
def test_hits_equal_the_naive_version(seed):
    r = random.Random(seed)
    items = [(k, "".join(sentence(r) for _ in range(r.randint(1, 4)))) for k in range(12)] + [(50, "Red box and the town"), (51, "blue"), (52, "")]
    table = d.ItemTable(items, 8, 5)
    some = 0
    for _ in range(60):
        parts = [sentence(r) for _ in range(r.randint(0, 3))]
        for _ in range(r.randint(0, 2)):
            parts.insert(r.randint(0, len(parts)), changed(r, r.choice(items)[1]) + r.choice([" ", ". ", "\n"]))
        text = "".join(parts)
        want = [(i, *w) for i, x in items if (w := naive(x, text))]
        assert table.hits(text, 8, 0.5) == want, text
        some += len(want)
    assert some > 20


def test_odd_rows(spark):
    q = "Tom has 3 apples and Ann gives 4 red apples to the people of the town after two hours"
    long = "filler words all over the place " * 60_000
    docs = spark.createDataFrame([(1, q, 9, "x"), (1, q, 9, "x"), (None, q, 9, "x"), (2, None, 9, "x"), (3, "", 9, "x"), (4, long + q.upper() + long, 9, "x")], "doc_id long, text string, item_id int, kind string")
    bench = spark.createDataFrame([(7, q, 1), (7, q, 1), (8, None, 1), (9, "", 1), (None, q, 1), (10, "Том дал 3 яблока Анне и 4 груши людям из города после двух часов пути", 1)], "item_id long, text string, doc_id int")
    got = sorted(((r.doc_id or 0), (r.item_id or 0), r.kind) for r in d.find_leaks(docs, bench).collect())
    assert got == sorted((i, k, "exact") for i in (0, 1, 1, 4) for k in (0, 7, 7))
    few = sorted(((r.doc_id or 0), (r.item_id or 0), r.kind) for r in d.find_leaks(docs, bench, block_windows=20).collect())
    assert few == got
    assert d.find_leaks(docs.limit(0), bench).count() == 0 and d.find_leaks(docs, bench.limit(0)).count() == 0
