"""Kneser-Ney ratios against a plain version, the mixture score, held-out accuracy, odd rows."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loomstore.llm import queries, toxicity

N, D, CD = toxicity.ORDER, toxicity.DISCOUNT, toxicity.CLASS_DISCOUNT


def grams_of(word, n=N):
    s = f"^{word}$"
    return [s[max(0, i - n + 1) : i + 1] for i in range(1, len(s))]


class Plain:
    """The two models by the book: dictionaries, one probability at a time."""

    def __init__(self, rows):
        self.own = [Counter(), Counter()]
        for text, y in rows:
            for w in toxicity.words(text):
                self.own[y].update(grams_of(w))
        self.top = self.own[0] + self.own[1]
        self.level = {N: self.top}
        for k in range(N - 1, 0, -1):
            c = Counter()
            for g in self.level[k + 1]:
                if len(g) == k + 1:
                    c[g[1:]] += 1
                elif g[0] == "^":
                    c[g] += 1
            self.level[k] = c

    def interpolated(self, counts, g, lower):
        after = {x: c for x, c in counts.items() if x[:-1] == g[:-1]}
        n = sum(after.values())
        return (max(after.get(g, 0) - D, 0) + D * len(after) * lower) / n if n else lower

    def low(self, g):
        """By continuation counts of grams of this length."""
        below = self.low(g[1:]) if len(g) > 1 else 1 / toxicity.ALPHABET
        counts = {x: c for x, c in self.level[len(g)].items() if len(x) == len(g)}
        return self.interpolated(counts, g, below) if g in counts else None

    def shared(self, g):
        p = self.low(g[1:])
        return self.interpolated(self.top, g, 1 / toxicity.ALPHABET if p is None else p)

    def ratio(self, g):
        out = []
        for y in (1, 0):
            after = {x: c for x, c in self.own[y].items() if x[:-1] == g[:-1]}
            n = sum(after.values())
            given = sum(min(c, CD) for c in after.values()) / n if n else 1.0
            if g in self.top:
                out.append((max(after.get(g, 0) - CD, 0) / n if n else 0.0) + given * self.shared(g))
            else:
                out.append(given)
        return math.log(out[0] / out[1])




def test_ratios_equal_plain_kneser_ney(spark):
    rng = np.random.default_rng(3)
    parts = ["an", "the", "or", "zi", "ka", "é", "東"]
    text = lambda p, k: " ".join("".join(rng.choice(p, rng.integers(1, 4))) for _ in range(k))
    rows = [(text(parts, 120), 0), (text(parts[:5], 80), 0), (text([*parts, "zork"], 60), 1), ("naïve 1d10t 1d10t " * 5, 1)]
    ratios = toxicity.fit_ratios(spark.createDataFrame(rows, "text string, toxic int"))
    plain = Plain(rows)
    plain.low = _memo(plain.low)
    ws = sorted({w for t, _ in rows for w in toxicity.words(t)})[:60] + ["unseen", "zzz", "theka", "zorkan", "x"]
    got = ratios.words(ws)
    for w, g in zip(ws, got, strict=True):
        assert np.isclose(g, sum(plain.ratio(x) for x in grams_of(w)), atol=1e-4), w


def _memo(f):
    known = {}

    def run(g):
        if g not in known:
            known[g] = f(g)
        return known[g] if known[g] is not None else 1 / toxicity.ALPHABET

    return run


def test_probabilities_sum_to_one(spark):
    """After each context, what the pooled model gives to the characters seen there and its backoff mass make one."""
    counts = toxicity.gram_counts(spark.createDataFrame([("the then them thesis", 0), ("this that", 1)], "text string, toxic int"))
    flat = counts.select("gram", (F.col("toxic") + F.col("ordinary")).alias("c"))
    got = {r.gram: r.p for r in toxicity.discounted(flat, None).collect()}
    by, n = Counter(), Counter()
    for r in flat.collect():
        by[r.gram[:-1]] += 1
        n[r.gram[:-1]] += r.c
    for ctx, t in by.items():
        here = sum(p for g, p in got.items() if g[:-1] == ctx)
        assert np.isclose(here + D * t / n[ctx] * (1 - t / toxicity.ALPHABET), 1.0)


def test_mixture_is_a_length_normalised_comparison():
    r = np.array([1.0] * 98 + [100.0, 50.0])
    m = toxicity.mixture_means(r)
    assert np.allclose(m, [np.mean([math.log((1 - s) + s * x) for x in r]) for s in toxicity.SHARES])
    assert np.allclose(toxicity.mixture_means(np.tile(r, 40)), m) and np.allclose(toxicity.mixture_means(np.ones(7)), 0)
    assert (toxicity.mixture_means(np.zeros(0)) == 0).all()


def test_held_out_accuracy_on_provided_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    r = got.agg(*[F.count_if(F.expr(e)).alias(n) for n, e in (("tp", "predicted = 1 and toxic = 1"), ("fp", "predicted = 1 and toxic = 0"), ("pos", "toxic = 1"))]).first()
    assert r.tp >= 0.88 * r.pos and r.fp <= 0.06 * (r.tp + r.fp), r


def test_odd_rows(spark):
    """Long and repeated texts, repeated ids, clashing columns."""
    long = "harmless words all over " * 50_000
    docs = [(k, "plain words of a calm text") for k in range(300)] + [(k, "plain zorgal zorgum text") for k in range(300, 400)] + [(400, long), (401, long + " zorgal"), (402, None), (None, "zorgal"), (7, "zorgal zorgal")]
    labels = [(k, int(k >= 300), "x", "y") for k in range(400)]
    d = spark.createDataFrame([(i, t, 0.5, 1) for i, t in docs], "doc_id long, text string, score double, toxic int")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, text string, score string")
    got = toxicity.score_toxicity(d, lab, calibration_rows=50).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.predicted)
    assert by[400] == [0] and sorted(by[7]) == [0, 1] and by[350] == [1] and by[402] == [0]
