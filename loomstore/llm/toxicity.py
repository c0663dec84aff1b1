"""Toxicity from class-conditional Kneser-Ney models of words' spelling.

Two models, one of the toxic and one of the ordinary labelled texts, give each character of a
word a probability after up to four before it (a word stands between ^ and $). Both back off to one shared
Kneser-Ney model of the pooled texts at the same order, which itself backs off by continuation counts. Of a class's own
counts ``CLASS_DISCOUNT`` are taken off and given to the shared model, so an expression must be seen more often than that
in a class before it tells the classes apart; rare ones get the same probability in both.

A text is scored by length-normalised log-likelihoods: the mean over its words of log((1 - s) P(word | ordinary) +
s P(word | toxic)) less that of log P(word | ordinary), i.e. ordinary text against ordinary text of which a share s of the words comes
from the toxic model. (With s = 1, the plain comparison, a few toxic words in a long text are lost among the others.) A
logistic function of these means for the shares in ``SHARES``, on a logarithmic scale, gives the score; it is fitted on
labelled texts that the models haven't seen.

All labelled rows that may be learned from are used: four in five for the counts, of the
rest about ``calibration_rows`` at most, by hash, for the coefficients. What reaches the scoring tasks are
exact tables of all distinct grams of the training rows: the ratio of each gram, and that of each
context for what was never seen after it, found by 64-bit hashes. They grow with the grams, 12 bytes each.

Null and empty texts have no words: their features are 0 and their score is what the logistic
function gives for that. Empty documents give an empty result. Without labelled toxic or ordinary rows all scores are 0. Labels
repeated for one document count as often, and so do repeated documents; each row is scored. Very long texts are read whole. Extra
columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, map_arrow, only

ORDER = 5
#: What is taken off a count of the shared model, and off a class's own.
DISCOUNT = 0.75
CLASS_DISCOUNT = 4.0
SHARES = np.array([0.003, 0.01, 0.03, 0.1])
ALPHABET = 200
MEMO_WORDS = 250_000
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def gram_hashes(grams: list[str]) -> np.ndarray:
    """As Spark's xxhash64, unsigned."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(g.encode("utf-8", "surrogatepass"), 42) for g in grams], np.uint64)


def gram_counts(train: DataFrame, flush_words: int = 100_000) -> DataFrame:
    """(gram, toxic, ordinary) from rows (text, toxic): the ``ORDER`` characters up to each of a word's.

    Tasks count words first and cut each distinct one once; partial counts are added up after that.
    """
    import pyarrow as pa

    from .common import small_batches

    small_batches(train.sparkSession)

    def run(batches):
        counts: tuple[dict[str, int], dict[str, int]] = ({}, {})

        def grams():
            n: dict[str, list[int]] = {}
            for y in (0, 1):
                for w, c in counts[y].items():
                    s = f"^{w}$"
                    for i in range(1, len(s)):
                        n.setdefault(s[max(0, i - ORDER + 1) : i + 1], [0, 0])[y] += c
                counts[y].clear()
            keys = list(n)
            for at in range(0, len(keys), 50_000):
                part = keys[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([n[k][1] for k in part], pa.int64()), pa.array([n[k][0] for k in part], pa.int64())], names=["gram", "toxic", "ordinary"])

        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = counts[y]
                for w in words(t or ""):
                    c[w] = c.get(w, 0) + 1
            if len(counts[0]) + len(counts[1]) > flush_words:
                yield from grams()
        yield from grams()

    made = train.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "gram string, toxic long, ordinary long")
    return made.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def shared_backoff(grams: DataFrame) -> DataFrame:
    """(gram, p): Kneser-Ney probabilities of the last character of grams of up to ``ORDER`` - 1 characters, by continuation
    counts (in how many ways a gram is continued to the left), pooled over the classes."""
    left = {ORDER: grams.select("gram").distinct()}
    for k in range(ORDER - 1, 0, -1):
        # grams that start a word (^...) are shorter; they have no continuation to the left and count once
        longer = left[k + 1]
        cont = longer.filter(F.length("gram") == k + 1).groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c"))
        begin = longer.filter((F.length("gram") <= k) & F.startswith("gram", F.lit("^"))).select("gram", F.lit(1).cast("long").alias("c"))
        left[k] = keep(cont.unionByName(begin).groupBy("gram").agg(F.sum("c").alias("c")), f"kn{k}")
    p = None
    for k in range(1, ORDER):
        level = keep(discounted(left[k].filter(F.length("gram") == k), p if k == 1 else level), f"knp{k}")
        p = level if p is None else p.unionByName(level)
    return p


def discounted(rows: DataFrame, lower: DataFrame | None) -> DataFrame:
    """(gram, p) from rows (gram, c): the last character after the others, interpolated with that of the gram without its first character."""
    ctx = F.expr("substring(gram, 1, length(gram) - 1)")
    contexts = rows.groupBy(ctx.alias("ctx")).agg(F.sum("c").alias("n"), F.count("*").alias("t"))
    full = rows.withColumn("ctx", ctx).join(contexts, "ctx")
    if lower is None:
        full = full.withColumn("pl", F.lit(1.0 / ALPHABET))
    else:
        full = full.withColumn("low", F.expr("substring(gram, 2, length(gram) - 1)")).join(lower.select(F.col("gram").alias("low"), F.col("p").alias("pl")), "low", "left")
    return full.select("gram", ((F.col("c") - DISCOUNT + DISCOUNT * F.col("t") * F.coalesce("pl", F.lit(1.0 / ALPHABET))) / F.col("n")).alias("p"))


@dataclass
class Table:
    """Values by ascending hash."""

    keys: np.ndarray
    values: np.ndarray

    def get(self, keys: np.ndarray) -> np.ndarray:
        """NaN for what the table doesn't hold."""
        if not len(self.keys):
            return np.full(len(keys), np.nan)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.values[at], np.nan)


@dataclass
class Ratios:
    """Log-likelihood ratios of grams, and of contexts for grams never seen after these."""

    gram: Table
    context: Table

    def words(self, ws: list[str]) -> np.ndarray:
        """The log-likelihood ratio of each word."""
        grams, sizes = [], []
        for w in ws:
            s = f"^{w}$"
            sizes.append(len(s) - 1)
            grams += [s[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(s))]
        r = self.gram.get(gram_hashes(grams))
        new = np.flatnonzero(np.isnan(r))
        if len(new):
            r[new] = np.nan_to_num(self.context.get(gram_hashes([grams[k][:-1] for k in new])))
        return np.add.reduceat(r, np.concatenate(([0], np.cumsum(sizes)[:-1]))) if ws else np.zeros(0)


def fit_ratios(train: DataFrame) -> Ratios | None:
    """None if a class has no words."""
    grams = keep(gram_counts(train), "grams")
    sums = grams.agg(F.sum("toxic"), F.sum("ordinary")).first()
    if not (sums[0] and sums[1]):
        return None
    pooled = discounted(grams.select("gram", (F.col("toxic") + F.col("ordinary")).alias("c")), shared_backoff(grams))
    ctx = F.expr("substring(gram, 1, length(gram) - 1)")
    given = lambda y: F.sum(F.least(F.col(y), F.lit(CLASS_DISCOUNT)))
    contexts = grams.groupBy(ctx.alias("ctx")).agg(*[f.alias(n) for y, o in (("toxic", "1"), ("ordinary", "0")) for n, f in ((f"n{o}", F.sum(y)), (f"g{o}", given(y)))])
    mass = lambda o: F.when(F.col(f"n{o}") > 0, F.col(f"g{o}") / F.col(f"n{o}")).otherwise(F.lit(1.0))
    own = lambda y, o: F.when(F.col(f"n{o}") > 0, F.greatest(F.col(y) - CLASS_DISCOUNT, F.lit(0.0)) / F.col(f"n{o}")).otherwise(F.lit(0.0))
    full = grams.withColumn("ctx", ctx).join(contexts, "ctx").join(pooled, "gram")
    ratio = F.log((own("toxic", "1") + mass("1") * F.col("p")) / (own("ordinary", "0") + mass("0") * F.col("p")))
    by_gram = full.select(F.xxhash64("gram").alias("h"), ratio.cast("float").alias("r"))
    by_context = contexts.select(F.xxhash64("ctx").alias("h"), F.log(mass("1") / mass("0")).cast("float").alias("r"))
    out = []
    for df in (by_gram, by_context):
        got = df.toArrow()  # 12 bytes a distinct gram
        keys = got.column(0).to_numpy().view(np.uint64)
        by = np.argsort(keys)
        out.append(Table(keys[by], got.column(1).to_numpy()[by]))
    return Ratios(*out)


class _Memo(dict):
    """Word -> likelihood ratio."""

    def __init__(self, ratios: Ratios):
        self.ratios = ratios

    def learn(self, ws: set[str]) -> None:
        new = [w for w in ws if w not in self]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.update(zip(part, np.exp(np.minimum(self.ratios.words(part), 30.0)).tolist(), strict=True))

    def turn(self) -> None:
        if len(self) > MEMO_WORDS:
            self.clear()


def mixture_means(ratios: np.ndarray) -> np.ndarray:
    """For each share: the mean log-likelihood of words under the mixture, less that under the ordinary model."""
    return np.log1p(SHARES[:, None] * (ratios - 1)).mean(axis=1) if len(ratios) else np.zeros(len(SHARES))


def features(docs: DataFrame, ratios: Ratios, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, f1 to f4: the means of ``mixture_means``, on a logarithmic scale."""
    import uuid

    shared, name = docs.sparkSession.sparkContext.broadcast(ratios), uuid.uuid4().hex
    names = [f"f{k}" for k in range(1, len(SHARES) + 1)]

    def fn(b):
        memo = only(("toxicity", name), lambda: _Memo(shared.value))
        f, todo, size = [], [], 0

        def flush():
            memo.turn()
            memo.learn(set().union(*todo))
            f.extend(mixture_means(np.fromiter(map(memo.__getitem__, w), float, len(w))) for w in todo)
            todo.clear()

        for t in b.column(1).to_pylist():
            todo.append(words(t or ""))
            size += len(todo[-1])
            if size > 200_000:
                flush()
                size = 0
        flush()
        m = np.array(f).reshape(-1, len(SHARES))
        return {id_col: b.column(0)} | dict(zip(names, (np.sign(m) * np.log1p(300 * np.abs(m))).T, strict=True))

    return map_arrow(docs.select(id_col, text_col), fn, f"{id_col} long, " + ", ".join(f"{n} double" for n in names))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Coefficients (constant first) on the features as they are; Newton's method on standardised ones."""
    mean, sd = x.mean(0), np.maximum(x.std(0), 1e-9)
    a = np.c_[np.ones(len(x)), (x - mean) / sd]
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + l2 * np.eye(len(w)), a.T @ (p - y) + l2 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.r_[w[0] - (w[1:] * mean / sd).sum(), w[1:] / sd]


def fold(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, calibration_rows: int = 20_000) -> DataFrame:
    """id_col, held_out, score, predicted. Labels are learned from rows whose crc32(id as text) mod 3 isn't 1."""
    c = fold(id_col)
    learn, calibrate = c % 3 != 1, F.floor(c / 3) % 5 == 0
    known = labels.select(id_col, F.col(label_col).cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & learn).withColumn("calibrate", calibrate)
    known = keep(known, "labels")
    # the fold is known from the id: only texts that may be learned from move, and their labels to them
    mine = docs.select(id_col, F.col(text_col).alias("text")).filter(learn & ~calibrate)
    train = mine.join(known.filter("not calibrate").select(id_col, "toxic").hint("shuffle_hash"), id_col).select("text", "toxic")
    ratios = fit_ratios(train)
    if ratios is None:
        scored = docs.select(id_col, F.lit(0.0).alias("score"))
    else:
        feats = keep(features(docs, ratios, id_col, text_col), "features")
        names = [n for n in feats.columns if n != id_col]
        check = known.filter("calibrate")
        share = min(1.0, calibration_rows / max(1, check.count()))
        some = check.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(share * (1 << 30)))
        # bounded by calibration_rows: both the broadcast and what comes to the driver
        seen = feats.join(F.broadcast(some), id_col).orderBy(id_col, *names).select(*names, "toxic").toPandas()
        if seen["toxic"].nunique() == 2:
            w = [float(v) for v in fit_logistic(seen[names].to_numpy(float), seen["toxic"].to_numpy(float))]
        else:
            # no labelled row of a class is left to calibrate: even odds where a toxic word in 50 weighs as much as the rest
            w = [-2.0, *[1.0 / len(names)] * len(names)]
        z = sum((F.col(n) * v for n, v in zip(names, w[1:], strict=True)), F.lit(w[0]))
        scored = feats.select(id_col, (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias("score"))
    return scored.select(id_col, (fold(id_col) % 3 == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
