"""Hidden Markov language model: Baum-Welch on all partitions, exact likelihoods by the scaled forward recursion.

A text is its words and one end. Each word is a symbol: words that make up at least one in ``share`` of the training tokens
(so ``share`` at most) and are seen ``LEAST`` times have a symbol of their own, all others share one of ``BUCKETS`` by their last three bytes. States
emit symbols, and a shared symbol gives its word by the word's own training count, whatever the state; one
event a symbol stands for all words never seen. So the model holds every distinct training word: its tables grow with the corpus, while
what is sent to every task is bounded by ``share`` and ``BUCKETS``.

Baum-Welch: each task runs forward and backward over its texts in step (all texts at one position at a time) and emits expected counts
a symbol; Spark adds these up. The first ``PARTS`` rounds are incremental: each runs on another part of the training texts (by a hash of the id), and the next
model comes from the sum of the counts of all parts so far, so that after them every training text has been learned from once. Then
``rounds`` rounds run on all of them. Texts are turned into symbols once, and those over ``PIECE`` tokens are learned from in pieces.

Scores are log10 probabilities: the forward recursion over the whole text in double precision, however long, and for words with a shared symbol the
words' own probabilities, which come by a join with the counts. Of these words' rows none is hot: a word that is in over
one in ``share`` tokens has a symbol of its own.

Null texts count as empty: only the end is scored. Rows without an id count as held in (the remainder of a null is not 2) and are scored as
any other. Repeated rows are learned from and scored each. Empty tables give an empty result. With no training rows at all every
base is 0 and the model is the uniform start. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, small_batches

STATES = 8
#: Words with a symbol of their own hold at least one in so many training tokens.
SHARE = 500_000
#: And are seen so often at least.
LEAST = 10
BUCKETS = 4096
#: What is taken off a word's count within its bucket, for the words never seen.
DISCOUNT = 0.75
#: Counts that each state's symbols have before any text is read, dealt out as in the whole corpus.
PRIOR = 200.0
PARTS = 8
PIECE = 1 << 16
#: Words that share a symbol and are remembered by a task.
MEMO = 500_000
GROUP_TOKENS, BATCH_TOKENS = 2_000_000, 500_000
#: The end of a text in the table of counts: no word holds a blank.
END = " "


def words(text: str | None) -> list[bytes]:
    """Words between blanks (U+0020, U+0009 to U+000D), A-Z in lower case."""
    return (text or "").encode().lower().split()


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BUCKETS


def _bucket(word: Column) -> Column:
    b = F.encode(word, "utf-8")
    return (F.crc32(F.when(F.octet_length(word) > 3, F.substring(b, -3, 3)).otherwise(b)) % BUCKETS).cast("int")


def _own(share: int, total: int) -> Column:
    return (F.col("c") * share >= total) & (F.col("c") >= LEAST) | (F.col("word") == END)


class Symbols(dict):
    """Word -> symbol: own ones first, then the buckets, which take every other word."""

    def __init__(self, own: list[bytes]):
        super().__init__(zip(own, range(len(own)), strict=True))
        self.own = len(own)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.own + MEMO:
            for _ in range(MEMO):
                self.popitem()  # the last ones first: own words stay
        self[word] = s = self.own + zlib.crc32(word[-3:]) % BUCKETS
        return s


@dataclass
class Model:
    """start (states), step (states x states) and emit (symbols x states): probabilities."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def first_model(counts: np.ndarray, states: int = STATES) -> tuple[Model, np.ndarray]:
    """The model before any round, from the symbols' counts, and the symbols' shares of the corpus."""
    p = (counts + 0.5) / (counts + 0.5).sum()
    e = p[:, None] * (0.5 + np.random.default_rng(12).random((len(p), states)))
    step = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(np.full(states, 1 / states), step, e / e.sum(0)), p


def next_model(expected: np.ndarray, p: np.ndarray) -> Model:
    """From expected counts: rows of symbols, then of transitions from each state, then of starts."""
    n, k = len(p), expected.shape[1]
    emit = expected[:n] + PRIOR * p[:, None]
    step = expected[n : n + k] + 1.0
    start = expected[n + k] + 1.0
    return Model(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


class Packed:
    """Sequences of symbols, longest first, laid out position by position: all first symbols, all second ones, ..."""

    def __init__(self, seqs: list[np.ndarray]):
        lens = np.array([len(s) for s in seqs])
        self.order = np.argsort(-lens, kind="stable")
        lens = lens[self.order]
        flat = np.concatenate([seqs[k] for k in self.order])
        ends = np.cumsum(lens)
        t = np.arange(ends[-1]) - np.repeat(ends - lens, lens)
        self.active = len(lens) - np.searchsorted(lens[::-1], np.arange(lens[0]), side="right")
        self.off = np.concatenate(([0], np.cumsum(self.active)))
        d = np.repeat(np.arange(len(lens)), lens)
        at = self.off[t] + d
        self.sym, self.seq = np.empty_like(flat), np.empty(len(flat), np.int32)
        self.sym[at], self.seq[at] = flat, d
        self.n = len(lens)


def forward(m: Model, x: Packed, alphas: np.ndarray | None = None) -> np.ndarray:
    """The scale of each place of ``x`` (its symbol's probability after those before it). ``alphas`` gets the states' probabilities."""
    scale = np.empty(len(x.sym))
    a = None
    for t, n in enumerate(x.active):
        s = slice(x.off[t], x.off[t + 1])
        a = (m.start if t == 0 else a[:n] @ m.step) * m.emit[x.sym[s]]
        c = a.sum(1)
        a /= c[:, None]
        scale[s] = c
        if alphas is not None:
            alphas[s] = a
    return scale


def log10_likelihoods(m: Model, seqs: list[np.ndarray]) -> np.ndarray:
    x = Packed(seqs)
    out = np.empty(x.n)
    out[x.order] = np.bincount(x.seq, np.log10(forward(m, x)), x.n)
    return out


def expected_counts(m: Model, seqs: list[np.ndarray], into: np.ndarray) -> None:
    """Adds the expected counts of ``seqs`` to ``into``, as ``next_model`` reads them; the last row gets the log-likelihood (base 10)."""
    x, k = Packed(seqs), len(m.start)
    alphas = np.empty((len(x.sym), k))
    scale = forward(m, x, alphas)
    n_sym = len(m.emit)
    pairs = np.zeros((k, k))
    back = np.ones((x.active[-1], k))
    last = len(x.active) - 1
    for t in range(last, -1, -1):
        s, n = slice(x.off[t], x.off[t + 1]), x.active[t]
        if t < last:
            a, nxt = alphas[s], slice(x.off[t + 1], x.off[t + 2])
            w = m.emit[x.sym[nxt]] * back / scale[nxt][:, None]
            pairs += a[: len(w)].T @ w
            back = np.ones((n, k))
            back[: len(w)] = w @ m.step.T
        alphas[s] *= back
    for j in range(k):
        into[:n_sym, j] += np.bincount(x.sym, alphas[:, j], n_sym)
    into[n_sym : n_sym + k] += pairs * m.step
    into[n_sym + k] += alphas[: x.active[0]].sum(0)
    into[n_sym + k + 1, 0] += np.log10(scale).sum()


def batches_of(seqs: list[np.ndarray], tokens: int = BATCH_TOKENS) -> Iterator[list[int]]:
    """Places of ``seqs`` in batches of like lengths and about ``tokens`` symbols."""
    batch, size = [], 0
    for k in sorted(range(len(seqs)), key=lambda k: -len(seqs[k])):
        if batch and size + len(seqs[k]) > tokens:
            yield batch
            batch, size = [], 0
        batch.append(k)
        size += len(seqs[k])
    if batch:
        yield batch


def count_words(texts: DataFrame, flush: int = 200_000) -> DataFrame:
    """(word, c) of a table with the one column text: tasks count first, the end of each text included."""
    small_batches(texts.sparkSession)

    def run(batches):
        def rows():
            got = list(counts.items())
            counts.clear()
            for at in range(0, len(got), 50_000):
                part = got[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()).cast(pa.string()), pa.array([c for _, c in part], pa.int64())], names=["word", "c"])

        counts: Counter[bytes] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                counts.update(words(t))
                counts[END.encode()] += 1
                if len(counts) > flush:
                    yield from rows()
        yield from rows()

    return texts.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Fitted:
    """``counts`` (word, c, bucket) is a kept table; ``own`` the words with symbols of their own and ``own_counts`` theirs."""

    model: Model
    counts: DataFrame
    own: list[bytes]
    own_counts: np.ndarray
    tokens: int
    distinct: int
    share: int
    log10: list[float]


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, share: int = SHARE, rounds: int = 1) -> Fitted:
    spark = train.sparkSession
    texts = train.select(F.col(text_col).alias("text"))
    counts = keep(count_words(texts).withColumn("bucket", _bucket(F.col("word"))), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    mine = _own(share, total)
    # at most share words, as each holds 1 / share of the tokens
    top = counts.filter(mine).select("word", "c").orderBy("word").toArrow()
    own, own_counts = [w.encode() for w in top.column(0).to_pylist()], top.column(1).to_numpy().astype(float)
    rest = np.zeros(BUCKETS)
    for r in counts.filter(~mine).groupBy("bucket").agg(F.sum("c").alias("c")).collect():
        rest[r["bucket"]] = r["c"]
    model, p = first_model(np.concatenate((own_counts, rest)), states)
    log10 = []
    if total:
        symbols = spark.sparkContext.broadcast(own)
        coded = keep(coded_texts(train.select(F.pmod(F.xxhash64(id_col), F.lit(PARTS)).cast("int"), text_col), symbols), "symbols")
        so_far = 0
        for part in range(PARTS):
            expected = one_round(coded.filter(F.col("part") == part), model)
            log10.append(float(expected[-1, 0]))
            so_far = so_far + expected
            model = next_model(so_far, p)
        for _ in range(rounds):
            expected = one_round(coded, model)
            log10.append(float(expected[-1, 0]))
            model = next_model(expected, p)
    return Fitted(model, counts, own, own_counts, int(total), int(distinct), share, log10)


def coded_texts(texts: DataFrame, own) -> DataFrame:
    """(part, symbols) of (part, text): the symbols of a text and its end, as 32-bit numbers."""
    small_batches(texts.sparkSession)

    def run(batches):
        symbols = Symbols(own.value)
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                w = words(t)
                w.append(END.encode())
                out.append(np.fromiter(map(symbols.__getitem__, w), np.int32, len(w)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["part", "symbols"])

    return texts.mapInArrow(run, "part int, symbols binary")


def one_round(coded: DataFrame, model: Model) -> np.ndarray:
    """Expected counts over all rows of ``coded``: a row a symbol, summed over the tasks; the number of rows is bounded by the model."""
    sent, k = coded.sparkSession.sparkContext.broadcast(model), len(model.start)
    rows = len(model.emit) + k + 2
    names = [f"e{j}" for j in range(k)]

    def run(batches):
        m = sent.value
        into = np.zeros((rows, k))
        seqs, size = [], 0

        def add():
            for batch in batches_of(seqs):
                expected_counts(m, [seqs[i] for i in batch], into)
            seqs.clear()

        for b in batches:
            for t in b.column(0).to_pylist():
                s = np.frombuffer(t, np.int32)
                seqs.extend(s[i : i + PIECE] for i in range(0, len(s), PIECE))
                size += len(s)
                if size > GROUP_TOKENS:
                    add()
                    size = 0
        add()
        some = np.flatnonzero(into.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(into[some, j]) for j in range(k)]], names=["row", *names])

    got = coded.select("symbols").mapInArrow(run, "row int, " + ", ".join(f"{n} double" for n in names)).groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = np.zeros((rows, k))
    out[got.column(0).to_numpy()] = np.stack([got.column(n).to_numpy() for n in names], 1)
    sent.unpersist()
    return out


def score(docs: DataFrame, fitted: Fitted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score: one row a row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    norm = fitted.tokens + fitted.distinct + 1
    sent = spark.sparkContext.broadcast((fitted.model, fitted.own, np.log10((fitted.own_counts + 1) / norm)))
    end_known = len(fitted.own) > 0
    end_alone = float(np.log10(1 / norm))
    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType

    def run(batches):
        m, own, base = sent.value
        symbols = Symbols(own)
        n_own = symbols.own
        base_of = np.concatenate((base, np.zeros(BUCKETS)))
        todo: list = []
        size = 0

        def rows():
            texts = {"n_tokens": [], "n_own": [], "base": [], "hmm": []}
            hmm = np.empty(len(todo))
            seqs = [x[2] for x in todo]
            for batch in batches_of(seqs, GROUP_TOKENS):
                hmm[batch] = log10_likelihoods(m, [seqs[i] for i in batch])
            other = ([], [], [], [])
            for row, _, s, w in todo:
                texts["n_tokens"].append(len(s))
                texts["n_own"].append(int((s < n_own).sum()))
                texts["base"].append(float(base_of[s].sum()) + (0.0 if end_known else end_alone))
                for x, c in w.items():
                    for col, v in zip(other, (row, x, c, bucket_of(x)), strict=True):
                        col.append(v)
            n, k = len(todo), len(other[0])
            none = lambda c, t: pa.nulls(c, t)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in todo], pa.int64()), pa.array([x[1] for x in todo], id_kind), pa.array(texts["n_tokens"], pa.int64()), pa.array(texts["n_own"], pa.int64()), pa.array(texts["base"], pa.float64()), pa.array(hmm), none(n, pa.string()), none(n, pa.int64()), none(n, pa.int32())],
                names=columns,
            )
            for at in range(0, k, 100_000):
                e = min(k, at + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(other[0][at:e], pa.int64()), none(e - at, id_kind), none(e - at, pa.int64()), none(e - at, pa.int64()), none(e - at, pa.float64()), none(e - at, pa.float64()), pa.array(other[1][at:e], pa.binary()).cast(pa.string()), pa.array(other[2][at:e], pa.int64()), pa.array(other[3][at:e], pa.int32())],
                    names=columns,
                )
            todo.clear()

        for b in batches:
            for row, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = words(t)
                s = np.empty(len(w) + 1, np.int32)
                s[:-1] = np.fromiter(map(symbols.__getitem__, w), np.int32, len(w))
                s[-1] = symbols[END.encode()]
                todo.append((row, i, s, Counter([w[j] for j in np.flatnonzero(s[:-1] >= n_own)])))
                size += len(s)
                if size > GROUP_TOKENS:
                    yield from rows()
                    size = 0
        if todo:
            yield from rows()

    from pyspark.sql.pandas.types import to_arrow_type

    id_kind = to_arrow_type(kind)
    columns = ["row", "id", "n_tokens", "n_own", "base", "hmm", "word", "tf", "bucket"]
    ddl = f"row long, id {kind.simpleString()}, n_tokens long, n_own long, base double, hmm double, word string, tf long, bucket int"
    made = keep(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, ddl), "scored")
    others = made.filter("word is not null").select("row", "word", "tf", "bucket")
    counts = fitted.counts.select("word", "c", "bucket")
    buckets = counts.filter(~_own(fitted.share, fitted.tokens)).groupBy("bucket").agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    hit = others.join(counts.select("word", "c").hint("shuffle_hash"), "word", "left").join(F.broadcast(buckets), "bucket", "left")
    inside = F.when(F.col("n").isNull(), F.lit(1.0)).when(F.col("c").isNull(), DISCOUNT * F.col("v") / F.col("n")).otherwise((F.col("c") - DISCOUNT) / F.col("n"))
    sums = hit.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("known"),
        F.sum(F.col("tf") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(norm)))).alias("b"),
        F.sum(F.col("tf") * F.log10(inside)).alias("h"),
    )
    out = made.filter("word is null").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col),
        held_out("id").alias("held_out"),
        "n_tokens",
        (F.col("n_own") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(fitted.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero(F.col("b"))).alias("base_score"),
        (F.col("hmm") + zero(F.col("h"))).alias("score"),
    )


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Learns from the rows that aren't held out and scores all."""
    return score(docs, fit(docs.filter(~held_out(id_col)), id_col, text_col, **kw), id_col, text_col)
