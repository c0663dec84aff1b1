"""Spelling variants against all pairs, and the hidden Markov model against sums over all paths."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from brute import LOW

from loomstore.llm import hidden_markov as hmm
from loomstore.llm import oracles, spelling


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return len(b) - len(a) == 1 and b[k + 1 :] == a[k:]


def plain_variants(rows):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def result(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def odd_texts():
    rng = random.Random(7)
    rows = []
    # few letters, so that words are near in every way, runs of equal letters and prefixes of one another among them
    pool = sorted({"".join(rng.choice("aab") for _ in range(rng.randint(7, 9))) for _ in range(250)} | {"a" * k for k in range(6, 12)})
    for i in range(60):
        rows.append((i, " ".join(rng.choice(pool) for _ in range(40))))
    rows += [(100 + i, "mention") for i in range(2)] + [(200, "mentions " * 20), (201, "mentionss " * 200), (202, "Ätherisch ätherisch ÄTHERISCH " * 3), (203, "straßenx straßeny " * 2)]
    long = "xy" * 200
    rows += [(300, f"{long} {long} {long}z {long}z {long[:50]}q{long[51:]} {long[:50]}q{long[51:]}"), (301, f"{long[:64]} {long[:65]} {long[:64]} {long[:65]} {long[:66]} {long[:66]}")]
    rows += [(None, "without an identity " * 3), (400, None), (401, ""), (402, "×÷×÷×÷× " * 3)]
    return rows + rows[:5]


@pytest.mark.parametrize("range_words", [5, 40, 100_000])
def test_variants_equal_all_pairs(spark, range_words):
    rows = odd_texts()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    assert result(spelling.variants(df, range_words=range_words)) == plain_variants(rows)


def test_variants_on_real_texts_and_sql(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = result(spelling.variants(docs, range_words=700))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cur = con.execute(oracles.SPELLING)
    names = [c[0] for c in cur.description]
    sql = {r[names.index("word")]: tuple(r[names.index(c)] for c in ("form", "root", "n", "n_near", "form_n")) for r in cur.fetchall()}
    assert got == sql and len(got) > 500


def test_very_long_words(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abc") for _ in range(100_000))
    rows = [(1, f"{long} {long}"), (2, f"{long[:99_000]}{long[99_001:]} " * 3), (3, f"{long[:5]}é{long[6:]} " * 30)]
    got = result(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), range_words=2))
    assert got == plain_variants(rows) and {v[3] for v in got.values()} == {1, 2}


def test_variants_of_nothing(spark, empty, docs):
    assert result(spelling.variants(empty)) == {}
    assert result(spelling.variants(docs)) == plain_variants([(r.doc_id, r.text) for r in docs.collect()])


def test_local_pairs_come_once():
    words = sorted({"".join(p) for k in (3, 4) for p in itertools.product("abc", repeat=k)})
    got = list(spelling.local_pairs(["aaaaaa", *["b" + w for w in words], "cccccc"]))
    assert len(got) == len({frozenset(p) for p in got})


# ---- language model


def path_sum(m, seq):
    total = 0.0
    for path in itertools.product(range(len(m.start)), repeat=len(seq)):
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for a, b, s in zip(path, path[1:], seq[1:], strict=False):
            p *= m.step[a, b] * m.emit[s, b]
        total += p
    return total


def small_model(states=3, symbols=5):
    m, p = hmm.first_model(np.arange(1.0, symbols + 1), states)
    rng = np.random.default_rng(3)
    m.step = rng.dirichlet(np.ones(states), states)
    m.start = rng.dirichlet(np.ones(states))
    return m, p


def test_forward_and_counts_equal_sums_over_paths():
    m, _ = small_model()
    seqs = [np.array(s, np.int32) for s in ([0], [4, 1, 0], [2, 2], [1, 3, 0, 4, 2, 0], [4, 1, 0])]
    want = [path_sum(m, s) for s in seqs]
    assert np.allclose(hmm.log10_likelihoods(m, seqs), np.log10(want))
    got = np.zeros((5 + 3 + 2, 3))
    hmm.expected_counts(m, seqs, got)
    plain = np.zeros_like(got)
    for s, total in zip(seqs, want, strict=True):
        for path in itertools.product(range(3), repeat=len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for a, b, x in zip(path, path[1:], s[1:], strict=False):
                p *= m.step[a, b] * m.emit[x, b]
            for x, k in zip(s, path, strict=True):
                plain[x, k] += p / total
            for a, b in zip(path, path[1:], strict=False):
                plain[5 + a, b] += p / total
            plain[8, path[0]] += p / total
        plain[9, 0] += math.log10(total)
    assert np.allclose(got, plain)


def test_rounds_raise_the_likelihood():
    m, p = small_model(2, 6)
    rng = np.random.default_rng(0)
    seqs = [np.concatenate((rng.integers(0, 3, 30), rng.integers(3, 6, 30))).astype(np.int32) for _ in range(40)]
    seen = []
    for _ in range(15):
        into = np.zeros((6 + 2 + 2, 2))
        hmm.expected_counts(m, seqs, into)
        seen.append(into[-1, 0])
        m = hmm.next_model(into, p)
    assert seen[-1] > seen[0] + 50
    for part in (m.start, m.emit[:, 0], m.step[1]):
        assert abs(part.sum() - 1) < 1e-9


def plain_base(rows):
    tokens = {k: [*hmm.words(t), b" "] for k, (_, t) in enumerate(rows)}
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(((i if i is not None else -1), held[k], len(tokens[k]), sum(w in c for w in tokens[k]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens[k]), 6)) for k, (i, _) in enumerate(rows))


def base(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect())


def test_base_scores_and_odd_rows(spark, docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert base(hmm.score_texts(docs)) == plain_base(rows)
    assert hmm.score_texts(empty).collect() == []
    more = rows + [(None, "an unnamed text"), (1, rows[0][1]), (77, "a\x1cb a\x1cb\x85c  \x0bZZ É é")]
    df = spark.createDataFrame(more, "doc_id long, text string")
    assert base(hmm.score_texts(df)) == plain_base(more)
    only_held = [(i, "a b") for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2]
    assert all(r.base_score == 0 and r.train_tokens == 0 and r.score <= 0 for r in hmm.score_texts(spark.createDataFrame(only_held, "doc_id long, text string")).collect())


def test_model_is_a_distribution_over_words(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    f = hmm.fit(docs)
    others = f.counts.filter(~hmm._own(f.share, f.tokens)).toPandas()
    inside = others.groupby("bucket").c.agg(["sum", "count"])
    emit = f.model.emit.copy()
    assert np.allclose(emit.sum(0), 1) and np.allclose(f.model.step.sum(1), 1)
    # the words of a bucket and its one event for others share the bucket's probability
    total = (others.c - hmm.DISCOUNT).groupby(others.bucket).sum() / inside["sum"] + hmm.DISCOUNT * inside["count"] / inside["sum"]
    assert np.allclose(total, 1)
    assert len(f.own) + len(others) == f.distinct


def test_held_out_texts_gain_and_every_text_is_scored_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = hmm.score_texts(docs).toPandas()
    held = got[got.held_out]
    assert len(held) > 100 and held.score.sum() > 0.9 * held.base_score.sum() and (held.score > held.base_score).mean() > 0.95
    assert base(hmm.score_texts(docs)) == plain_base([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
