"""The pipeline's near-dedup against all pairs of shingle sets."""

import brute
import numpy as np
import pytest

import corpus_pipeline
from loomstore.llm import near_copies, simhash


def texts():
    rng = np.random.default_rng(7)
    word = lambda k: [f"w{x}" for x in rng.integers(0, 5000, k)]
    passage = word(60)
    out = []
    for n in (9, 30, 120, 400):
        for copies in (1, 3, 30):
            base = word(n)
            for _ in range(copies + 1):
                w = list(base)
                for at in rng.choice(n, rng.integers(0, max(2, n // 22)), replace=False):
                    w[at] = word(1)[0]
                out.append(" ".join(w))
    out += [" ".join(passage + word(k)) for k in (2, 4, 6, 8, 10, 12) * 8]
    out += [" ".join(word(200) + passage) for _ in range(40)]
    return [*out, None, "", " \n", "one", "ONE ", "one two"]


def wanted(rows):
    def grams(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {i: grams(t) for i, t in rows}
    return brute.components(sorted(sets), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))


@pytest.mark.parametrize("block, least, tile, dense", [(3, 8, 4096, 0), (3, 8, 7, 0), (3, 8, 7, 16), (16, 32, 4096, 16), (16, 10**9, 20, 2), (1000, 10**9, 4096, 16)])
def test_all_pairs_at_0_8(spark, monkeypatch, block, least, tile, dense):
    monkeypatch.setattr(near_copies.common_shingles, "__defaults__", (least,))
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(df, block=block, tile=tile, dense=dense).collect()}
    assert {i: got.get(i, i) for i, _ in rows} == wanted(rows)


def test_fringe_of_a_large_group(spark):
    """Copies of one text with ever more edits: many have no link, and all of them share passages."""
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    rows = []
    for k in range(150):
        w = list(base)
        for at in rng.choice(150, rng.integers(1, 14), replace=False):
            w[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((k, " ".join(w)))
    rows += [(3, rows[9][1]), (None, rows[3][1]), (500, None), (501, "")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, key int, n int").repartition(4)
    linked = wanted_ids(rows)
    for tile, dense in ((4096, 16), (40, 2), (4096, 1000), (4096, 0)):
        got = {r.doc_id: r.component_id for r in near_copies.near_copies(df, tile=tile, dense=dense).collect()}
        assert {i: got.get(i, i) for i in linked} == linked


def wanted_ids(rows):
    """As ``wanted``, with the texts of one id as one document."""
    def grams(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(grams(t))
    return brute.components(sorted(sets), lambda a, b: any(5 * len(x & y) >= 4 * len(x | y) for x in sets[a] for y in sets[b]))


def test_stage_drops_all_near_copies(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert kept == set(wanted(rows).values())


def test_fingerprints_find_pairs(spark):
    """With no pair let through by the prefix join (``max_diff`` of -1), links come from fingerprints of 4 or fewer differing bits."""
    rows = list(enumerate(texts()))
    prints = [int(x) for x in simhash.fingerprint_batch([t or "" for _, t in rows], 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(df, max_diff=-1).collect()}
    every = wanted(rows)
    assert all(every[i] == every[c] for i, c in got.items())
    for i, _ in rows:
        same = [j for j, _ in rows if prints[j] == prints[i] and every[j] == every[i]]
        assert len({got.get(j, j) for j in same}) == 1
    assert sum(prints[i] != prints[c] for i, c in got.items()) > 10


def test_no_rows(spark, empty):
    assert near_copies.near_copies(empty).count() == 0
