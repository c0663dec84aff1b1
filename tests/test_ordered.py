"""Placing a batch in order against the plain loop."""

import numpy as np
import pytest

from loomstore.engine import MemoryEngine, hashing_embedder
from loomstore.operators import ordered
from loomstore.plans.shared import scratch

ROW = "id string, topic string, embedding array<float>"


def loop(old, new, duplicate, link, most):
    """One row after the other. old: (id, topic, vector); new: (seq, id, topic, vector)."""
    unit = lambda v: np.asarray(v, np.float32).astype(float) / max(np.linalg.norm(np.asarray(v, np.float32).astype(float)), 1e-10)
    live = {i: (t, unit(v), -1) for i, t, v in old}
    placed, links = {}, {}
    for seq, i, topic, v in sorted(new):
        u = unit(v)
        sims = {s: round(float(u @ w), ordered.DIGITS) for s, (_, w, _) in live.items()}
        best = min(live, key=lambda s: (-sims[s], live[s][0] != topic, -live[s][2], s), default=None)
        if best is not None and sims[best] > duplicate and live[best][0] == topic:
            live[best] = (topic, u, seq)
            placed[seq] = (best, True)
            continue
        near = sorted((s for s in live if sims[s] >= link), key=lambda s: (-sims[s], s))[:most]
        links.update({(i, s): k + 1 for k, s in enumerate(near)})
        live[i] = (topic, u, seq)
        placed[seq] = (i, False)
    return placed, links


def run(spark, old, new, duplicate=0.85, link=0.75, most=5, in_one=ordered.IN_ONE):
    with scratch(spark):
        placed, links = ordered.place(spark.createDataFrame(old, ROW), spark.createDataFrame(new, "seq long, " + ROW), duplicate, link, most, in_one)
        return {r.seq: (r.slot, r.updated) for r in placed.collect()}, {(r.src, r.dst): r.rn for r in links.collect()}


@pytest.mark.parametrize("seed,in_one", [(1, 0), (2, 0), (3, ordered.IN_ONE)])
def test_batches_equal_the_loop(spark, seed, in_one):
    """Few directions, so that rows form chains, ties and copies; vectors of many lengths, and of zeros."""
    g = np.random.default_rng(seed)
    base = g.normal(size=(5, 4))
    vector = lambda: [float(x) for x in np.float32(base[g.integers(5)] * g.choice([1.0, 2.0]) + g.choice([0.0, 0.3]) * g.normal(size=4))]
    topic = lambda: str(g.choice(["a", "b"], p=[0.8, 0.2]))
    old = [(f"o{k:02}", topic(), vector()) for k in range(8)]
    new = [(k, f"n{k:02}", topic(), vector()) for k in range(40)] + [(k, f"n{k}", "a", [0.0] * 4) for k in (40, 41)]
    assert run(spark, old, new, in_one=in_one) == loop(old, new, 0.85, 0.75, 5)


def test_copies_take_each_other_and_alternating_rows_chain(spark):
    a, b, far = [1.0, 0.0], [0.95, 0.3122], [0.0, 1.0]
    copies = [(k, f"c{k}", "t", far) for k in range(20)]
    assert run(spark, [], copies, in_one=0)[0] == {k: ("c0", k > 0) for k in range(20)}
    mixed = [(k, f"m{k}", "t", a if k % 2 else b) for k in range(4)]
    assert run(spark, [("s", "u", a)], mixed, in_one=0) == loop([("s", "u", a)], mixed, 0.85, 0.75, 5)


def test_nulls_and_nothing(spark):
    assert run(spark, [("x", "t", None)], [(0, "n", "t", None), (1, "m", None, [1.0, 0.0])]) == ({1: ("m", False)}, {})
    assert run(spark, [], []) == ({}, {})


def test_engine_remember_updates_near_duplicates(spark, tmp_path):
    e = MemoryEngine(spark, str(tmp_path / "s"), 64, embedder=hashing_embedder(64))
    e.remember([{"topic": "db", "summary": "we chose postgres for the billing service and its reports today", "keywords": ["pg"], "raw_excerpt": "x"}])
    first = e.memories.first()
    e.remember(
        [
            {"topic": "db", "summary": "we chose postgres for the billing service and its reports now", "importance": "high"},
            {"topic": "db", "summary": "we chose postgres for the billing service and its reports here"},
            {"topic": "ops", "summary": "deploys run from the main branch at noon"},
        ]
    )
    rows = {r.topic: r for r in e.memories.collect()}
    assert len(rows) == 2 and e.memories.count() == 2
    r = rows["db"]
    assert (r.id, r.created_at, r.weight) == (first.id, first.created_at, 1.0)
    assert r.summary.endswith("here") and r.importance == "medium" and r.keywords == ["pg"] and r.raw_excerpt == "x"
    assert r.embedding != first.embedding and r.summary_hash != first.summary_hash


def test_engine_remember_links_what_is_near(spark, tmp_path):
    e = MemoryEngine(spark, str(tmp_path / "s"), 64)
    v = lambda x, y: [x, y] + [0.0] * 62
    e.remember([{"topic": "a", "summary": "one", "embedding": v(1.0, 0.0)}])
    e.remember([{"topic": "a", "summary": "two", "embedding": v(0.8, 0.6)}, {"topic": "b", "summary": "three", "embedding": v(0.8, 0.6)}])
    got = {r.summary: r for r in e.memories.collect()}
    assert set(got["one"].related_ids) == {got["two"].id, got["three"].id}
    assert set(got["three"].related_ids) == {got["one"].id, got["two"].id}
