"""What placing a batch in order keeps grows with the batch, not with its square; short lists grow where they must."""

import numpy as np
import pytest

from loomstore.operators import ordered
from loomstore.plans.shared import scratch

from test_ordered import ROW, loop


def run(spark, old, new, duplicate, link, **more):
    with scratch(spark):
        placed, links = ordered.place(spark.createDataFrame(old, ROW), spark.createDataFrame(new, "seq long, " + ROW), duplicate, link, 5, **more)
        return {r.seq: (r.slot, r.updated) for r in placed.collect()}, {(r.src, r.dst): r.rn for r in links.collect()}


def test_rows_kept_grow_with_the_batch(spark, monkeypatch):
    """300 rows that are all near each other: 45,000 pairs."""
    g = np.random.default_rng(5)
    new = [(k, f"n{k:03}", f"t{k % 3}", [float(x) for x in np.float32(np.r_[3.0, g.normal(size=15)])]) for k in range(300)]
    sizes, keep = {}, ordered.keep

    def counted(df, name):
        out = keep(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(ordered, "keep", counted)
    got = run(spark, [], new, 0.8, -0.9)
    assert max(sizes.values()) <= 40 * len(new), sizes
    assert got == loop([], new, 0.8, -0.9, 5)


@pytest.mark.parametrize("seed,width", [(1, 1), (2, 2), (3, 5)])
def test_short_lists_grow(spark, seed, width):
    """Lists of few rows: most of them are used up by rows in between, or hold too few living ones for the links."""
    g = np.random.default_rng(seed)
    base = g.normal(size=(4, 4))
    vector = lambda: [float(x) for x in np.float32(base[g.integers(4)] + g.choice([0.0, 0.3]) * g.normal(size=4))]
    topic = lambda: str(g.choice(["a", "b", "c", "d", "e", "f", "g"], p=[0.4, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1]))
    old = [(f"o{k:02}", topic(), vector()) for k in range(12)]
    new = [(k, f"n{k:02}", topic(), vector()) for k in range(50)]
    assert run(spark, old, new, 0.85, 0.6, in_one=0, width=width) == loop(old, new, 0.85, 0.6, 5)
