"""The vector index against all pairs: recall, pruned cells, the exact mode, ties and odd rows."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from loomstore.operators import cells, search


def clustered(spark, n=6000, dims=32, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, dims))
    x = centres[rng.integers(0, 60, n)] + 0.5 * rng.normal(size=(n, dims))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "id long, embedding array<float>").repartition(4).cache()


def pairs(df):
    return {(r.query_id, r.id) for r in df.collect()}


def test_recall_pruning_and_the_exact_mode(spark, tmp_path):
    df = clustered(spark)
    q = df.filter("id % 100 = 0")
    ix = cells.CellIndex.build(df, str(tmp_path))
    want = pairs(search.knn_batch(q, df, 10))
    got = ix.search(q, 10, probes=24)
    assert len(pairs(got) & want) >= 0.95 * len(want)
    assert pairs(ix.search(q, 10, probes=4, exact=True)) == want
    assert ix.rows().count() == df.count() and len(ix.cells) > 100
    one = ix.search(q.filter("id = 100"), 10, probes=3)
    assert one.count() == 10
    some = ix._cells(np.isin(ix.cells, ix.cells[:3])[None, :])
    scan = next(x for x in some._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x)
    assert re.search(r"PartitionFilters: \[.*cell#\d+L? (IN|INSET)", scan), scan
    assert {r.cell for r in some.select("cell").distinct().collect()} == {int(c) for c in ix.cells[:3]}


def test_ties_and_odd_rows(spark, tmp_path):
    same = [(i, [1.0, 2.0, 0.0]) for i in range(300)]
    rows = [*same, (900, None), (901, [0.0, 0.0, 0.0]), (902, [-1.0, 0.0, 0.5]), (903, [2.0, 4.0, 0.0])]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    ix = cells.CellIndex.build(df, str(tmp_path))
    q = spark.createDataFrame([("a", [1.0, 2.0, 0.0]), ("b", None), ("c", [0.0, 0.0, 0.0])], "id string, embedding array<float>")
    for exact in (False, True):
        got = sorted((r.query_id, r.rn, r.id) for r in ix.search(q, 4, exact=exact).collect())
        assert got == [("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("a", 4, 3)]
    assert ix.search(q.filter("id = 'b'"), 4).collect() == []
    assert cells.CellIndex.build(df.filter("id = 900"), str(tmp_path / "none")) is None
    assert {r.id for r in ix.search(q.filter("id = 'a'").select(F.lit("z").alias("id"), "embedding"), 400, probes=999).collect()} == set(range(300)) | {902, 903}


def test_recall_of_the_registered_query(spark):
    from loomstore.queries import QUERIES

    d = "/root/testdata/sf0.1"
    want = pairs(QUERIES["knn_batch"](spark, d))
    assert len(pairs(QUERIES["knn_cells_probed"](spark, d)) & want) >= 0.9 * len(want)
