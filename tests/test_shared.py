"""Joins of wide rows with any number of keys: the same plan and results with few, many and far too many keys for the filter."""

import pytest
from pyspark.sql import functions as F

from loomstore.plans import shared


@pytest.mark.parametrize("bits", [1 << 8, 1 << 22])
def test_keys_of_any_number(spark, bits, monkeypatch):
    monkeypatch.setattr(shared.key_filter, "__defaults__", (bits,))
    df = spark.range(3000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 2000).alias("k"), F.col("id").cast("string").alias("text"))
    for keys in (spark.range(0), spark.range(5, 6), spark.range(0, 4000, 3)):
        keys = shared.keep(keys.select(F.col("id").alias("k"), F.lit("x").alias("note")), "keys")
        got = shared.with_keys(df, keys, "k")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.join(keys, "k").collect()))
        rest = shared.without_keys(df, keys, "k")
        assert sorted(map(str, rest.collect())) == sorted(map(str, df.join(keys, "k", "left_anti").collect()))
        plan = rest._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan


def test_string_keys(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("",)], "k string")
    keys = shared.keep(spark.createDataFrame([("b",), ("zz",), (None,)], "k string"), "keys")
    assert [r.k for r in shared.with_keys(df, keys, "k").collect()] == ["b"]
    assert sorted(str(r.k) for r in shared.without_keys(df, keys, "k").collect()) == ["", "None", "a"]


def test_key_filter_lets_few_others_through(spark):
    test = shared.key_filter(spark.range(10_000))
    some = spark.range(200_000).filter(test(F.col("id")))
    assert 10_000 <= some.count() <= 10_100 and some.filter("id < 10000").count() == 10_000


def test_hot_keys_are_joined_apart(spark):
    df = shared.keep(spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id"), "rows")
    side = shared.keep(df.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m")), "side")
    got = shared.join_counted(df, side, ["k"], "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.join(side, "k").collect()))
    assert shared.join_counted(df.limit(0), side.limit(0), ["k"], "n").count() == 0


@pytest.mark.parametrize("small", [0, 50, 10**6])
def test_components_in_rounds_and_in_one_task(spark, small, monkeypatch):
    import random

    from loomstore.operators import components

    monkeypatch.setattr(components, "SMALL_EDGES", small)
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 180)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(90)] + [(5, 5)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.id: x.component for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {a for a, b in edges if a == b}
    assert got == {x: c for x, c in root.items() if x in got} and set(root) - set(got) <= loops
    named = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "a string, b string")
    assert {x.id: x.component for x in components.connected_components(named).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_scratch_tables_go(spark):
    import glob
    import uuid

    name = f"gone-{uuid.uuid4().hex}"  # other runs leave tables in the same folder

    with shared.scratch(spark):
        kept = shared.keep(spark.range(3), name)
        out = shared.fresh_path(spark, "stays")
        kept.write.parquet(out)
        assert glob.glob(shared.shared_dir(spark).removeprefix("file:") + f"/loomstore/{name}-*")
    assert not glob.glob(shared.shared_dir(spark).removeprefix("file:") + f"/loomstore/{name}-*") and spark.read.parquet(out).count() == 3
