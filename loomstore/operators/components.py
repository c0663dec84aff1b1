"""Connected components by hooking and pointer jumping.

Each round every vertex hooks to its smallest neighbour if that is smaller than itself,
pointers are jumped until they reach roots, and the edges are rewritten to roots. At least
half of the vertices that still have edges lose their root, so rounds are logarithmic.
Vertices and edges stay in DataFrames; the driver sees one count a step. Once no more than ``SMALL_EDGES`` edges are left, one task
joins them, which saves the last rounds their tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstore.plans.shared import keep


#: Edges that one task may join: a few megabytes.
SMALL_EDGES = 50_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, smallest id reachable) of all vertices of the edges that come."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kind = None
    for b in batches:
        kind = b.column(0).type
        for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(a), find(c)
            if x != y:
                root[max(x, y)] = min(x, y)
    if root:
        ids = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([find(x) for x in ids], kind)], names=["id", "root"])


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(id, component) for every vertex with an edge to another; component = smallest id reachable."""
    e = keep(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a != b").distinct(), "edges")
    labels = keep(e.select(F.col("a").alias("id")).union(e.select(F.col("b").alias("id"))).distinct().withColumn("component", F.col("id")), "labels")
    while left := e.limit(SMALL_EDGES + 1).count():
        if left <= SMALL_EDGES:
            kind = e.schema["a"].dataType.simpleString()
            p = keep(e.coalesce(1).mapInArrow(_joined, f"id {kind}, root {kind}"), "joined")
            return labels.join(p.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("root", "component").alias("component"))
        both = e.union(e.select("b", "a"))
        p = keep(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root")), "hook")
        while True:
            up = p.select(F.col("id").alias("root"), F.col("root").alias("top"))
            q = keep(p.join(up, "root").select("id", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "jump")
            moved = not q.filter("moved").isEmpty()
            p = q.drop("moved")
            if not moved:
                break
        to = p.withColumnRenamed("id", "x")
        e = keep(
            e.join(to.withColumnRenamed("root", "ra"), F.col("a") == F.col("x")).drop("x").join(to.withColumnRenamed("root", "rb"), F.col("b") == F.col("x")).filter("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "edges",
        )
        labels = keep(labels.join(p.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("root", "component").alias("component")), "labels")
    return labels
