"""A vector index: cells learned by k-means, 8-bit codes of what is left within a cell, probes, and exact re-ranking.

Centres are fitted on at most ``FIT_ROWS`` rows, drawn by a hash of the id (spherical k-means: tasks add up their rows by cell, the
driver sees one sum a cell); all rows are indexed. The index is two plain Parquet tables under one path:

* ``rows/cell=C``: id, code (a byte for each number of the vector's rest after the centre), scale, and the vector itself at length 1;
* ``centres``: cell, centre, rows, and radius: the cosine between the centre and its farthest row.

A search compares each query with the centres and reads the codes of its ``probes`` best cells (folders, so the scan is pruned), takes the best
``RERANK`` * k by these and ranks them by the vectors themselves. The exact mode then also reads the cells that may hold a
better row: no row of a cell is nearer to a query than the centre's angle less the radius.

Rows without a vector, or with one of length 0, are not in the index. Ties go to the lesser id.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstore.operators.search import _matrix
from loomstore.plans.shared import keep

FIT_ROWS, ROUNDS = 50_000, 10
#: Rows in a cell that are aimed at, cells at most, and rows in a file.
CELL_ROWS, MOST_CELLS, FILE_ROWS = 1000, 8192, 500_000
RERANK = 8
#: Queries that are shared with all tasks at once.
MAX_QUERIES = 10_000


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m**2).sum(axis=1, keepdims=True)), 1e-30)


def _arrays(m: np.ndarray, kind=pa.float64()) -> pa.ListArray:
    """Rows of a matrix as a list column."""
    return pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.array(m.ravel(), kind))


def fit_centres(rows: DataFrame, cells: int, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of unit length from rows (id, embedding)."""
    n = rows.count()
    share = min(1.0, fit_rows / max(1, n))
    some = keep(rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))), "fit")
    # the first centres: rows in the order of another hash, at most ``cells`` of them
    start = some.orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(cells).select("embedding").toArrow()
    centres = _unit(_matrix(start.column(0).combine_chunks()))

    def run(batches):
        total, count = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for b in batches:
            if b.num_rows:
                x = _unit(_matrix(b.column(0)))
                at = (x @ centres.T).argmax(axis=1)
                np.add.at(total, at, x)
                count += np.bincount(at, minlength=len(centres))
        got = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(got.astype(np.int32)), _arrays(total[got])], names=["cell", "total"])

    for _ in range(rounds):
        sums = some.select("embedding").mapInArrow(run, "cell int, total array<double>").toArrow()
        total = np.zeros_like(centres)
        np.add.at(total, sums.column(0).to_numpy(), _matrix(sums.column(1).combine_chunks()))
        moved = np.where((total**2).sum(axis=1, keepdims=True) > 0, _unit(total), centres)
        if np.abs(moved - centres).max() < 1e-6:
            break
        centres = moved
    return centres


class CellIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        c = spark.read.parquet(f"{self.path}/centres").orderBy("cell").toArrow()  # MOST_CELLS at most
        self.cells = c.column("cell").to_numpy()
        self.centres = _matrix(c.column("centre").combine_chunks())
        self.radius = c.column("radius").to_numpy()

    @staticmethod
    def build(df: DataFrame, path: str, cells: int | None = None) -> "CellIndex | None":
        """From rows (id, embedding); None if no row has a vector."""
        spark = df.sparkSession
        rows = df.filter(F.exists("embedding", lambda x: x != 0)).select("id", "embedding")
        n = rows.count()
        if not n:
            return None
        centres = fit_centres(rows, cells or int(min(MOST_CELLS, max(1, n // CELL_ROWS, min(n, 4 * int(n**0.5)) if n < 1_000_000 else 0))))
        kind = rows.schema["id"].dataType.simpleString()

        def code(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                x = _unit(_matrix(b.column(1)))
                sims = x @ centres.T
                at = sims.argmax(axis=1)
                rest = x - centres[at]
                scale = np.maximum(np.abs(rest).max(axis=1), 1e-12) / 127
                codes = np.rint(rest / scale[:, None]).astype(np.int8)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(sims[np.arange(len(x)), at]), _arrays(x)], names=["id", "cell", "code", "scale", "near", "vector"])

        made = keep(rows.mapInArrow(code, f"id {kind}, cell int, code binary, scale double, near double, vector array<double>"), "coded")
        sizes = keep(made.groupBy("cell").agg(F.count("*").alias("rows"), F.min("near").alias("radius")), "cells")
        # a cell of very many rows is written by several tasks
        salt = F.pmod(F.xxhash64("id"), F.floor(F.col("rows") / FILE_ROWS) + 1)
        dealt = made.drop("near").join(F.broadcast(sizes.select("cell", "rows")), "cell").withColumn("_salt", salt).repartition("cell", "_salt")
        dealt.drop("rows", "_salt").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        table = spark.createDataFrame(pa.table({"cell": pa.array(np.arange(len(centres), dtype=np.int32)), "centre": _arrays(centres)}))
        table.join(sizes, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        return CellIndex(spark, path)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = False) -> DataFrame:
        """(query_id, id, sim, rn): the best k rows for each query (id, embedding), a stated set that is counted and taken in blocks."""
        q = queries.select(F.col("id").alias("query_id"), "embedding").filter(F.exists("embedding", lambda x: x != 0))
        blocks = max(1, -(-q.count() // MAX_QUERIES))
        out = None
        for b in range(blocks):
            some = (q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()
            if some.num_rows:
                part = self._block(some, k, probes, exact)
                out = part if out is None else out.unionByName(part)
        kind = queries.schema["id"].dataType.simpleString()
        return out if out is not None else self.spark.createDataFrame([], f"query_id {kind}, id {self.rows().schema['id'].dataType.simpleString()}, sim double, rn int")

    def _block(self, q: pa.Table, k: int, probes: int, exact: bool) -> DataFrame:
        ids, vectors = q.column(0).combine_chunks(), _unit(_matrix(q.column(1).combine_chunks()))
        sims = vectors @ self.centres.T
        order = np.argsort(-sims, axis=1, kind="stable")[:, :probes]
        asked = np.zeros(sims.shape, bool)
        np.put_along_axis(asked, order, True, axis=1)
        first = self._ranked(self._scan(ids, vectors, asked, sims, RERANK * k, codes=True), RERANK * k)
        # the vectors themselves of what the codes found, in the same cells
        sure = first.select("query_id", "cell", "id").join(self._cells(asked).select("cell", "id", "vector"), ["cell", "id"])
        found = self._ranked(self._exact(sure, ids, vectors), k)
        if not exact:
            return found.select("query_id", "id", "sim", "rn")
        # k rows reach the kth similarity; cells whose bound doesn't are left out
        least = dict(map(tuple, found.filter(F.col("rn") == k).select("query_id", "sim").collect()))
        bound = np.cos(np.maximum(0, np.arccos(np.clip(sims, -1, 1)) - np.arccos(np.clip(self.radius, -1, 1))[None, :]))
        floor = np.array([least.get(i, -2.0) for i in ids.to_pylist()])
        return self._ranked(self._scan(ids, vectors, bound >= floor[:, None] - 1e-9, sims, k, codes=False), k).select("query_id", "id", "sim", "rn")

    def _cells(self, asked: np.ndarray) -> DataFrame:
        """Rows of the cells that a query asks for: other folders aren't read."""
        return self.rows().filter(F.col("cell").isin([int(c) for c in self.cells[asked.any(axis=0)]]))

    def _scan(self, ids, vectors, asked, sims, k: int, codes: bool) -> DataFrame:
        """(query_id, cell, id, sim): of each batch of rows the best k of a cell and query."""
        place = {int(c): i for i, c in enumerate(self.cells)}
        kinds = self.rows().schema
        query_kind = "string" if pa.types.is_string(ids.type) else "long" if pa.types.is_int64(ids.type) else "int"

        def run(batches):
            for b in batches:
                cells = b.column(0).to_numpy()
                for c in np.unique(cells):
                    j = place[int(c)]
                    who = np.flatnonzero(asked[:, j])
                    if not len(who):
                        continue
                    at = np.flatnonzero(cells == c)
                    part = b.take(pa.array(at))
                    if codes:
                        x = np.frombuffer(b"".join(part.column(2).to_pylist()), np.int8).reshape(len(at), -1) * part.column(3).to_numpy()[:, None]
                        s = vectors[who] @ x.T + sims[who, j][:, None]
                    else:
                        s = vectors[who] @ _matrix(part.column(2)).T
                    if k < len(at):
                        least = np.partition(s, len(at) - k, axis=1)[:, len(at) - k]
                        r, o = np.nonzero(s >= least[:, None] - 1e-12)
                    else:
                        r, o = (v.ravel() for v in np.indices(s.shape))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(who[r])), pa.array(np.full(len(r), c, np.int32)), part.column(1).take(pa.array(o)), pa.array(s[r, o])], names=["query_id", "cell", "id", "sim"])

        return self._cells(asked).select("cell", "id", *(["code", "scale"] if codes else ["vector"])).mapInArrow(run, f"query_id {query_kind}, cell int, id {kinds['id'].dataType.simpleString()}, sim double")

    def _exact(self, rows: DataFrame, ids, vectors) -> DataFrame:
        place = {v: i for i, v in enumerate(ids.to_pylist())}
        kind, query_kind = rows.schema["id"].dataType.simpleString(), rows.schema["query_id"].dataType.simpleString()

        def run(batches):
            for b in batches:
                if b.num_rows:
                    at = np.array([place[v] for v in b.column(0).to_pylist()])
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array((vectors[at] * _matrix(b.column(3))).sum(axis=1))], names=["query_id", "cell", "id", "sim"])

        return rows.select("query_id", "cell", "id", "vector").mapInArrow(run, f"query_id {query_kind}, cell int, id {kind}, sim double")

    @staticmethod
    def _ranked(rows: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc(F.round("sim", 9)), "id")
        return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
