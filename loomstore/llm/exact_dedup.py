"""Exact deduplication with a log-structured merge index.

``ExactIndex`` keeps digests of normalised texts in sorted runs:

* ``flush``: each task fills memtables with (digest -> best id, count) and, when
  one is full, flushes it as a sorted run. A batch of rows becomes one level-0
  table of such runs, written as Parquet with Bloom filters on the digest
  column, so that a point lookup skips the row groups of most runs.
* ``compact``: merges all runs into one table, range-partitioned and sorted by
  digest; of equal digests the smallest (or largest) identifier is kept and the
  counts are added.
* ``resolve``: joins rows with the compacted table. Every hit (a row that is not
  itself the kept one) is checked byte by byte against the kept row's text; rows
  whose bytes differ are regrouped by digest and full text.

Ids name documents. Rows without an id can't be named and are left out. Rows that repeat an
id are each reported: those with equal texts count as copies of one another and, if the
id is the one that stays, all of them are kept. Null texts count as empty; empty texts are equal
to each other. Empty tables give empty results, and extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_path, join_counted, keep, lower_ascii, small_batches, with_keys, without_keys

RUN_SCHEMA = "digest string, best long, n long, run string"


class ExactIndex:
    """A digest index in the shared folder. ``keep_id``: 'smallest' or 'largest'.

    Compaction keeps the smallest key; for 'largest' the keys are the negated ids.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, keep_id: str = "smallest", memtable_rows: int = 200_000):
        self.spark, self.sign, self.memtable_rows = spark, {"smallest": 1, "largest": -1}[keep_id], memtable_rows
        self.path = path or fresh_path(spark, "exact-index")
        self.runs: list[str] = []
        self.level: str | None = None

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.expected.ndv#digest", "100000").parquet(path)
        return path

    def flush(self, keyed: DataFrame) -> str:
        """Adds rows (id, digest) as sorted runs and returns the path of their table."""
        sign, most = self.sign, self.memtable_rows
        small_batches(self.spark, 20_000)

        def memtables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[str, int] = {}
            n: dict[str, int] = {}

            def run() -> Iterator[pa.RecordBatch]:
                keys, name = sorted(best), uuid.uuid4().hex
                for at in range(0, len(keys), 50_000):
                    part = keys[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([best[k] for k in part], pa.int64()), pa.array([n[k] for k in part], pa.int64()), pa.array([name] * len(part), pa.string())], names=["digest", "best", "n", "run"])
                best.clear()
                n.clear()

            for b in batches:
                for i, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    k = sign * i
                    if d in best:
                        n[d] += 1
                        if k < best[d]:
                            best[d] = k
                    else:
                        best[d], n[d] = k, 1
                if len(best) >= most:
                    yield from run()
            if best:
                yield from run()

        path = self._write(keyed.select("id", "digest").mapInArrow(memtables, RUN_SCHEMA), "run")
        self.runs.append(path)
        return path

    def compact(self) -> DataFrame:
        """Merges the runs and the former level; returns (digest, best, n), sorted by digest in each file."""
        parts = [self.spark.read.schema(RUN_SCHEMA).parquet(p) for p in self.runs]
        if self.level:
            parts.append(self.spark.read.schema(RUN_SCHEMA).parquet(self.level))
        if not parts:
            return self.spark.createDataFrame([], "digest string, best long, n long")
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        merged = rows.repartitionByRange(F.col("digest")).groupBy("digest").agg(F.min("best").alias("best"), F.sum("n").alias("n")).sortWithinPartitions("digest")
        self.level, self.runs = self._write(merged.withColumn("run", F.lit("level")), "level"), []
        return self.table()

    def table(self) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(self.level).select("digest", (F.col("best") * self.sign).alias("keep_id"), "n")

    def lookup(self, digests: list[str]) -> DataFrame:
        """Point lookups: the digests are pushed to Parquet's statistics and Bloom filters."""
        return self.table().filter(F.col("digest").isin(list(digests)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_id: str = "smallest", digest: Column | None = None, salt_rows: int = 200, salt_bytes: int = 8 << 20, memtable_rows: int = 200_000) -> DataFrame:
    """One row per document: id_col, keep_id, group_size, kept, digest.

    ``digest``: a digest column for tests; the default is the SHA-256 of the text in
    UTF-8 after lower-casing A-Z. Groups of over ``salt_rows`` copies or ``salt_bytes`` of text are split
    for the byte check, so that no task gets a whole hot group.
    """
    spark = docs.sparkSession
    norm = lower_ascii(F.col(text_col))
    docs = docs.filter(F.col(id_col).isNotNull())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), norm.alias("norm"))
    # digests once, in the shared folder: the later joins read 40 bytes a row, not the texts
    ids = keep(docs.select(F.col(id_col).cast("long").alias("id"), (F.sha2(norm, 256) if digest is None else digest).alias("digest"), F.octet_length(norm).alias("bytes")), "digests")
    index = ExactIndex(spark, keep_id=keep_id, memtable_rows=memtable_rows)
    index.flush(ids)
    index.compact()
    groups = index.table()
    found = keep(join_counted(ids, groups, ["digest"], "n"), "groups")

    # the byte check: of texts that have copies, hits meet the kept row, which goes to each salt of its group. Texts without
    # copies stay where they are
    many = found.filter("n > 1")
    salts = F.least(F.col("n"), F.greatest(F.ceil(F.col("n") / salt_rows), F.ceil(F.col("n") * F.col("bytes") / salt_bytes))).cast("int")
    roles = many.withColumn("salt", F.when(F.col("id") == F.col("keep_id"), F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), salts).cast("int")))).select("id", "digest", "keep_id", "salt")
    texts = with_keys(rows, keep(roles, "roles"), "id").select("id", "digest", "keep_id", F.explode("salt").alias("salt"), "norm")
    first = Window.partitionBy("digest", "salt").orderBy(F.desc(F.col("id") == F.col("keep_id")))
    hits = texts.withColumn("kept_norm", F.first("norm").over(first)).filter("id != keep_id")
    differ = keep(hits.filter("norm != kept_norm").select("digest").distinct(), "collisions")
    plain = found.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), (F.col("id") == F.col("keep_id")).alias("kept"), "digest")
    if differ.isEmpty():
        return plain
    # digests that different texts share: their rows are grouped by the text as well
    pick = F.min if keep_id == "smallest" else F.max
    texts = with_keys(rows.join(ids.select("id", "digest").distinct(), "id"), differ, "digest") if digest is not None else with_keys(rows.withColumn("digest", F.sha2("norm", 256)), differ, "digest")
    groups = texts.groupBy("digest", "norm").agg(pick("id").alias("keep_id"), F.count("*").alias("group_size"))
    again = texts.join(groups, ["digest", "norm"]).select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id") == F.col("keep_id")).alias("kept"), "digest")
    return without_keys(plain, differ, "digest").unionByName(again)
