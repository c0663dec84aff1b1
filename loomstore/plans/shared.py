"""Tables in the folder that the driver and all executors share: how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset (tests, local mode) a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    context = spark.sparkContext
    if not found:
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="loomstore-"))
        found = context.getCheckpointDir()
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomstore/{name}-{uuid.uuid4().hex}"


#: Of each open ``scratch`` block, what was kept in it.
_SCRATCH: list[list[str]] = []


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are kept inside the block are deleted at its end: what is made from them must be written by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            remove(spark, path)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again."""
    path = fresh_path(df.sparkSession, name)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_if_there(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The Parquet table at ``path``; where there is none, no rows of ``schema``, or None."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema) if schema else None


#: Bits of a key filter (half a megabyte): fixed, whatever the number of keys.
FILTER_BITS = 1 << 22


def key_filter(keys: DataFrame, bits: int = FILTER_BITS) -> Callable[[Column], Column]:
    """A test that is true for every value in the one column of ``keys`` and false for most others: a Bloom filter of fixed size,
    made and asked by built-in functions. With very many keys it lets more through, and never costs more than that."""

    def places(c: Column) -> list[Column]:
        h = F.xxhash64(c)
        return [h.bitwiseAND(bits - 1), F.shiftrightunsigned(h, 32).bitwiseAND(bits - 1)]

    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(63).cast("int"))
    word = lambda p: F.shiftright(p, 6)
    spark = keys.sparkSession
    at = keys.select(F.explode(F.array(*places(F.col(keys.columns[0])))).alias("p"))
    some = at.groupBy(word(F.col("p")).alias("id")).agg(F.bit_or(bit(F.col("p"))).alias("w"))
    row = spark.range(bits >> 6).join(some, "id", "left").agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0).cast("long")).alias("w")))).alias("all"))
    made = keep(row.select(F.transform("all", lambda x: x["w"]).alias("words")), "key-filter")

    def test(c: Column) -> Column:
        parts = [F.get(made.scalar(), word(p).cast("int")).bitwiseAND(bit(p)) != 0 for p in places(c)]
        return parts[0] & parts[1]

    return test


def with_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` joined with those of ``keys`` (a kept table) on ``key``. Only rows that pass the filter of the keys are
    shuffled, so wide rows stay where they are; the plan is the same at every size."""
    return df.filter(key_filter(keys.select(key))(F.col(key))).join(keys.hint("shuffle_hash"), key)


def without_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` isn't in ``keys`` (a kept table). Rows that the filter of the keys rejects stay where they are."""
    test = key_filter(keys.select(key))
    maybe = df.filter(test(F.col(key))).join(keys.select(key).hint("shuffle_hash"), key, "left_anti")
    return df.filter(~test(F.col(key))).unionByName(maybe)


#: Keys that hold more than one in so many rows can't be more than so many.
HOT_KEYS = 1000


def join_counted(df: DataFrame, side: DataFrame, key: list[str], count: str) -> DataFrame:
    """``df`` joined with ``side`` on ``key``; both are kept tables, and ``side`` has one row a key, with the number of rows that ``df``
    has of it. The few keys with over 1/HOT_KEYS of all rows are broadcast, so that no task gets all rows of one; the others are shuffled."""
    total = side.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * HOT_KEYS > total
    hot = F.broadcast(side.filter(is_hot))
    rest = df.join(F.broadcast(side.filter(is_hot).select(*key)), key, "left_anti")
    return df.join(hot, key).unionByName(rest.join(side.filter(~is_hot).hint("shuffle_hash"), key))


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than cores is dealt out to all cores; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
