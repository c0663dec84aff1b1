"""Rows by key, sorted pages and counts: filters that reach the scan, and top-k plans instead of whole sorts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstore.schemas import MEMOIR_LIMIT


def by_key(df: DataFrame, **keys) -> DataFrame:
    """Rows whose columns have these values."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in keys.items()], F.lit(True)))


def by_keys(df: DataFrame, ids: list, key: str = "id") -> DataFrame:
    """Rows of a list of keys, repeated ones once."""
    return df.filter(F.col(key).isin(list(dict.fromkeys(ids))))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset + 1 to offset + limit in this order, with their number ``rn``."""
    from pyspark.sql.window import Window

    top = df.orderBy(*order).limit(offset + limit)
    return top.withColumn("rn", F.row_number().over(Window.orderBy(*order)).cast("long")).filter(F.col("rn") > offset)


def top_per(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    from pyspark.sql.window import Window

    return df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rn") <= k).drop("rn")


def last_rows(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The last k rows of each group, by an ascending order given as its reverse."""
    return top_per(df, group, order, k)


def list_memoirs(memoirs: DataFrame, limit: int = MEMOIR_LIMIT) -> DataFrame:
    return memoirs.orderBy("name").limit(limit)


def list_concepts(concepts: DataFrame, memoir: str, limit: int = 2 * MEMOIR_LIMIT) -> DataFrame:
    return by_key(concepts, memoir_id=memoir).orderBy("name", "id").limit(limit)


def with_memoir_names(concepts: DataFrame, memoirs: DataFrame) -> DataFrame:
    """Concepts with ``memoir``, the name of their memoir, or '?' for one that isn't there."""
    names = memoirs.select(F.col("id").alias("memoir_id"), F.col("name").alias("_memoir"))
    return concepts.join(names, "memoir_id", "left").withColumn("memoir", F.coalesce("_memoir", F.lit("?"))).drop("_memoir")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table, in one job."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def buckets(df: DataFrame, key: str, size: int = 10) -> DataFrame:
    """(key, n): the values that most rows have."""
    return df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(size)


def bucket_date(text: Column, millis: Column) -> Column:
    """A date of an aggregation: its ISO text if it can be read, else milliseconds after 1970 if positive."""
    return F.coalesce(F.try_to_timestamp(text), F.when(millis > 0, F.timestamp_millis(millis.cast("long"))))
