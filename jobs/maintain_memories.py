"""Job: the nightly upkeep of a memory table made from labelled documents.

    python -m jobs.maintain_memories --documents PATH --labels PATH --output DIR --day 2024-05-01 [--config jobs/maintain_memories.json]

Documents become memories: their source is the topic, their text the summary; documents of good quality are important, toxic
ones matter little. The job validates them, merges repeats (one memory for each topic and content, in id order), lets weights decay
by ``rounds`` days, prunes what has become too light, and reports on the health of each topic. Of one day it writes

* ``memories/day=D/importance=I``: what stays (id, topic, summary, summary_hash, weight, access_count, keywords, merged),
* ``rejected/day=D/error=E``: ids of rows that are no memories, and why,
* ``health/day=D``: one row a topic.

Each of these folders is replaced as a whole, so a day can be run again, with the same result. Keywords are the first ``keywords``
distinct words of the text. Repeats count as accesses, which slows decay down. Rows without an id are rejected; a document
labelled more than once has its worst labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import arguments, log, session, settings
from loomstore.functions.text import tokens
from loomstore.operators import lifecycle

DEFAULTS = {"factor": 0.95, "rounds": 7, "prune_below": 0.5, "keywords": 5, "consolidate_from": 5}


def as_memories(documents: DataFrame, labels: DataFrame, keywords: int) -> DataFrame:
    worst = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    both = documents.select(F.col("doc_id").alias("id"), F.col("source").alias("topic"), F.col("text").alias("summary")).join(worst.withColumnRenamed("doc_id", "id"), "id", "left")
    importance = F.when(F.col("toxic") == 1, "low").when(F.col("quality") == 1, "high").otherwise("medium")
    words = F.slice(F.array_distinct(tokens(F.coalesce("summary", F.lit("")))), 1, keywords)
    return both.select("id", "topic", "summary", importance.alias("importance"), words.alias("keywords"), F.lit(None).cast("string").alias("raw_excerpt"))


def maintained(rows: DataFrame, conf: dict) -> DataFrame:
    merged = lifecycle.merge_rows(rows, seq="id").withColumn("weight", F.lit(1.0)).withColumn("access_count", F.col("merged") - 1)
    return lifecycle.prune(lifecycle.decay(merged, conf["factor"], conf["rounds"]), conf["prune_below"])


def run(spark: SparkSession, documents: str, labels: str, output: str, day: str, **changes) -> DataFrame:
    """Writes the day's tables and returns its memories, read back."""
    conf, output = settings(DEFAULTS, **changes), output.rstrip("/")
    rows = as_memories(spark.read.parquet(documents), spark.read.parquet(labels), conf["keywords"])
    checked = lifecycle.validate(rows).withColumn("error", F.when(F.col("id").isNull(), "no id").otherwise(F.col("error")))
    put = lambda df, name, *by: df.write.mode("overwrite").partitionBy(*by).parquet(f"{output}/{name}/day={day}")
    put(checked.filter("error is not null").select("id", "error"), "rejected", "error")
    kept = maintained(checked.filter("error is null").drop("error"), conf)
    put(kept.select("id", "topic", "summary", "summary_hash", "weight", "access_count", "keywords", "merged", "importance"), "memories", "importance")
    memories = spark.read.schema(kept.select("id", "topic", "summary", "summary_hash", "weight", "access_count", "keywords", "merged", "importance").schema).parquet(f"{output}/memories/day={day}")
    report = memories.groupBy("topic").agg(F.count("*").alias("entries"), F.avg("weight").alias("avg_weight"), F.sum("merged").alias("rows"), (F.count("*") > conf["consolidate_from"]).alias("needs_consolidation"))
    put(report, "health")
    # error is a partition column: without a rejected row there is no file to read it from
    bad = checked.filter("error is not null").groupBy("error").count().collect()
    totals = memories.agg(F.count("*"), F.sum("merged")).first()
    log.info("day %s: read %s and %s; wrote %d memories of %d rows to %s; rejected: %s", day, documents, labels, totals[0], totals[1] or 0, output, {r["error"]: r["count"] for r in bad})
    return memories


if __name__ == "__main__":
    args = arguments(__doc__.splitlines()[0], "documents", "labels", "output", "day")
    spark = session("maintain-memories")
    try:
        run(spark, args.documents, args.labels, args.output, args.day, **settings(DEFAULTS, args.config))
    finally:
        spark.stop()
