"""Job: keeps a full-text index of chat transcripts up to date.

    python -m jobs.index_transcripts --input DIR --output DIR --checkpoint DIR [--config jobs/index_transcripts.json]

``input`` holds Parquet files of conversations (conv_id, turn, role, text) and grows by new files. A file stream with a checkpoint takes what
is new, in batches of at most ``files_a_batch`` files, and stops. Each batch is one segment, by the batch's number, of

* ``messages/segment=N``: its messages (id, session_id, turn, role, content, digest), without those that are there already word for word;
* ``index/*/segment=N``: the text index of these (``loomstore.operators.blocks``). A message whose text has changed is taken out of older segments.

A batch that fails is run again by the stream with the same files and number and replaces what it had written. Of a message that comes more than once
in a batch, the greatest (role, text) counts. Missing ids count as empty, missing texts hold no words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import arguments, log, session, settings
from loomstore.operators.blocks import BlockIndex
from loomstore.plans.shared import read_if_there

DEFAULTS = {"files_a_batch": 1000, "columns": ["role", "content"]}
MESSAGE = "id string, session_id string, turn long, role string, content string"


def messages(rows: DataFrame) -> DataFrame:
    """Transcript rows as messages, one an id."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = rows.select(F.concat_ws("-", part("conv_id"), part("turn")).alias("id"), part("conv_id").alias("session_id"), F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("content"))
    last = F.max(F.struct("role", "content", "session_id", "turn")).alias("m")
    return named.groupBy("id").agg(last).select("id", "m.session_id", "m.turn", "m.role", "m.content")


def stored(spark: SparkSession, output: str, before: int | None = None) -> DataFrame:
    """The newest state of each message, of all segments or of those before one."""
    rows = read_if_there(spark, f"{output}/messages", f"{MESSAGE}, digest string, segment long").withColumn("segment", F.col("segment").cast("long"))
    rows = rows if before is None else rows.filter(F.col("segment") < before)
    newest = rows.groupBy("id").agg(F.max("segment").alias("segment"))
    return rows.join(newest, ["id", "segment"], "left_semi")


def take(batch: DataFrame, number: int, output: str, columns: list[str]) -> None:
    spark = batch.sparkSession
    digest = F.sha2(F.concat_ws("\0", "role", "content"), 256)
    # of what is there, ids and digests are read; texts only of messages that change
    old = stored(spark, output, number).select("id", F.col("digest").alias("old"))
    fresh = messages(batch).withColumn("digest", digest).join(old, "id", "left").filter(F.col("old").isNull() | (F.col("digest") != F.col("old")))
    fresh = fresh.select("id", "session_id", "turn", "role", "content", "digest", F.col("old").isNotNull().alias("changed"))
    at = f"{output}/messages/segment={number}"
    fresh.write.mode("overwrite").parquet(at)
    kept = spark.read.schema(fresh.schema).parquet(at)
    new, changed = kept.agg(F.count("*"), F.count_if("changed")).first()
    gone = stored(spark, output, number).join(kept.filter("changed").select("id"), "id", "left_semi") if changed else None
    BlockIndex.add(kept, f"{output}/index", number, gone, cols=tuple(columns))
    log.info("batch %d: %d messages into segment %d, of these %d changed", number, new, number, changed)


def run(spark: SparkSession, input: str, output: str, checkpoint: str, **changes) -> DataFrame:
    """Takes what is new in ``input`` and returns the index: (term, id, tf, dl) of all messages as they stand."""
    conf = settings(DEFAULTS, **changes)
    source, output = input.rstrip("/"), output.rstrip("/")
    schema = spark.read.parquet(source).schema
    # the last letter as a pattern: one file is a source as well as a folder of them
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", conf["files_a_batch"]).parquet(f"{source[:-1]}[{source[-1]}]")
    stream = files.writeStream.foreachBatch(lambda batch, number: take(batch, number, output, conf["columns"])).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        stream.awaitTermination()
    finally:
        stream.stop()
    log.info("read %d new rows from %s; the output is in %s", sum(p["numInputRows"] for p in stream.recentProgress), source, output)
    return BlockIndex(spark, f"{output}/index").postings()


def search(spark: SparkSession, output: str, query: str, k: int = 10) -> DataFrame:
    """The best k messages for a query, by the index: (id, session_id, turn, role, content, score)."""
    hits = BlockIndex(spark, f"{output.rstrip('/')}/index").top(query, k)
    return hits.join(stored(spark, output.rstrip("/")).select("id", "session_id", "turn", "role", "content"), "id").orderBy(F.desc("score"), "id")


if __name__ == "__main__":
    args = arguments(__doc__.splitlines()[0], "input", "output", "checkpoint")
    spark = session("index-transcripts")
    try:
        run(spark, args.input, args.output, args.checkpoint, **settings(DEFAULTS, args.config))
    finally:
        spark.stop()
