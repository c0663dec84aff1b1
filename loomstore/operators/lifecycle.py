"""Writes and upkeep of memories: validation, merging upserts, decay, pruning, consolidation, health."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstore.functions.predicates import importance_of_rank, importance_rank
from loomstore.functions.text import summary_hash
from loomstore.schemas import CONSOLIDATE_AT, MAX_SUMMARY_BYTES, MAX_TOPIC_BYTES


def validate(df: DataFrame) -> DataFrame:
    """Adds the trimmed topic and ``error`` (null if the row is fine)."""
    t, s = F.trim("topic"), F.col("summary")
    error = (
        F.when(t.isNull() | (t == ""), "topic is empty")
        .when(s.isNull() | (F.trim(s) == ""), "summary is empty")
        .when(t.contains("\0") | s.contains("\0"), "NUL character")
        .when(t.rlike(r"[\n\r\t]"), "control character in topic")
        .when(F.octet_length(t) > MAX_TOPIC_BYTES, "topic is too long")
        .when(F.octet_length(s) > MAX_SUMMARY_BYTES, "summary is too long")
    )
    return df.withColumn("topic", t).withColumn("error", error)


def merge_rows(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Insert-or-merge of rows in order of ``seq``: one row for each topic (any case) and content hash.

    The first id and topic stay, importance never falls, keywords are joined in order, the last raw
    excerpt wins. A hot key costs a row a task before the shuffle: keywords are reduced to their first
    places before any list of them is made.
    """
    key = ["_key", "summary_hash"]
    hashed = df.withColumn("summary_hash", summary_hash(F.col("topic"), F.col("summary"))).withColumn("_key", F.lower("topic"))
    rows = hashed.groupBy(*key).agg(
        F.min_by("id", seq).alias("id"),
        F.min_by("topic", seq).alias("topic"),
        F.min_by("summary", seq).alias("summary"),
        importance_of_rank(F.max(importance_rank(F.col("importance")))).alias("importance"),
        F.max_by("raw_excerpt", F.when(F.col("raw_excerpt").isNotNull(), F.col(seq))).alias("raw_excerpt"),
        F.count("*").alias("merged"),
    )
    firsts = hashed.select(*key, F.col(seq).alias("s"), F.posexplode("keywords").alias("p", "kw")).groupBy(*key, "kw").agg(F.min(F.struct("s", "p")).alias("at"))
    words = firsts.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "kw"))), lambda x: x["kw"]).alias("keywords"))
    none = F.array().cast("array<string>")
    return rows.join(words, key, "left").select("id", "topic", "summary", "summary_hash", "importance", F.coalesce("keywords", none).alias("keywords"), "raw_excerpt", "merged")


def decay_factor(factor: float) -> Column:
    """What a weight is multiplied with: critical rows keep theirs, accesses (up to five) slow it down."""
    if not (0 <= factor < 1):
        raise ValueError("the factor must be in [0, 1)")
    speed = F.when(F.col("importance") == "high", 0.5).when(F.col("importance") == "low", 2.0).otherwise(1.0)
    slowed = 1 - (1 - F.lit(float(factor))) * speed / (1 + F.least("access_count", F.lit(5)) * 0.1)
    return F.when(F.col("importance") == "critical", F.lit(1.0)).otherwise(slowed)


def decay(df: DataFrame, factor: float, rounds: int = 1) -> DataFrame:
    w = F.col("weight")
    for _ in range(rounds):
        w = w * decay_factor(factor)
    return df.withColumn("weight", w)


def auto_decay(df: DataFrame, last: Column, now: Column, factor: float = 0.95) -> DataFrame:
    """Decays if a day has passed since ``last`` (null: never)."""
    due = last.isNull() | (F.unix_seconds(now) - F.unix_seconds(last) >= 86400)
    return df.withColumn("weight", F.when(due, F.col("weight") * decay_factor(factor)).otherwise(F.col("weight")))


def prunable(threshold: float) -> Column:
    return (F.col("weight") < threshold) & ~F.col("importance").isin("critical", "high")


def prune(df: DataFrame, threshold: float) -> DataFrame:
    return df.filter(~prunable(threshold))


def touch(df: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Bumps access_count and last_accessed of the rows named in ``ids`` (id)."""
    hit = F.col("_hit").isNotNull()
    flagged = df.join(ids.select("id").distinct().withColumn("_hit", F.lit(1)), "id", "left")
    return flagged.withColumn("access_count", F.col("access_count") + F.when(hit, 1).otherwise(0)).withColumn("last_accessed", F.when(hit, now).otherwise(F.col("last_accessed"))).drop("_hit")


def update_rows(df: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Overwrites columns by those of ``changes`` where these aren't null; unknown keys are ignored."""
    cols = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    return df.join(new, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in df.columns])


def delete_rows(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def upsert(df: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows by key: new ones are added, known ones replaced."""
    return delete_rows(df, rows, key).unionByName(rows)


def health(df: DataFrame, now: Column, many: int = 5) -> DataFrame:
    """One row a topic."""
    stale = (F.col("weight") < 0.5) & (F.unix_seconds(now) - F.unix_seconds("last_accessed") > 14 * 86400)
    return df.groupBy("topic").agg(
        F.count("*").alias("entries"),
        F.avg("weight").alias("avg_weight"),
        F.avg("access_count").alias("avg_access"),
        F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"),
        F.max("last_accessed").alias("last_accessed"),
        F.count_if(stale).alias("stale"),
        (F.count("*") > many).alias("needs_consolidation"),
    )


def store_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("memories"), F.count_distinct("topic").alias("topics"), F.coalesce(F.avg("weight"), F.lit(0.0)).alias("avg_weight"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def topics_rollup(df: DataFrame, separator: str = ":") -> DataFrame:
    """(scope, topic, entries): topics under what stands before the separator, with subtotals (topic null) and the total."""
    scoped = df.withColumn("scope", F.when(F.instr("topic", separator) > 0, F.substring_index("topic", separator, 1)).otherwise(F.col("topic")))
    return scoped.rollup("scope", "topic").agg(F.count("*").alias("entries"))


def consolidate(df: DataFrame, separator: str = " | ") -> DataFrame:
    """One row a topic: summaries by weight, ordered union of the keywords, the best importance, all ids."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "id", "summary", "keywords")))
    return (
        df.groupBy("topic")
        .agg(rows.alias("rows"), F.max(importance_rank(F.col("importance"))).alias("rank"), F.count("*").alias("n"))
        .select(
            "topic",
            F.array_join(F.transform("rows", lambda r: r["summary"]), separator).alias("summary"),
            F.array_distinct(F.flatten(F.transform("rows", lambda r: r["keywords"]))).alias("keywords"),
            importance_of_rank(F.col("rank")).alias("importance"),
            F.transform("rows", lambda r: r["id"]).alias("related_ids"),
            "n",
        )
    )


def consolidate_digests(df: DataFrame, separator: str = " | ") -> DataFrame:
    """(topic, importance, n, summary_sha, ids): of each row of ``consolidate`` the SHA-256 of the summary and the number of ids, for topics of any
    size. Many tasks sort the texts and join them into packed pieces; one task a topic hashes its pieces one after the other, and
    no row holds a whole topic."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    rows = df.select("topic", (-F.col("weight")).alias("w"), "id", "summary", importance_rank(F.col("importance")).cast("int").alias("rank"))
    dealt = rows.repartitionByRange("topic", "w", "id").sortWithinPartitions("topic", "w", "id", "summary")
    kind = rows.schema["id"].dataType.simpleString()
    packed = dealt.mapInArrow(_packed(separator), f"topic string, w double, id {kind}, k long, n long, rank int, texts long, size long, body binary")
    hashed = packed.repartition("topic").sortWithinPartitions("topic", "w", "id", "k").mapInArrow(_hashed(separator), "topic string, rank int, n long, summary_sha string")
    return hashed.select("topic", importance_of_rank(F.col("rank")).alias("importance"), "n", "summary_sha", F.col("n").alias("ids"))


#: Bytes of text in a packed piece: long enough to pack well.
PIECE_BYTES = 1 << 20


def _packed(separator: str):
    """From rows (topic, w, id, summary, rank) in order: pieces of a topic's joined texts, with the first row's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, glue = pa.Codec("zstd", compression_level=6), separator.encode()
        names, k, first = ["topic", "w", "id", "k", "n", "rank", "texts", "size", "body"], 0, None

        def piece() -> pa.RecordBatch:
            raw = glue.join(texts)
            cols = [*first, *(pa.array([x], t) for x, t in ((k, pa.int64()), (n, pa.int64()), (rank, pa.int32()), (len(texts), pa.int64()), (len(raw), pa.int64()), (codec.compress(raw, asbytes=True), pa.binary())))]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for b in batches:
            topics, summaries, ranks = b.column(0).to_pylist(), b.column(3).cast(pa.binary()), b.column(4).to_pylist()
            for at, (topic, text, r) in enumerate(zip(topics, summaries, ranks, strict=True)):
                if first is None or topic != mine or size >= PIECE_BYTES:
                    if first is not None:
                        yield piece()
                        k += 1
                    # copies, as a slice would keep its batch
                    first, mine, texts, size, n, rank = [b.column(c).take(pa.array([at])) for c in range(3)], topic, [], 0, 0, None
                n += 1
                rank = r if rank is None or (r is not None and r > rank) else rank
                if (raw := text.as_py()) is not None:  # as array_join, which leaves nulls out
                    texts.append(raw)
                    size += len(raw)
        if first is not None:
            yield piece()

    return run


def _hashed(separator: str):
    """From the pieces of ``_packed`` in order: one row a topic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, glue = pa.Codec("zstd"), separator.encode()
        kinds = {"topic": pa.string(), "rank": pa.int32(), "n": pa.int64(), "summary_sha": pa.string()}
        sha = None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((mine, rank, n, sha.hexdigest()), kinds.values(), strict=True)], names=list(kinds))
        for b in batches:
            for at in range(b.num_rows):
                topic, _, _, _, more, r, texts, size, body = (c[at] for c in b.columns)
                if sha is None or topic.as_py() != mine:
                    if sha is not None:
                        yield row()
                    mine, rank, n, sha, begun = topic.as_py(), None, 0, hashlib.sha256(), False
                n += more.as_py()
                rank = r.as_py() if rank is None else max(rank, r.as_py() if r.is_valid else rank)
                if texts.as_py():
                    if begun:
                        sha.update(glue)
                    begun = True
                    sha.update(codec.decompress(body.as_buffer(), decompressed_size=size.as_py()) if size.as_py() else b"")
        if sha is not None:
            yield row()

    return run


def auto_consolidate(df: DataFrame, threshold: int = CONSOLIDATE_AT, top: int = 3) -> DataFrame:
    """For topics of at least ``threshold`` rows: the top summaries joined, keywords whatever their case (the first
    spelling stays), importance high and weight 1. The top rows are picked before anything is collected."""
    ordered = Window.partitionBy("topic").orderBy(F.desc("weight"), F.asc("id"))
    best = df.withColumn("rn", F.row_number().over(ordered)).filter(F.col("rn") <= top)
    tops = best.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "summary"))), lambda x: x["summary"]), " | ").alias("summary"))
    counts = df.groupBy("topic").agg(F.count("*").alias("n")).filter(F.col("n") >= threshold)
    ranked = df.select("topic", "weight", "id", F.posexplode("keywords").alias("pos", "kw"))
    firsts = ranked.groupBy("topic", F.lower("kw").alias("low")).agg(F.min(F.struct((-F.col("weight")).alias("w"), "id", "pos", "kw")).alias("m"))
    kws = firsts.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["kw"]).alias("keywords"))
    return counts.join(tops, "topic").join(kws, "topic", "left").select("topic", "n", "summary", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), F.lit("high").alias("importance"), F.lit(1.0).alias("weight"))


def replace_topic(df: DataFrame, topic: str, row: DataFrame) -> DataFrame:
    return df.filter(F.col("topic") != topic).unionByName(row, allowMissingColumns=True)


def backrefs(df: DataFrame, links: DataFrame) -> DataFrame:
    """Adds to each linked row the ids of the rows that link to it. links: (src, dst)."""
    back = links.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("_back"))
    return df.join(back, "id", "left").withColumn("related_ids", F.when(F.col("_back").isNull(), F.col("related_ids")).otherwise(F.array_union("related_ids", "_back"))).drop("_back")
