"""Adapter views: the engine's tables made from the provided tables, by fixed expressions.

``view(spark, sf_dir, name)`` is the DataFrame; ``SQL[name]`` the same for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstore.functions.text import tokens
from loomstore.plans.shared import spread

EPOCH = 1704067200  # 2024-01-01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents"))
    i = F.col("doc_id")
    topic = F.when(i % 5 == 0, F.concat(F.lit("decisions-"), "source")).when(i % 5 == 1, "errors-resolved").when(i % 5 == 2, "preferences").when(i % 5 == 3, F.concat(F.lit("context-"), "source")).otherwise(F.col("source"))
    importance = F.when(i % 4 == 0, "critical").when(i % 4 == 1, "high").when(i % 4 == 2, "medium").otherwise("low")
    return d.select(
        i.alias("id"),
        topic.alias("topic"),
        F.col("text").alias("summary"),
        importance.alias("importance"),
        (F.lit(1.0) / (1 + i % 20)).alias("weight"),
        (i % 8).alias("access_count"),
        F.slice(tokens(F.col("text")), 1, 3).alias("keywords"),
        F.array(i + 1, i + 7).alias("related_ids"),
        F.timestamp_seconds(F.lit(EPOCH) + i * 3600).alias("created_at"),
        F.timestamp_seconds(F.lit(EPOCH) + i * 3600 + (i % 8) * 86400).alias("last_accessed"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("topic-"), F.col("label").cast("string")).alias("topic"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(table(spark, sf_dir, "conversations"))
    return c.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        F.col("conv_id").alias("session_id"),
        "turn",
        "role",
        F.col("text").alias("content"),
        F.concat(F.lit("p"), (F.col("conv_id") % 7).cast("string")).alias("project"),
        F.timestamp_seconds(F.lit(EPOCH) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("ts"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().select(c.alias("id"), F.concat(F.lit("agent"), (c % 3).cast("string")).alias("agent"), F.concat(F.lit("p"), (c % 7).cast("string")).alias("project"), F.timestamp_seconds(F.lit(EPOCH) + c * 3600).alias("updated_at"))


def hook_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("event"), F.floor(F.col("value") * 10).cast("long").alias("duration_ms"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("exit_code"), F.col("user_id").alias("session_id"))


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("project"), F.col("event_type").alias("file_path"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("tool"), (F.col("event_id") % 5).cast("string"))).alias("tool_name"))


def fact_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("key"), F.get_json_object("props", "$.k").alias("value"), F.col("event_id").alias("seq"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return lab.join(d, "doc_id").select(F.col("doc_id").alias("id"), F.col("source").alias("topic"), F.col("text").alias("context"), F.col("quality").cast("string").alias("predicted"), F.col("toxic").cast("string").alias("corrected"), (F.col("doc_id") % 4).alias("applied_count"))


def memoirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each table that concepts come from but the last, which stays without."""
    rows = [("region", "regions", 1), ("nation", "nations", 2), ("customer", "customers", 3), ("supplier", "suppliers", 4)]
    return spark.createDataFrame(rows, "id string, name string, rank int")


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(name: str, key: str, label: str, prefix: str) -> DataFrame:
        k = F.col(key).cast("string")
        return table(spark, sf_dir, name).select(F.concat(F.lit(prefix), k).alias("id"), F.lit(name).alias("memoir_id"), F.col(label).alias("name"), F.concat(F.lit("kind:"), F.lit(name), F.lit(" of "), F.col(label)).alias("definition"), (F.lit(1.0) * (F.col(key) % 10) / 10).alias("confidence"), F.array(F.struct(F.lit("kind").alias("namespace"), F.lit(name).alias("value")), F.struct(F.lit("tag").alias("namespace"), (F.col(key) % 3).cast("string").alias("value"))).alias("labels"))

    parts = [of("region", "r_regionkey", "r_name", "r"), of("nation", "n_nationkey", "n_name", "n"), of("customer", "c_custkey", "c_name", "c"), of("supplier", "s_suppkey", "s_name", "s"), of("part", "p_partkey", "p_name", "p")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(df: DataFrame, a: str, pa: str, b: str, pb: str, relation: str) -> DataFrame:
        return df.select(F.concat(F.lit(pa), F.col(a).cast("string")).alias("source_id"), F.concat(F.lit(pb), F.col(b).cast("string")).alias("target_id"), F.lit(relation).alias("relation"))

    t = lambda n: table(spark, sf_dir, n)
    out = of(t("nation"), "n_nationkey", "n", "n_regionkey", "r", "part_of").unionByName(of(t("customer"), "c_custkey", "c", "c_nationkey", "n", "part_of")).unionByName(of(t("supplier"), "s_suppkey", "s", "s_nationkey", "n", "part_of"))
    return out.unionByName(of(t("lineitem").select("l_suppkey", "l_partkey").distinct(), "l_suppkey", "s", "l_partkey", "p", "depends_on"))


# What synthetic rows are made of, by turns.
SYNTHETIC_TOPICS = ("architecture", "preferences", "errors-resolved", "context-project", "decisions")
SYNTHETIC_QUERIES = ("database architecture", "authentication flow", "error handling", "user preferences", "deployment config")
SYNTHETIC_IMPORTANCE = ("critical", "high", "medium", "low")


def turn(values: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))


def synthetic(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    """n deterministic memories, as the published latencies were measured on: topics and importances by turns, numbered summaries."""
    i = F.col("id")
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    summary = F.concat(F.lit("Benchmark memory number "), i.cast("string"), F.lit(" about "), turn(SYNTHETIC_TOPICS, i), F.lit(" with some extra words for FTS matching"))
    return rows.select(
        i,
        turn(SYNTHETIC_TOPICS, i).alias("topic"),
        summary.alias("summary"),
        turn(SYNTHETIC_IMPORTANCE, i).alias("importance"),
        (F.lit(1.0) - (i % 20) * 0.05).alias("weight"),
        (i % 7).alias("access_count"),
        F.array(turn(SYNTHETIC_TOPICS, i), F.concat(F.lit("k"), (i % 100).cast("string"))).alias("keywords"),
        F.timestamp_seconds(F.lit(EPOCH) + i * 3600).alias("created_at"),
        F.timestamp_seconds(F.lit(EPOCH) + i * 3600).alias("last_accessed"),
    )


def synthetic_vectors(spark: SparkSession, n: int, dims: int = 384) -> DataFrame:
    """n rows with vectors of integers made from the row's and the place's number."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda j: ((F.col("id") * 31 + j * 17 + F.col("id") * j) % 101 - 50).cast("float"))
    return spark.range(n).select("id", parts.alias("embedding"))


SQL = {
    "memories": f"""select doc_id as id,
      case doc_id%5 when 0 then 'decisions-'||source when 1 then 'errors-resolved' when 2 then 'preferences' when 3 then 'context-'||source else source end as topic,
      text as summary, case doc_id%4 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' else 'low' end as importance,
      cast(1 as double)/(1+doc_id%20) as weight, doc_id%8 as access_count,
      regexp_extract_all(lower(text),'[\\p{{L}}\\p{{N}}]+')[1:3] as keywords, [doc_id+1, doc_id+7] as related_ids,
      {EPOCH}+doc_id*3600 as created_s, {EPOCH}+doc_id*3600+(doc_id%8)*86400 as accessed_s from documents""",
    "vectors": "select vec_id as id, embedding, 'topic-'||label as topic from embeddings",
    "messages": f"select conv_id||'-'||turn as id, conv_id as session_id, turn, role, text as content, 'p'||(conv_id%7) as project, {EPOCH}+conv_id*3600+turn*60 as ts_s from conversations",
    "sessions": f"select distinct conv_id as id, 'agent'||(conv_id%3) as agent, 'p'||(conv_id%7) as project, {EPOCH}+conv_id*3600 as updated_s from conversations",
    "hook_events": "select event_id as id, cast(floor(epoch(ts)) as bigint) as ts_s, event_type as event, cast(floor(value*10) as bigint) as duration_ms, case when event_type='error' then 1 else 0 end as exit_code, user_id as session_id from events",
    "touches": "select user_id as project, event_type as file_path, cast(floor(epoch(ts)) as bigint) as ts_s, event_id as seq, case when event_id%3=0 then 'tool'||(event_id%5) end as tool_name from events",
    "fact_log": "select user_id as entity, event_type as key, json_extract_string(props,'$.k') as value, event_id as seq from events",
    "feedback": "select doc_id as id, source as topic, text as context, cast(quality as varchar) as predicted, cast(toxic as varchar) as corrected, doc_id%4 as applied_count from labels join documents using (doc_id)",
    "memoirs": "select * from (values ('region','regions',1),('nation','nations',2),('customer','customers',3),('supplier','suppliers',4)) t(id,name,rank)",
    "concepts": " union all ".join(
        f"select '{p}'||{k} as id, '{n}' as memoir_id, {lab} as name, 'kind:{n} of '||{lab} as definition, cast(1 as double)*({k}%10)/10 as confidence, [{{'namespace':'kind','value':'{n}'}},{{'namespace':'tag','value':cast({k}%3 as varchar)}}] as labels from {n}"
        for n, k, lab, p in (("region", "r_regionkey", "r_name", "r"), ("nation", "n_nationkey", "n_name", "n"), ("customer", "c_custkey", "c_name", "c"), ("supplier", "s_suppkey", "s_name", "s"), ("part", "p_partkey", "p_name", "p"))
    ),
    "links": "select 'n'||n_nationkey as source_id, 'r'||n_regionkey as target_id, 'part_of' as relation from nation union all select 'c'||c_custkey, 'n'||c_nationkey, 'part_of' from customer union all select 's'||s_suppkey, 'n'||s_nationkey, 'part_of' from supplier union all select * from (select distinct 's'||l_suppkey, 'p'||l_partkey, 'depends_on' from lineitem)",
}


def with_views(*names: str) -> str:
    """The head of an oracle query over adapter views."""
    return "with recursive " + ", ".join(f"{n} as ({SQL[n]})" for n in names) + " "
