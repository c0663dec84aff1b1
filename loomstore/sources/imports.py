"""Conversation imports: whole files in, exchanges (path, pos, role, content) out.

JSON formats are parsed by schemas in the JVM; a quoted plain-text transcript is cut into turns by a running
count of changes. ``detect`` names a file's format by its extension, then by its first 4 KB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FORMATS = ("messages_json", "mapping_json", "session_jsonl", "channel_json", "text")
CHATS = "array<struct<uuid:string,chat_messages:array<struct<sender:string,text:string>>>>"
MAPPING = "array<struct<mapping:map<string,struct<message:struct<author:struct<role:string>,content:struct<parts:array<string>>,create_time:double>>>>>"
CHANNEL = "array<struct<user:string,text:string,ts:string,subtype:string>>"
EXTENSIONS = ("json", "jsonl", "txt", "md")
SKIPPED = r"/(?:\.[^/]+|node_modules|__pycache__)/"


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the importable files under a folder; dot folders and package folders are skipped."""
    files = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    return files.select(path.alias("path"), F.col("value").alias("content")).filter(path.rlike(rf"\.(?:{'|'.join(EXTENSIONS)})$") & ~path.rlike(SKIPPED))


def detect(path: Column, content: Column) -> Column:
    """By extension first; JSON files by what their first 4 KB hold."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    head = F.substring(content, 1, 4096)
    has = lambda w: F.contains(head, F.lit(w))
    return (
        F.when(ext == "jsonl", "session_jsonl")
        .when(ext != "json", "text")
        .when(has("chat_messages") | (has('"uuid"') & has('"sender"')), "messages_json")
        .when(has('"mapping"') & has('"conversation_id"'), "mapping_json")
        .when(has('"messages"') & (has('"subtype"') | has('"client_msg_id"')), "channel_json")
        .otherwise("text")
    )


def _as_array(content: Column) -> Column:
    return F.when(F.ltrim(content).startswith("["), content).otherwise(F.concat(F.lit("["), content, F.lit("]")))


def _ranked(df: DataFrame, *order: str) -> DataFrame:
    w = Window.partitionBy("path").orderBy(*order)
    return df.filter(F.coalesce(F.length("content"), F.lit(0)) > 0).withColumn("pos", F.row_number().over(w) - 1).select("path", "pos", "role", "content")


def messages_json(files: DataFrame) -> DataFrame:
    rows = files.select("path", F.posexplode(F.from_json(_as_array(F.col("content")), CHATS)).alias("c", "chat")).select("path", "c", F.posexplode("chat.chat_messages").alias("i", "m"))
    role = F.when(F.col("m.sender") == "human", "user").when(F.col("m.sender") == "assistant", "assistant").otherwise("system")
    return _ranked(rows.select("path", "c", "i", role.alias("role"), F.col("m.text").alias("content")), "c", "i")


def mapping_json(files: DataFrame) -> DataFrame:
    rows = files.select("path", F.posexplode(F.from_json(_as_array(F.col("content")), MAPPING)).alias("c", "chat")).select("path", "c", F.explode("chat.mapping").alias("node", "v")).filter("v.message is not null")
    role = F.when(F.col("v.message.author.role").isin("user", "assistant"), F.col("v.message.author.role")).otherwise("system")
    text = F.array_join(F.filter("v.message.content.parts", lambda p: p != ""), "\n")
    return _ranked(rows.select("path", "c", "node", F.coalesce("v.message.create_time", F.lit(0.0)).alias("t"), role.alias("role"), text.alias("content")), "c", "t", "node")


def session_jsonl(files: DataFrame) -> DataFrame:
    """One JSON object a line; lines that can't be read are skipped. A content is a string or a list of blocks."""
    rows = files.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("i", "line")).filter(F.trim("line") != "")
    kind = F.get_json_object("line", "$.type")
    role = F.when(kind.isin("user", "human"), "user").when(kind == "assistant", "assistant")
    raw = F.get_json_object("line", "$.message.content")
    blocks = F.from_json(raw, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n")
    return _ranked(rows.select("path", "i", role.alias("role"), F.when(F.ltrim(raw).startswith("["), joined).otherwise(raw).alias("content")).filter("role is not null"), "i")


def channel_json(files: DataFrame) -> DataFrame:
    """An array of messages, or an object with them under ``messages``; messages with a subtype are dropped, all others are the user's."""
    inner = F.coalesce(F.get_json_object("content", "$.messages"), _as_array(F.col("content")))
    rows = files.select("path", F.posexplode(F.from_json(inner, CHANNEL)).alias("i", "m")).filter("coalesce(m.subtype, '') = ''")
    return _ranked(rows.select("path", "i", F.lit("user").alias("role"), F.col("m.text").alias("content")), "i")


def text(files: DataFrame) -> DataFrame:
    """With three quoted lines or more, quoted lines are the user's and the others the assistant's; else one user turn.

    Each quoted line starts a turn of its own; the lines between quotes are one turn.
    """
    lines = files.select("path", F.size(F.filter(F.split("content", "\n"), lambda x: F.ltrim(x).startswith(">"))).alias("quotes"), "content")
    plain = lines.filter("quotes < 3").select("path", F.lit(0).alias("pos"), F.lit("user").alias("role"), F.trim("content").alias("content")).filter("content != ''")
    rows = lines.filter("quotes >= 3").select("path", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    quoted = F.ltrim("line").startswith(">")
    w = Window.partitionBy("path").orderBy("i")
    rows = rows.withColumn("q", quoted).withColumn("turn", F.sum(F.when(F.col("q") | F.coalesce(F.lag("q").over(w), F.lit(True)), 1).otherwise(0)).over(w))
    body = F.when(F.col("q"), F.trim(F.regexp_replace(F.trim("line"), "^>+", ""))).otherwise(F.trim("line"))
    turns = rows.groupBy("path", "turn").agg(F.first("q").alias("q"), F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", body.alias("b")))), lambda x: x["b"]), "\n")).alias("content"))
    out = _ranked(turns.select("path", "turn", F.when(F.col("q"), "user").otherwise("assistant").alias("role"), "content"), "turn")
    return plain.unionByName(out)


READERS = {"messages_json": messages_json, "mapping_json": mapping_json, "session_jsonl": session_jsonl, "channel_json": channel_json, "text": text}


def exchanges(files: DataFrame, fmt: str | None = None) -> DataFrame:
    """Exchanges of files of one format, or of each file's own."""
    if fmt:
        return READERS[fmt](files)
    named = files.withColumn("_fmt", detect(F.col("path"), F.col("content")))
    out = None
    for name, reader in READERS.items():
        part = reader(named.filter(F.col("_fmt") == name).drop("_fmt"))
        out = part if out is None else out.unionByName(part)
    return out


def as_text(exchanged: DataFrame) -> DataFrame:
    """(path, text): a line a turn with its speaker, without system turns."""
    line = F.concat(F.lit("["), F.col("role"), F.lit("]: "), F.col("content"), F.lit("\n"))
    rows = exchanged.filter("role != 'system'").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("rows"))
    return rows.select("path", F.array_join(F.transform("rows", lambda x: x["line"]), "").alias("text"))


def import_memories(files: DataFrame, project: str, fmt: str | None = None) -> DataFrame:
    """(path, topic, summary, importance, keywords, raw_excerpt): facts of imported conversations."""
    from loomstore.functions.text import head_bytes
    from loomstore.operators.extract import entities, extract_facts

    texts = as_text(exchanges(files, fmt))
    facts = extract_facts(texts.select(F.col("path").alias("id"), F.col("text").alias("summary")))
    tags = F.array_union("kinds", entities(F.col("fact")))
    return facts.join(texts.select(F.col("path").alias("id"), head_bytes(F.col("text"), 500).alias("raw_excerpt")), "id").select(F.col("id").alias("path"), F.lit(f"context-{project}").alias("topic"), F.col("fact").alias("summary"), "importance", tags.alias("keywords"), "raw_excerpt")
