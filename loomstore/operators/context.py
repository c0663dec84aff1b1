"""Context for prompts: what is known on each of many queries, without near repetitions, within a byte budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstore.functions.predicates import is_preference_topic, project_matches
from loomstore.functions.text import cap_chars, jaccard, words
from loomstore.operators.blocks import BlockIndex
from loomstore.schemas import MAX_LIMIT

# The texts around the entries, the threshold of word sets that say the same, and the caps.
HEAD = "Here is context from previous analysis of this project. Use it to answer efficiently without re-reading files.\n\n"
MORE = "- (recall context truncated — increase per-memory or aggregate caps)\n"
TAIL = "\n---\n\n"
SAME, ENTRY_CHARS, TOTAL_BYTES = 0.6, 400, 4000

ITEM = "struct<id:{id},summary:string,w:array<string>>"


def suppressed(items: Column, kind: str, threshold: float = SAME) -> Column:
    """Of ranked items (id, summary) those whose word set isn't too like that of one kept before: greedy, in order."""
    with_words = F.transform(items, lambda x: F.struct(x["id"].alias("id"), x["summary"].alias("summary"), words(x["summary"]).alias("w")))
    none = F.expr(f"cast(array() as array<{ITEM.format(id=kind)}>)")
    return F.aggregate(with_words, none, lambda kept, x: F.when(F.exists(kept, lambda y: jaccard(y["w"], x["w"]) > threshold), kept).otherwise(F.concat(kept, F.array(x))))


def rendered(kept: Column, chars: int = ENTRY_CHARS, total: int = TOTAL_BYTES) -> Column:
    """The entries as lines, each with at most ``chars`` characters, until one no longer fits ``total`` bytes; '' without any."""

    def add(acc: Column, x: Column) -> Column:
        line = F.concat(F.lit("- "), cap_chars(x["summary"], chars), F.lit("\n"))
        fits = F.octet_length(acc["text"]) + F.octet_length(line) <= total
        more = F.struct(F.concat(acc["text"], F.when(fits, line).otherwise(F.lit(MORE))).alias("text"), (~fits).alias("full"))
        return F.when(acc["full"], acc).otherwise(more)

    start = F.struct(F.lit(HEAD).alias("text"), F.lit(False).alias("full"))
    text = F.aggregate(kept, start, add, lambda acc: F.concat(acc["text"], F.lit(TAIL)))
    return F.when(F.size(kept) == 0, "").otherwise(text)


def recall_context(memories: DataFrame, queries: DataFrame, index: BlockIndex, limit: int = 5, project: str | None = None) -> DataFrame:
    """(query_id, ids, text) for every query (query_id, text).

    Rows with all of a query's words, the heaviest first: those of the project if there are any, else of all projects; without any, the
    heaviest preferences. Of these ``limit`` at most, near repetitions are left out and the rest is rendered. A query's list never has more than
    ``limit`` entries, MAX_LIMIT at most.
    """
    limit = max(1, min(limit, MAX_LIMIT))
    kind = memories.schema["id"].dataType.simpleString()
    heaviest = Window.partitionBy("query_id").orderBy(F.desc("weight"), "id")
    hits = index.matching(queries).join(memories.select("id", "weight", project_matches(F.col("topic"), project).alias("mine")), "id")
    # the heaviest of the project and of all others, each by themselves, so that no number of others keeps the project's rows out
    pool = hits.withColumn("rn", F.row_number().over(Window.partitionBy("query_id", "mine").orderBy(F.desc("weight"), "id"))).filter(F.col("rn") <= limit)
    mine = pool.withColumn("any", F.max("mine").over(Window.partitionBy("query_id"))).filter(F.col("mine") | ~F.col("any"))
    best = mine.withColumn("rn", F.row_number().over(heaviest)).filter(F.col("rn") <= limit)
    entry = lambda rows: F.transform(F.array_sort(F.collect_list(F.struct("rn", "id", "summary"))), lambda x: F.struct(x["id"].alias("id"), x["summary"].alias("summary"))).alias(rows)
    # whole texts are joined for the entries alone
    found = best.select("query_id", "rn", "id").join(memories.select("id", "summary"), "id").groupBy("query_id").agg(entry("items"))
    liked = memories.filter(is_preference_topic(F.col("topic"))).orderBy(F.desc("weight"), "id").limit(limit)
    liked = liked.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("weight"), "id"))).agg(entry("liked"))  # at most ``limit`` rows
    both = queries.select("query_id").join(found, "query_id", "left").crossJoin(F.broadcast(liked))  # one row
    kept = both.select("query_id", suppressed(F.coalesce("items", "liked"), kind).alias("kept"))
    return kept.select("query_id", F.transform("kept", lambda x: x["id"]).alias("ids"), rendered(F.col("kept")).alias("text"))
