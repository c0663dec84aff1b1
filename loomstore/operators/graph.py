"""Concept graphs: neighbours, bounded and unbounded traversal, cycles, export, statistics, mining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstore.functions.predicates import confidence_bar, confidence_colour, format_labels
from loomstore.functions.text import jaccard
from loomstore.operators.components import connected_components
from loomstore.plans.shared import keep


def neighbours(links: DataFrame, concept: str, relation: str | None = None) -> DataFrame:
    """(id): targets of outgoing and sources of incoming links."""
    e = links.filter(F.col("relation") == relation) if relation else links
    return e.filter(F.col("source_id") == concept).select(F.col("target_id").alias("id")).union(e.filter(F.col("target_id") == concept).select("source_id")).distinct()


def neighbourhood(links: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, depth): breadth-first over both directions from the ids in ``start``; one frontier a level."""
    both = links.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).union(links.select("target_id", "source_id"))
    seen = start.select("id").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(both, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        frontier = keep(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)), "frontier")
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen


def neighbourhood_links(links: DataFrame, nodes: DataFrame, depth: int, distinct: bool = True) -> DataFrame:
    """Links of every expanded node (those nearer than ``depth``); without ``distinct`` a link appears for each of its ends that was expanded."""
    inner = nodes.filter(F.col("depth") < depth).select("id")
    both = links.join(inner, F.col("source_id") == F.col("id")).drop("id").unionByName(links.join(inner, F.col("target_id") == F.col("id")).drop("id"))
    return both.distinct() if distinct else both


def reachable(links: DataFrame, start: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(origin, id): what each id of ``start`` reaches along links; a frontier loop that ends when nothing is new."""
    e = links.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).distinct()
    seen = keep(start.select(F.col("id").alias("origin"), "id").distinct(), "reach")
    frontier = seen
    for _ in range(most_rounds):
        step = frontier.join(e, F.col("id") == F.col("a")).select("origin", F.col("b").alias("id")).distinct()
        frontier = keep(step.join(seen, ["origin", "id"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def closes_cycle(links: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate links (source_id, target_id) with ``cycle``: true for self-links and where the target reaches the source."""
    paths = reachable(links, candidates.select(F.col("target_id").alias("id")))
    hit = paths.select(F.col("origin").alias("target_id"), F.col("id").alias("source_id")).distinct().withColumn("_hit", F.lit(True))
    return candidates.join(hit, ["source_id", "target_id"], "left").withColumn("cycle", (F.col("source_id") == F.col("target_id")) | F.coalesce("_hit", F.lit(False))).drop("_hit")


def add_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """New links that close no cycle and don't repeat (source, target, relation)."""
    fine = closes_cycle(links, new).filter("not cycle").drop("cycle")
    return links.unionByName(fine.join(links, ["source_id", "target_id", "relation"], "left_anti"), allowMissingColumns=True)


def links_of_memoir(links: DataFrame, concepts: DataFrame, memoir: str, limit: int = 5000) -> DataFrame:
    mine = concepts.filter(F.col("memoir_id") == memoir).select(F.col("id").alias("source_id"))
    return links.join(mine, "source_id", "left_semi").orderBy("source_id", "target_id", "relation").limit(limit)


def memoir_stats(concepts: DataFrame, links: DataFrame) -> DataFrame:
    """memoir_id, concepts, links, avg_confidence, labels (a 'ns:value' count for each, by count then label)."""
    base = concepts.groupBy("memoir_id").agg(F.count("*").alias("concepts"), F.avg("confidence").alias("avg_confidence"))
    n = links.join(concepts.select(F.col("id").alias("source_id"), "memoir_id"), "source_id").groupBy("memoir_id").agg(F.count("*").alias("links"))
    lab = concepts.select("memoir_id", F.explode("labels").alias("l")).groupBy("memoir_id", F.concat("l.namespace", F.lit(":"), "l.value").alias("label")).agg(F.count("*").alias("n"))
    hist = lab.groupBy("memoir_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "label"))).alias("h"))
    text = F.array_join(F.transform("h", lambda x: F.concat(x["label"], F.lit("="), (-x["m"]).cast("string"))), ",")
    return base.join(n, "memoir_id", "left").join(hist.select("memoir_id", text.alias("labels")), "memoir_id", "left").select("memoir_id", "concepts", F.coalesce("links", F.lit(0)).alias("links"), "avg_confidence", "labels")


def search_concepts(concepts: DataFrame, query: str, memoir: str | None = None, limit: int = 20) -> DataFrame:
    from loomstore.operators.search import match_all

    rows = concepts.filter(F.col("memoir_id") == memoir) if memoir else concepts
    flat = rows.withColumn("_labels", format_labels(F.col("labels")))
    return match_all(flat, query, ("name", "definition", "_labels")).orderBy(F.desc("confidence"), "id").limit(limit)


def search_by_label(concepts: DataFrame, namespace: str, value: str, limit: int = 20, refine: str = "") -> DataFrame:
    rows = concepts.filter(F.exists("labels", lambda x: (x["namespace"] == namespace) & (x["value"] == value)))
    if refine:
        rows = rows.filter(F.lower("name").contains(refine.lower()) | F.lower("definition").contains(refine.lower()))
    return rows.orderBy(F.desc("confidence"), "id").limit(limit)


def refine(concepts: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: (id, definition, sources). A refined concept gets the new definition, the next revision and more confidence."""
    new = changes.select("id", F.col("definition").alias("_d"), F.col("sources").alias("_s"))
    hit = F.col("_d").isNotNull()
    out = concepts.join(new, "id", "left")
    out = out.withColumn("definition", F.coalesce("_d", "definition")).withColumn("revision", F.col("revision") + F.when(hit, 1).otherwise(0)).withColumn("confidence", F.when(hit, F.least(F.col("confidence") + 0.1, F.lit(1.0))).otherwise(F.col("confidence")))
    return out.withColumn("source_memory_ids", F.when(hit, F.array_union("source_memory_ids", F.coalesce("_s", F.array().cast("array<string>")))).otherwise(F.col("source_memory_ids"))).drop("_d", "_s")


def delete_memoir(concepts: DataFrame, links: DataFrame, memoir: str) -> tuple[DataFrame, DataFrame]:
    """What is left of concepts and links: links with either end in the memoir go too."""
    rest, kept = delete_concept(concepts, links, concepts.filter(F.col("memoir_id") == memoir))
    return rest, kept


def named_edges(concepts: DataFrame, links: DataFrame) -> DataFrame:
    """(source, relation, target) by names; links with a missing end are dropped."""
    a = concepts.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    b = concepts.select(F.col("id").alias("target_id"), F.col("name").alias("target"))
    return links.join(a, "source_id").join(b, "target_id").select("source", "relation", "target")


def export_lines(concepts: DataFrame, links: DataFrame, style: str) -> DataFrame:
    """(part, ord, line) of a graph in one of the styles json, dot, ascii, ai; parts in order: nodes 1, edges 2."""
    q = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    edges = named_edges(concepts, links)
    if style == "json":
        node = F.to_json(F.struct("name", "definition", F.round("confidence", 3).alias("confidence"), "labels"))
        edge = F.to_json(F.struct("source", "relation", "target"))
    elif style == "dot":
        node = F.concat(F.lit("  "), q(F.col("name")), F.lit(" [color="), confidence_colour(F.col("confidence")), F.lit("];"))
        edge = F.concat(F.lit("  "), q(F.col("source")), F.lit(" -> "), q(F.col("target")), F.lit(" [label="), q(F.col("relation")), F.lit("];"))
    elif style == "ascii":
        node = F.concat(F.lit("["), confidence_bar(F.col("confidence")), F.lit("] "), F.col("name"), F.lit(" ("), format_labels(F.col("labels")), F.lit(")"))
        edge = F.concat("source", F.lit(" --"), "relation", F.lit("--> "), "target")
    else:
        node = F.concat(F.lit("- "), "name", F.lit(": "), "definition")
        edge = F.concat_ws(" ", "source", "relation", "target")
    return concepts.select(F.lit(1).alias("part"), F.col("name").alias("ord"), node.alias("line")).unionByName(edges.select(F.lit(2).alias("part"), F.concat_ws("\0", "source", "relation", "target").alias("ord"), edge.alias("line")))


def jaccard_pairs(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(topic, a, b, sim): rows of a topic whose lower-case keyword sets overlap by more than the threshold.

    Rows with equal keyword sets are one set; sets meet over a shared keyword among their first
    floor((1 - threshold) * size) + 1 in order of rarity (no pair over the threshold can avoid that), so a
    keyword that everybody has brings nothing together by itself. Pairs are of representatives: the smallest id of a set.
    """
    sets = df.select("topic", "id", F.array_sort(F.array_distinct(F.transform("keywords", F.lower))).alias("kws")).filter(F.size("kws") > 0)
    reps = sets.groupBy("topic", "kws").agg(F.min("id").alias("id"))
    items = reps.select("topic", "id", F.explode("kws").alias("kw"))
    rare = items.groupBy("topic", "kw").agg(F.count("*").alias("n"))
    ranked = items.join(rare, ["topic", "kw"]).withColumn("rn", F.row_number().over(Window.partitionBy("topic", "id").orderBy("n", "kw")))
    sizes = reps.select("topic", "id", F.size("kws").alias("m"))
    prefix = ranked.join(sizes, ["topic", "id"]).filter(F.col("rn") <= F.floor(F.col("m") * (1 - threshold) + 1e-9) + 1).select("topic", "kw", "id")
    pairs = prefix.alias("x").join(prefix.alias("y"), (F.col("x.topic") == F.col("y.topic")) & (F.col("x.kw") == F.col("y.kw")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.topic").alias("topic"), F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    k = reps.select("topic", "id", "kws")
    sim = pairs.join(k.withColumnsRenamed({"id": "a", "kws": "ka"}), ["topic", "a"]).join(k.withColumnsRenamed({"id": "b", "kws": "kb"}), ["topic", "b"]).withColumn("sim", jaccard(F.col("ka"), F.col("kb")))
    return sim.filter(F.col("sim") > threshold).select("topic", "a", "b", "sim")


def pattern_clusters(df: DataFrame, threshold: float = 0.5, min_size: int = 3) -> DataFrame:
    """(topic, cluster, size, representative, keywords): components of Jaccard pairs; equal keyword sets belong together."""
    sets = df.select("topic", "id", "weight", F.array_sort(F.array_distinct(F.transform("keywords", F.lower))).alias("kws")).filter(F.size("kws") > 0)
    reps = sets.groupBy("topic", "kws").agg(F.min("id").alias("rep"))
    comp = connected_components(jaccard_pairs(df, threshold), "a", "b").withColumnRenamed("id", "rep")
    member = sets.join(reps, ["topic", "kws"]).join(comp, "rep", "left").withColumn("cluster", F.coalesce("component", "rep"))
    out = member.groupBy("topic", "cluster").agg(F.count("*").alias("size"), F.max_by("id", F.struct("weight", (-F.col("id")).alias("i"))).alias("representative"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("kws")))).alias("keywords"))
    return out.filter(F.col("size") >= min_size)


def pattern_concepts(clusters: DataFrame, df: DataFrame) -> DataFrame:
    """Concepts from clusters: name of the first three keywords, the representative's summary, confidence by size, at most five labels."""
    kw = F.col("keywords")
    rep = df.select(F.col("id").alias("representative"), "summary")
    return clusters.join(rep, "representative").select(
        "topic",
        "cluster",
        F.array_join(F.slice(kw, 1, 3), "-").alias("name"),
        F.concat("summary", F.lit(" (pattern detected across "), F.col("size").cast("string"), F.lit(" memories)")).alias("definition"),
        F.least(F.lit(0.5) + F.col("size") * 0.05, F.lit(0.9)).alias("confidence"),
        F.transform(F.slice(kw, 1, 5), lambda k: F.struct(F.lit("pattern").alias("namespace"), k.alias("value"))).alias("labels"),
    )


def distill(df: DataFrame, topic: str) -> DataFrame:
    """Concepts of a topic: named by the first keyword, definitions joined in order of weight, a step of confidence for each more."""
    name = F.coalesce(F.nullif(F.get("keywords", F.lit(0)), F.lit("")), F.concat_ws("-", F.col("topic"), F.substring(F.col("id").cast("string"), 1, 8)))
    rows = df.filter(F.col("topic") == topic).select(name.alias("name"), "weight", "id", "summary")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "id", "summary"))), lambda x: x["summary"]), "\n---\n")
    return rows.groupBy("name").agg(joined.alias("definition"), F.count("*").alias("n")).select("name", "definition", F.col("n").alias("revision"), F.least(F.lit(0.5) + 0.1 * (F.col("n") - 1), F.lit(1.0)).alias("confidence"))


def batch_concept_counts(concepts: DataFrame) -> DataFrame:
    return concepts.groupBy("memoir_id").agg(F.count("*").alias("concepts"))




def update_by_id(df: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of ``df`` with the values of the row in ``changes`` that has their id (nulls change nothing). The ids of ``changes`` that ``df`` lacks
    are the caller's to refuse: ``missing_ids``."""
    cols = [c for c in changes.columns if c != "id"]
    new = changes.select("id", *[F.col(c).alias(f"_{c}") for c in cols])
    return df.join(new, "id", "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in cols else F.col(c) for c in df.columns])


def missing_ids(df: DataFrame, changes: DataFrame) -> DataFrame:
    return changes.select("id").join(df, "id", "left_anti")


def delete_concept(concepts: DataFrame, links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without these concepts, and without the links from or to them."""
    gone = ids.select(F.col("id").alias("_id"))
    rest = concepts.join(gone, F.col("id") == F.col("_id"), "left_anti")
    return rest, links.join(gone, F.col("source_id") == F.col("_id"), "left_anti").join(gone, F.col("target_id") == F.col("_id"), "left_anti")
