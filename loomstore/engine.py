"""The memory engine: named operations over a versioned store."""

from __future__ import annotations

import datetime
import json
import uuid
from collections import OrderedDict
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstore.functions import vectors
from loomstore.functions.predicates import importance_rank
from loomstore.functions.text import embed_text, summary_hash
from loomstore.operators import blocks, context, extract, graph, lifecycle, lookup, ordered, packs, postings, records, search
from loomstore.plans.shared import fresh_path, keep, read_if_there, scratch
from loomstore.schemas import AUTO_DECAY, CONSOLIDATE_AT, DUPLICATE_SCORE, LINK_SCORE, MAX_LINKS, TABLES
from loomstore.sources import sinks
from loomstore.sources.snapshots import Snapshots

Embedder = Callable[[list[str]], list[list[float]]]


def hashing_embedder(dims: int = 64) -> Embedder:
    """A deterministic embedder for places without a model: signed hashes of words, scaled to length 1."""
    import hashlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dims
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % dims] += 1.0 if h >> 63 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out

    return embed


#: Rows that ``get`` keeps on the driver.
CACHED = 256


class MemoryEngine:
    def __init__(self, spark: SparkSession, path: str, dims: int = 64, readonly: bool = False, embedder: Embedder | None = None):
        self.spark, self.embedder = spark, embedder
        self.store_ = Snapshots(spark, path, dims, readonly)
        self._cache: OrderedDict = OrderedDict()
        self._cached_at = -1

    # --- memories ---------------------------------------------------------

    @property
    def memories(self) -> DataFrame:
        return self.store_.table("memories")

    def _now(self):
        return F.lit(datetime.datetime.now(datetime.timezone.utc))

    def _embed(self, rows: DataFrame) -> DataFrame:
        """Vectors for rows that have none, in Arrow batches."""
        if self.embedder is None:
            return rows
        embed = self.embedder

        @F.pandas_udf("array<float>")
        def run(s):
            import pandas as pd

            return pd.Series(embed(s.fillna("").tolist()), index=s.index)

        return rows.withColumn("embedding", F.coalesce("embedding", run(embed_text(F.col("topic"), F.col("summary")))))

    def _checked(self, rows: list[dict] | DataFrame) -> DataFrame:
        """Rows of ``store`` with their vectors; the first error of any is raised."""
        if isinstance(rows, list):
            data = [(str(uuid.uuid4()), r["topic"], r["summary"], r.get("importance", "medium"), r.get("keywords", []), r.get("raw_excerpt"), r.get("embedding"), i) for i, r in enumerate(rows)]
            rows = self.spark.createDataFrame(data, "id string, topic string, summary string, importance string, keywords array<string>, raw_excerpt string, embedding array<float>, seq long")
        checked = lifecycle.validate(rows)
        bad = checked.filter("error is not null").select("error").first()
        if bad:
            raise ValueError(bad.error)
        return self._embed(checked.drop("error"))

    def store(self, rows: list[dict] | DataFrame) -> int:
        """Validates, embeds and merges new rows (in their order; only those of one topic and content); returns the new version."""
        new = self._checked(rows)
        old = self.memories
        merged = lifecycle.merge_rows(old.select("id", "topic", "summary", "importance", "keywords", "raw_excerpt", F.lit(-1).cast("long").alias("seq")).unionByName(new.select("id", "topic", "summary", "importance", "keywords", "raw_excerpt", "seq")))
        first = new.withColumn("_k", F.lower("topic")).withColumn("summary_hash", summary_hash(F.col("topic"), F.col("summary"))).groupBy("_k", "summary_hash").agg(F.max_by("embedding", -F.col("seq")).alias("_e"))
        keep = old.select("id", "weight", "access_count", "related_ids", "embedding", "created_at", "last_accessed")
        now = self._now()
        out = merged.join(keep, "id", "left").withColumn("_k", F.lower("topic")).join(first, ["_k", "summary_hash"], "left")
        out = out.select("id", "topic", "summary", "importance", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("access_count", F.lit(0)).alias("access_count"), "keywords", F.coalesce("related_ids", F.array().cast("array<string>")).alias("related_ids"), "raw_excerpt", F.coalesce("embedding", "_e").alias("embedding"), F.coalesce("created_at", now).alias("created_at"), now.alias("updated_at"), F.coalesce("last_accessed", now).alias("last_accessed"), "summary_hash")
        return self.store_.write("memories", out)

    def remember(self, rows: list[dict] | DataFrame) -> int:
        """``store`` for what may be known: a near duplicate overwrites the row of its topic that it is nearest to, and other rows are linked
        to what is near them, one after the other. Returns the new version."""
        new = self._checked(rows)
        with scratch(self.spark):
            return self._store_in_order(keep(new.select("id", "topic", "summary", "importance", "keywords", "raw_excerpt", "embedding", F.col("seq").cast("long").alias("seq")), "new-rows"))

    def _store_in_order(self, new: DataFrame) -> int:
        """Rows with a vector overwrite near duplicates of their topic or open linked slots, one after the other; then rows of one topic and
        content are merged, and links to a row that was merged into another lead to that one."""
        old, now = self.memories, self._now()
        none = F.array().cast("array<string>")
        placed, links = ordered.place(old, new)
        left = keep(ordered.contents(new, keep(placed, "placed")), "contents")
        over = left.filter("not opened").select(F.col("slot").alias("id"), *[F.col(c).alias(f"_{c}") for c in ("summary", "importance", "keywords", "raw_excerpt", "embedding")], F.lit(True).alias("_over"))
        base = old.join(over, "id", "left").select(*[F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in over.columns else (F.when(F.col("_over"), 1.0).otherwise(F.col("weight")).alias(c) if c == "weight" else F.col(c)) for c in old.columns], "_over")
        base = keep(base.withColumn("updated_at", F.when(F.col("_over"), now).otherwise(F.col("updated_at"))).drop("_over"), "base")
        cols = ["id", "topic", "summary", "importance", "keywords", "raw_excerpt"]
        opened = left.filter("opened").select(F.col("slot").alias("id"), *cols[1:4], F.coalesce("keywords", none).alias("keywords"), "raw_excerpt", "embedding", F.col("first").alias("seq"))
        added = keep(opened.unionByName(new.filter("embedding is null").select(*opened.columns)), "added")
        merged = lifecycle.merge_rows(base.select(*cols, F.lit(-1).cast("long").alias("seq")).unionByName(added.select(*cols, "seq")))
        first = added.withColumn("_k", F.lower("topic")).withColumn("summary_hash", summary_hash(F.col("topic"), F.col("summary"))).groupBy("_k", "summary_hash").agg(F.max_by("embedding", -F.col("seq")).alias("_e"), F.collect_set("id").alias("_ids"))
        kept = base.select("id", "weight", "access_count", "related_ids", "embedding", "created_at", "updated_at", "last_accessed")
        out = merged.join(kept, "id", "left").withColumn("_k", F.lower("topic")).join(first, ["_k", "summary_hash"], "left")
        changed = F.coalesce(F.when(F.col("_ids").isNull(), F.col("updated_at")), now).alias("updated_at")
        out = keep(out.select("id", "topic", "summary", "importance", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("access_count", F.lit(0)).alias("access_count"), "keywords", F.coalesce("related_ids", none).alias("related_ids"), "raw_excerpt", F.coalesce("embedding", "_e").alias("embedding"), F.coalesce("created_at", now).alias("created_at"), changed, F.coalesce("last_accessed", now).alias("last_accessed"), "summary_hash", "_ids"), "stored")
        into = keep(out.filter("_ids is not null").select(F.explode("_ids").alias("was"), F.col("id").alias("into")).filter("was <> into"), "into")
        ends = keep(links.select("src", "dst"), "links")
        for c in ("src", "dst"):
            ends = ends.join(into.select(F.col("was").alias(c), "into"), c, "left").withColumn(c, F.coalesce("into", c)).drop("into")
        both = ends.select("src", "dst").union(ends.select("dst", "src")).filter("src <> dst")
        return self.store_.write("memories", lifecycle.backrefs(out.drop("_ids"), both))

    def auto_link(self, threshold: float = LINK_SCORE, most: int = MAX_LINKS) -> int:
        """Links rows without links to their nearest ones, both ways."""
        m = self.memories
        pairs = search.similar_pairs(m.filter("size(related_ids) = 0 and embedding is not null").select("id", "embedding"), m, threshold, most)
        both = pairs.select(F.col("query_id").alias("src"), F.col("id").alias("dst")).union(pairs.select("id", "query_id"))
        return self.store_.write("memories", lifecycle.backrefs(m, both))

    def find_duplicate(self, topic: str, summary: str) -> DataFrame:
        v = self.embedder([f"{topic} {summary}"])[0]
        return search.find_similar(self.memories, v, topic, DUPLICATE_SCORE)

    def recall(self, query: str, limit: int = 10, touch: bool = True, **scope) -> DataFrame:
        self.maybe_decay()
        vector = self.embedder([query])[0] if self.embedder else None
        hits = search.recall(self.memories, query, vector, limit, index=self.text_index(), **scope)
        if vector is None and hits.isEmpty():
            hits = search.keyword_search(self.memories, query.split(), limit).withColumn("score", F.lit(1.0))
        if touch and not self.store_.readonly:
            hits = self.spark.createDataFrame(hits.collect(), hits.schema)  # at most ``limit`` rows, kept as they were found
            # a few rows beside the table, merged when it is read
            self.store_.append("touches", hits.select("id", F.lit(1).alias("times"), self._now().alias("at")))
        return hits

    def index(self) -> postings.Postings:
        """The inverted index of the memories' current version, built when it is first asked for."""
        state = self.store_.state
        name = state["tables"].get("memories", "none").replace("/", "-")
        path = f"{self.store_.path}/_postings/{name}"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/stats/_SUCCESS")
        if at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return postings.Postings(self.spark, path)
        half = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        half.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(half, True)  # one that wasn't finished
        return postings.Postings.build(self.memories, path)

    def text_index(self) -> blocks.BlockIndex:
        """The index that skips, brought up to date: what differs between the version that it was made of and the current one goes into a
        new segment, and segments are merged by their sizes. Which segments count stands in the store's metadata."""
        of = self.store_.state["tables"].get("memories")
        state = json.loads(self.store_.meta("text_index") or "{}")
        if state.get("of") == of and state:
            return blocks.BlockIndex(self.spark, f"{self.store_.path}/text_index", state["segments"])
        cols = ["id", "topic", "summary", "keywords"]
        now = self.memories.select(*cols)
        if self.store_.readonly:  # nothing may be written beside the store
            path = fresh_path(self.spark, "text-index")
            blocks.BlockIndex.add(now, path, 0)
            return blocks.BlockIndex(self.spark, path)
        path = f"{self.store_.path}/text_index"
        before = read_if_there(self.spark, f"{self.store_.path}/{state['of']}") if state.get("of") else None
        number = state.get("next", 0)
        if before is None:
            blocks.BlockIndex.add(now, path, number, now.limit(0))
            index = blocks.BlockIndex(self.spark, path, [number])
        else:
            same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols])
            old = before.select(*cols)
            new = keep(now.alias("n").join(old.alias("o"), same("n", "o"), "left_anti"), "text-changed")
            gone = keep(old.alias("o").join(now.alias("n"), same("o", "n"), "left_anti"), "text-gone")
            index = blocks.BlockIndex(self.spark, path, state["segments"])
            if not (new.isEmpty() and gone.isEmpty()):
                blocks.BlockIndex.add(new, path, number, gone)
                index = blocks.BlockIndex(self.spark, path, [*state["segments"], number]).compact(number + 1)
        self.store_.meta("text_index", json.dumps({"of": of, "segments": index.segments, "next": number + 2}))
        return index

    def search_text(self, query: str, limit: int = 10, mode: str = "or") -> DataFrame:
        """(id, score): by BM25 over the index."""
        return self.text_index().top(query, limit, mode)

    def context_for(self, prompt: str, limit: int = 5, project: str | None = None) -> str:
        """What is known on a prompt's words, without near repetitions and within the byte budget ('' for nothing)."""
        one = self.spark.createDataFrame([(0, prompt)], "query_id int, text string")
        return context.recall_context(self.memories, one, self.text_index(), limit, project).first().text

    def render(self, hits: DataFrame, style: str = "toon") -> str:
        return sinks.render(hits, style)

    # changes return how many rows they changed, as the write counted them

    def update(self, changes: DataFrame) -> int:
        flagged = lifecycle.update_rows(self.memories.withColumn("_hit", F.lit(None).cast("boolean")), changes.withColumn("_hit", F.lit(True)))
        return self.store_.change("memories", flagged.withColumn("summary_hash", summary_hash(F.col("topic"), F.col("summary"))), F.col("_hit"))

    def forget(self, ids: list[str]) -> int:
        gone = self.spark.createDataFrame([(i,) for i in {*ids}], "id string").withColumn("_hit", F.lit(True))
        return self.store_.change("memories", self.memories.join(gone, "id", "left"), F.col("_hit"), drop=True)

    def forget_topic(self, topic: str) -> int:
        return self.store_.change("memories", self.memories, F.col("topic") == topic, drop=True)

    def decay(self, factor: float) -> int:
        """Critical rows keep their weight and aren't counted."""
        return self.store_.change("memories", lifecycle.decay(self.memories, factor), F.col("importance") != "critical")

    def maybe_decay(self) -> bool:
        """Once a day; the stamp is set before the rows, so a second caller finds it."""
        now = datetime.datetime.now(datetime.timezone.utc)
        last = self.store_.meta("last_decay_at")
        if self.store_.readonly or (last and now - datetime.datetime.fromisoformat(last) < datetime.timedelta(days=1)):
            return False
        self.store_.meta("last_decay_at", now.isoformat())
        if last:
            self.decay(AUTO_DECAY)
        return bool(last)

    def prune_below(self, threshold: float) -> int:
        """Drops what has faded, and returns how many rows that were."""
        return self.store_.change("memories", self.memories, lifecycle.prunable(threshold), drop=True)

    def prune(self, threshold: float, dry_run: bool = False) -> DataFrame:
        gone = self.memories.filter(lifecycle.prunable(threshold))
        if not dry_run:
            self.store_.mutate("memories", lambda m: lifecycle.prune(m, threshold))
        return gone

    def consolidate(self, topic: str, keep_originals: bool = False) -> int:
        m = self.memories
        one = lifecycle.consolidate(m.filter(F.col("topic") == topic)).select(F.expr("uuid()").alias("id"), "topic", "summary", "importance", F.lit(1.0).alias("weight"), F.lit(0).cast("long").alias("access_count"), "keywords", "related_ids", self._now().alias("created_at"), self._now().alias("updated_at"), self._now().alias("last_accessed"), summary_hash(F.col("topic"), F.col("summary")).alias("summary_hash"))
        return self.store_.write("memories", m.unionByName(one, allowMissingColumns=True) if keep_originals else lifecycle.replace_topic(m, topic, one))

    def embed_all(self, force: bool = False) -> int:
        return self.store_.write("memories", self._embed(self.memories.withColumn("embedding", F.lit(None).cast("array<float>")) if force else self.memories))

    def list_(self, sort: str = "weight", topic: str | None = None, limit: int = 50) -> DataFrame:
        m = self.memories.filter(F.col("topic") == topic) if topic else self.memories
        key = {"weight": "weight", "created": "created_at", "accessed": "last_accessed"}[sort]
        return m.orderBy(F.desc(key), "id").limit(limit)

    def topics(self) -> DataFrame:
        return self.memories.groupBy("topic").agg(F.count("*").alias("entries")).orderBy("topic")

    def stats(self) -> DataFrame:
        return lifecycle.store_stats(self.memories)

    def health(self) -> DataFrame:
        return lifecycle.health(self.memories, self._now())

    def wake_up(self, max_tokens: int = 200, project: str | None = None) -> str:
        return packs.render_wake_up(packs.wake_up(self.memories, self._now(), max_tokens, project), project)

    def context(self, max_tokens: int = 200, project: str | None = None) -> str:
        return packs.render_snapshot(self.memories, max_tokens, project)

    def extract(self, texts: DataFrame, project: str, max_importance: str = "medium") -> int:
        """Facts of texts (id, summary) become memories, with their importance capped."""
        from loomstore.functions.predicates import cap_importance

        f = extract.extract_facts(texts)
        rows = f.select(F.expr("uuid()").alias("id"), F.lit(f"context-{project}").alias("topic"), F.col("fact").alias("summary"), cap_importance(F.col("importance"), max_importance).alias("importance"), F.array_union("kinds", extract.entities(F.col("fact"))).alias("keywords"), F.lit(None).cast("string").alias("raw_excerpt"), F.lit(None).cast("array<float>").alias("embedding"), F.monotonically_increasing_id().alias("seq"))
        rows = keep(rows, "facts")  # ids and order are fixed before they are used twice
        return self.store_.state["version"] if rows.isEmpty() else self.store(rows)

    def preview(self, texts: DataFrame, project: str) -> DataFrame:
        """What ``extract`` would store: (topic, fact, importance, kinds)."""
        return extract.extract_facts(texts).select(F.lit(f"context-{project}").alias("topic"), "fact", "importance", "kinds")

    def maybe_consolidate(self, topic: str, threshold: int = CONSOLIDATE_AT, enabled: bool = True) -> str:
        """Consolidates a topic of at least ``threshold`` rows; says what was done ('' for nothing)."""
        n = lookup.by_key(self.memories, topic=topic).count() if enabled and not self.store_.readonly else 0
        if n < max(2, threshold):
            return ""
        self.consolidate(topic)
        return f"consolidated {n} entries of {topic}"

    # --- getters --------------------------------------------------------------

    def get(self, memory_id: str):
        """One memory by id, or None. The last CACHED rows stay on the driver until the store moves on."""
        if self._cached_at != self.store_.state["version"]:
            self._cache.clear()
            self._cached_at = self.store_.state["version"]
        if memory_id in self._cache:
            self._cache.move_to_end(memory_id)
        else:
            self._cache[memory_id] = lookup.by_key(self.memories, id=memory_id).first()
            if len(self._cache) > CACHED:
                self._cache.popitem(last=False)
        return self._cache[memory_id]

    def get_many(self, ids: list[str]) -> DataFrame:
        return lookup.by_keys(self.memories, ids)

    def memoir(self, key: str):
        """A memoir by id or name, or None."""
        return self.store_.table("memoirs").filter((F.col("id") == key) | (F.col("name") == key)).orderBy(F.col("id") != key).first()

    def memoirs(self) -> DataFrame:
        return lookup.list_memoirs(self.store_.table("memoirs"))

    def concept(self, concept_id: str):
        return lookup.by_key(self.store_.table("concepts"), id=concept_id).first()

    def concept_named(self, memoir_id: str, name: str):
        return lookup.by_key(self.store_.table("concepts"), memoir_id=memoir_id, name=name).first()

    def concepts(self, memoir_id: str) -> DataFrame:
        return lookup.list_concepts(self.store_.table("concepts"), memoir_id)

    def links(self, concept_id: str, outgoing: bool = True) -> DataFrame:
        return lookup.by_key(self.store_.table("links"), **{"source_id" if outgoing else "target_id": concept_id})

    def session(self, session_id: str):
        return lookup.by_key(self.store_.table("sessions"), id=session_id).first()

    def sessions(self, limit: int = 50) -> DataFrame:
        return self.store_.table("sessions").orderBy(F.desc("updated_at"), "id").limit(limit)

    def counts(self) -> DataFrame:
        """(name, n) of all tables."""
        return lookup.table_counts({name: self.store_.table(name) for name in TABLES})

    def patterns(self, topic: str, min_size: int = 3) -> DataFrame:
        m = self.memories.filter(F.col("topic") == topic)
        numbered = m.withColumn("key", F.xxhash64("id")).select("topic", F.col("key").alias("id"), "weight", "keywords", "summary")
        return graph.pattern_concepts(graph.pattern_clusters(numbered, 0.5, max(2, min(min_size, 50))), numbered)

    # --- concept graphs -----------------------------------------------------

    def create_memoir(self, name: str, description: str = "") -> str:
        m = self.store_.table("memoirs")
        if not m.filter(F.col("name") == name).isEmpty():
            raise ValueError(f"memoir exists: {name}")
        mid = str(uuid.uuid4())
        row = self.spark.createDataFrame([(mid, name, description)], "id string, name string, description string").withColumn("created_at", self._now()).withColumn("updated_at", self._now())
        self.store_.write("memoirs", m.unionByName(row))
        return mid

    def add_concepts(self, memoir_id: str, rows: list[tuple[str, str]]) -> int:
        """(name, definition) pairs; names are unique in a memoir."""
        c = self.store_.table("concepts")
        new = self.spark.createDataFrame([(str(uuid.uuid4()), memoir_id, n, d) for n, d in rows], "id string, memoir_id string, name string, definition string")
        if not new.join(c, ["memoir_id", "name"], "left_semi").isEmpty() or len({n for n, _ in rows}) < len(rows):
            raise ValueError("a concept of that name exists")
        full = new.withColumn("confidence", F.lit(0.5)).withColumn("revision", F.lit(1).cast("long")).withColumn("labels", F.expr("cast(array() as array<struct<namespace:string,value:string>>)")).withColumn("source_memory_ids", F.expr("cast(array() as array<string>)"))
        return self.store_.write("concepts", c.unionByName(full, allowMissingColumns=True))

    def link(self, source_id: str, target_id: str, relation: str) -> int:
        links = self.store_.table("links")
        new = self.spark.createDataFrame([(str(uuid.uuid4()), source_id, target_id, relation)], "id string, source_id string, target_id string, relation string")
        if graph.closes_cycle(links, new).first().cycle:
            raise ValueError("the link would close a cycle")
        return self.store_.write("links", links.unionByName(new, allowMissingColumns=True).dropDuplicates(["source_id", "target_id", "relation"]))

    def _changed(self, table: str, changes: DataFrame) -> int:
        rows = self.store_.table(table)
        missing = graph.missing_ids(rows, changes).first()
        if missing:
            raise KeyError(missing.id)
        return self.store_.write(table, graph.update_by_id(rows, changes.withColumn("updated_at", self._now())))

    def update_memoir(self, memoir_id: str, name: str | None = None, description: str | None = None) -> int:
        return self._changed("memoirs", self.spark.createDataFrame([(memoir_id, name, description)], "id string, name string, description string"))

    def update_concept(self, concept_id: str, name: str | None = None, definition: str | None = None, confidence: float | None = None) -> int:
        return self._changed("concepts", self.spark.createDataFrame([(concept_id, name, definition, confidence)], "id string, name string, definition string, confidence double"))

    def delete_concept(self, concept_id: str) -> int:
        """With its links; returns how many concepts went."""
        concepts, gone = self.store_.table("concepts"), self.spark.createDataFrame([(concept_id,)], "id string")
        links = graph.delete_concept(concepts, self.store_.table("links"), gone)[1]
        return self.store_.change("concepts", concepts, F.col("id") == concept_id, drop=True, more={"links": links})

    def delete_memoir(self, memoir_id: str) -> int:
        """With its concepts and their links; returns how many memoirs went."""
        concepts, links = graph.delete_memoir(self.store_.table("concepts"), self.store_.table("links"), memoir_id)
        return self.store_.change("memoirs", self.store_.table("memoirs"), F.col("id") == memoir_id, drop=True, more={"links": links, "concepts": concepts})

    def delete_link(self, link_id: str) -> int:
        return self.store_.change("links", self.store_.table("links"), F.col("id") == link_id, drop=True)

    def inspect(self, concept_id: str, depth: int = 1) -> DataFrame:
        start = self.spark.createDataFrame([(concept_id,)], "id string")
        return graph.neighbourhood(self.store_.table("links"), start, max(1, min(depth, 3))).join(self.store_.table("concepts"), "id")

    def export(self, memoir_id: str, style: str = "ascii") -> str:
        c = self.store_.table("concepts").filter(F.col("memoir_id") == memoir_id)
        lines = [r.line for r in graph.export_lines(c, self.store_.table("links"), style).orderBy("part", "ord").collect()]
        return "\n".join(["digraph {", *lines, "}"] if style == "dot" else lines)

    # --- facts and transcripts ----------------------------------------------

    def set_fact(self, entity: str, key: str, value: str, source: str = "manual") -> int:
        f, now = self.store_.table("facts"), self._now()
        slot = (F.col("entity") == entity) & (F.col("key") == key) & F.col("superseded_at").isNull()
        current = f.filter(slot).select("value").first()
        if current and current.value == value:
            return self.store_.state["version"]
        new = self.spark.createDataFrame([(str(uuid.uuid4()), entity, key, value, source)], "id string, entity string, key string, value string, source string").withColumn("created_at", now)
        closed = f.withColumn("superseded_at", F.when(slot, now).otherwise(F.col("superseded_at")))
        return self.store_.write("facts", closed.unionByName(new, allowMissingColumns=True))

    def get_fact(self, entity: str, key: str) -> str | None:
        r = self.store_.table("facts").filter((F.col("entity") == entity) & (F.col("key") == key) & F.col("superseded_at").isNull()).first()
        return r.value if r else None

    def record_messages(self, session_id: str, agent: str, project: str, rows: list[tuple[str, str]]) -> int:
        s, now = self.store_.table("sessions"), self._now()
        new = self.spark.createDataFrame([(session_id, agent, project)], "id string, agent string, project string").withColumn("started_at", now).withColumn("updated_at", now)
        sessions = records.ensure_sessions(s, new)
        m = self.spark.createDataFrame([(str(uuid.uuid4()), session_id, r, c) for r, c in rows], "id string, session_id string, role string, content string").withColumn("ts", now)
        return self.store_.write_all({"sessions": sessions}, {"messages": m})

    def search_transcripts(self, query: str, **scope) -> DataFrame:
        return records.search_transcripts(self.store_.table("messages"), self.store_.table("sessions"), query, **scope)

    def fact_history(self, entity: str, key: str) -> DataFrame:
        return lookup.by_key(self.store_.table("facts"), entity=entity, key=key).orderBy("created_at")

    def forget_fact(self, entity: str, key: str) -> int:
        return self.store_.mutate("facts", lambda f: f.filter((F.col("entity") != entity) | (F.col("key") != key)))

    # --- feedback -------------------------------------------------------------

    def record_feedback(self, topic: str, context: str, predicted: str, corrected: str, reason: str | None = None, source: str = "manual") -> str:
        fid = str(uuid.uuid4())
        row = self.spark.createDataFrame([(fid, topic, context, predicted, corrected, reason, source)], "id string, topic string, context string, predicted string, corrected string, reason string, source string")
        self.store_.append("feedback", row.withColumn("created_at", self._now()).withColumn("applied_count", F.lit(0)))
        return fid

    def apply_feedback(self, ids: list[str]) -> int:
        return self.store_.mutate("feedback", lambda f: records.increment_applied(f, self._ids(ids)))

    def delete_feedback(self, ids: list[str]) -> int:
        return self.store_.mutate("feedback", lambda f: records.delete_feedback(f, self._ids(ids)))

    def search_feedback(self, query: str, topic: str | None = None, limit: int = 20) -> DataFrame:
        return records.search_feedback(self.store_.table("feedback"), query, topic, limit)

    def _ids(self, ids: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id string")

    # --- hooks ----------------------------------------------------------------

    def record_hook_events(self, events: DataFrame) -> int:
        """Rows (ts, event, ...) get ids that go on from the last one."""
        last = max(self.store_.table("hook_events").agg(F.max("id")).first()[0] or 0, int(self.store_.meta("hooks_rolled") or 0))  # ids go on when all events are pruned
        return self.store_.append("hook_events", records.number_events(events, last))

    def roll_up_hooks(self) -> int:
        """Events that came since the last roll-up get into sketches of their hours (late ones too); returns the last event's id."""
        mark, events = int(self.store_.meta("hooks_rolled") or 0), self.store_.table("hook_events")
        last = events.agg(F.max("id")).first()[0] or 0
        if last > mark:
            hours = records.sketch_hours(events.filter((F.col("id") > mark) & (F.col("id") <= last)))
            self.store_.write_all({}, {"hook_hours": hours}, {"hooks_rolled": str(last)})
        return max(last, mark)

    def hook_percentiles(self, since: datetime.datetime | None = None, until: datetime.datetime | None = None) -> DataFrame:
        """Counts and percentiles of rolled-up hours, also of those whose events are pruned."""
        bound = lambda t: None if t is None else F.lit(t)
        return records.merge_sketches(self.store_.table("hook_hours"), bound(since), bound(until))

    def prune_hook_events(self, cutoff: datetime.datetime) -> int:
        """Rolls up first; returns the new version."""
        self.roll_up_hooks()
        return self.store_.mutate("hook_events", lambda e: records.prune_events(e, F.lit(cutoff)))

    def hook_stats(self) -> DataFrame:
        return records.hook_stats(self.store_.table("hook_events"))

    def hook_counter(self, reset: bool = False) -> int:
        """Counts up by one, or sets the counter to 0."""
        n = 0 if reset else int(self.store_.meta("hook_counter") or 0) + 1
        self.store_.meta("hook_counter", str(n))
        return n

    def enqueue(self, project: str, tool_name: str, raw_output: str) -> int:
        """Puts a tool's output on the queue of texts to extract from."""
        row = self.spark.createDataFrame([(str(uuid.uuid4()), project, tool_name, raw_output)], "id string, project string, tool_name string, raw_output string")
        return self.store_.append("pending", row.withColumn("captured_at", self._now()))

    def on_prompt(self, session_id: str, agent: str, project: str, text: str, limit: int = 5) -> DataFrame:
        """Archives a user's turn and gives what is known on it: its first 200 bytes are the query."""
        self.record_messages(session_id, agent, project, [("user", text)])
        head = text.encode()[:200].decode(errors="ignore")
        return search.fallback_tiers(self.memories, head, project, limit)

    def on_session_end(self, project: str, limit: int = 100) -> int:
        """Extracts facts from the oldest queued texts of a project and takes them off the queue; returns how many."""
        queue = keep(records.oldest_pending(lookup.by_key(self.store_.table("pending"), project=project), limit), "drained")
        n = queue.count()
        if n:
            self.extract(queue.select("id", F.col("raw_output").alias("summary")), project)
            self.store_.mutate("pending", lambda q: lifecycle.delete_rows(q, queue.select("id")))
        return n

    # --- exchange -------------------------------------------------------------

    def push(self, folder: str, topics: list[str] | None = None) -> int:
        """Writes memories (of some topics) to a folder that other stores can pull from; returns how many."""
        rows = self.memories.filter(F.col("topic").isin(topics)) if topics else self.memories
        rows = keep(rows, "pushed")
        rows.write.mode("append").parquet(f"{folder.rstrip('/')}/memories")
        return rows.count()

    def pull(self, folder: str) -> int:
        """Memories of a folder replace those of their id and add the others; of several pushes of one id the last change counts."""
        got = self.spark.read.schema(self.memories.schema).parquet(f"{folder.rstrip('/')}/memories")
        newest = got.groupBy("id").agg(F.max_by(F.struct(*got.columns), "updated_at").alias("r")).select("r.*")
        dims = self.store_.state["dims"]
        fit = newest.withColumn("embedding", F.when(vectors.has_dims(F.col("embedding"), dims), F.col("embedding")))
        return self.store_.write("memories", lifecycle.upsert(self.memories, keep(fit, "pulled")))

    def nearest(self, vector: list[float], limit: int = 10) -> DataFrame:
        return search.knn(self.memories, vector, limit)

    def importance_counts(self) -> DataFrame:
        return self.memories.groupBy("importance", importance_rank(F.col("importance")).alias("rank")).agg(F.count("*").alias("n")).orderBy(F.desc("rank"))
