"""Facts, transcripts, feedback and telemetry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstore.functions.text import TOKEN, tokens
from loomstore.operators.search import bm25

# --- facts -----------------------------------------------------------------


def fact_versions(log: DataFrame, seq: str = "seq") -> DataFrame:
    """All versions of (entity, key): assertions of the value that already holds are no-ops; ``superseded`` is the next version's seq."""
    w = Window.partitionBy("entity", "key").orderBy(seq)
    changed = log.withColumn("_prev", F.lag("value").over(w)).withColumn("_first", F.row_number().over(w) == 1).filter(F.col("_first") | ~F.col("value").eqNullSafe(F.col("_prev")))
    return changed.select("entity", "key", "value", seq, F.lead(seq).over(w).alias("superseded"))


def current_facts(versions: DataFrame) -> DataFrame:
    return versions.filter("superseded is null")


def list_facts(versions: DataFrame, entity, key_prefix: str = "") -> DataFrame:
    return current_facts(versions).filter((F.col("entity") == entity) & F.startswith("key", F.lit(key_prefix))).orderBy("key")


def fact_history(versions: DataFrame, entity, key: str, seq: str = "seq") -> DataFrame:
    return versions.filter((F.col("entity") == entity) & (F.col("key") == key)).orderBy(F.desc(seq))


def fact_stats(versions: DataFrame) -> DataFrame:
    return versions.agg(F.count_if(F.col("superseded").isNull()).alias("active"), F.count("*").alias("total"), F.count_distinct("entity").alias("entities"))


def top_entities(versions: DataFrame, k: int = 10) -> DataFrame:
    return current_facts(versions).groupBy("entity").agg(F.count("*").alias("facts")).orderBy(F.desc("facts"), "entity").limit(k)


def forget_fact(versions: DataFrame, entity, key: str) -> DataFrame:
    return versions.filter(~((F.col("entity") == entity) & (F.col("key") == key)))


# --- transcripts -----------------------------------------------------------


class Node:
    """A parsed query: kind 'term', 'phrase', 'prefix', 'near', 'and', 'or', 'not'."""

    def __init__(self, kind: str, parts=(), column: str | None = None, distance: int = 10):
        self.kind, self.parts, self.column, self.distance = kind, list(parts), column, distance

    def words(self) -> list[str]:
        """Positive terms, for the score."""
        if self.kind in ("term", "phrase", "near"):
            return [w for p in self.parts for w in (p if isinstance(p, list) else [p])]
        if self.kind == "prefix":
            return []
        return [w for p in (self.parts[:1] if self.kind == "not" else self.parts) for w in p.words()]


def parse_query(query: str) -> Node:
    """The boolean grammar: a AND b, a OR b, a NOT b, "phrase", pre*, NEAR(a b, n), column:word, ( ); side by side means AND."""
    import regex

    lexer = regex.compile(r'\s*(?:(NEAR)\(([^)]*)\)|(\(|\))|"([^"]*)"(\*?)|([\p{L}\p{N}_]+)(\s*:)?(\*)?|(\S))')
    toks, at = [], 0
    while at < len(query.rstrip()):
        m = lexer.match(query, at)
        at = m.end()
        if m[1]:
            body, _, d = m[2].partition(",")
            toks.append(("near", regex.findall(TOKEN, body.lower()), int(d) if d.strip() else 10))
        elif m[3]:
            toks.append((m[3],))
        elif m[4] is not None:
            toks.append(("phrase", regex.findall(TOKEN, m[4].lower())))
        elif m[6]:
            if m[7]:
                toks.append(("column", m[6].lower()))
            elif m[6] in ("AND", "OR", "NOT") and not m[8]:
                toks.append((m[6],))
            else:
                toks.append(("prefix" if m[8] else "word", regex.findall(TOKEN, m[6].lower())))
        else:
            raise ValueError(f"can't read the query at {m[9]!r}")
    pos = 0

    def peek() -> str:
        return toks[pos][0] if pos < len(toks) else ""

    def take():
        nonlocal pos
        pos += 1
        return toks[pos - 1]

    def atom(column: str | None = None) -> Node:
        if not peek() or peek() in ("AND", "OR", "NOT", ")"):
            raise ValueError("a word is missing in the query")
        t = take()
        if t[0] == "column":
            return atom(t[1])
        if t[0] == "(":
            n = either(column)
            if peek() != ")":
                raise ValueError("a bracket isn't closed")
            take()
            return n
        if t[0] == "near":
            return Node("near", t[1], column, t[2])
        if t[0] == "prefix":
            return Node("prefix", t[1], column)
        return Node("phrase" if len(t[1]) > 1 else "term", [t[1]] if len(t[1]) > 1 else t[1], column)

    def unless(column) -> Node:
        n = atom(column)
        while peek() == "NOT":
            take()
            n = Node("not", [n, atom(column)])
        return n

    def both(column) -> Node:
        parts = [unless(column)]
        while peek() and peek() not in ("OR", ")"):
            if peek() == "AND":
                take()
            parts.append(unless(column))
        return parts[0] if len(parts) == 1 else Node("and", parts)

    def either(column) -> Node:
        parts = [both(column)]
        while peek() == "OR":
            take()
            parts.append(both(column))
        return parts[0] if len(parts) == 1 else Node("or", parts)

    n = either(None)
    if pos < len(toks):
        raise ValueError("a bracket was never opened")
    return n


def matches(node: Node, columns: dict[str, Column]) -> Column:
    """A boolean Column over token arrays: no postings, no joins, one pass of each row's tokens."""
    if node.kind in ("and", "or"):
        f = (lambda a, b: a & b) if node.kind == "and" else (lambda a, b: a | b)
        return reduce(f, [matches(p, columns) for p in node.parts])
    if node.kind == "not":
        return matches(node.parts[0], columns) & ~matches(node.parts[1], columns)
    some = [columns[node.column]] if node.column else list(columns.values())

    def one(toks: Column) -> Column:
        if node.kind == "term":
            return F.array_contains(toks, node.parts[0])
        if node.kind == "prefix":
            return F.exists(toks, lambda t: F.startswith(t, F.lit(node.parts[-1])))
        if node.kind == "phrase":
            words = node.parts[0]
            return F.contains(F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" ")), F.lit(f" {' '.join(words)} "))
        first, rest = node.parts[0], node.parts[1:]
        at = F.filter(F.transform(toks, lambda t, i: F.when(t == first, i)), lambda i: i.isNotNull())
        near = lambda i: reduce(lambda a, b: a & b, [F.array_contains(F.slice(toks, F.greatest(i - node.distance, F.lit(1)), i + node.distance + 3 - F.greatest(i - node.distance, F.lit(1))), w) for w in rest], F.lit(True))
        return F.exists(at, near)

    return reduce(lambda a, b: a | b, [one(c) for c in some])


def search_transcripts(messages: DataFrame, sessions: DataFrame, query: str, session_id=None, project: str | None = None, limit: int = 20) -> DataFrame:
    """(id, session_id, project, score): the raw grammar over role, content and tool name, ranked by BM25 over all messages."""
    node = parse_query(query)
    cols = tuple(c for c in ("role", "content", "tool_name") if c in messages.columns)
    toks = messages.select("id", *[tokens(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in cols])
    hits = toks.filter(matches(node, {c: F.col(c) for c in cols})).select("id")
    words = list(dict.fromkeys(node.words()))
    scored = hits.join(bm25(messages, words, cols), "id", "left") if words else hits.withColumn("score", F.lit(0.0))
    rows = scored.join(messages.select("id", "session_id"), "id").join(sessions.select(F.col("id").alias("session_id"), F.col("project")), "session_id")
    rows = rows.filter(F.col("session_id") == session_id) if session_id is not None else rows
    rows = rows.filter(F.col("project") == project) if project else rows
    return rows.select("id", "session_id", "project", F.coalesce("score", F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def session_page(messages: DataFrame, session_id, limit: int = 50, offset: int = 0) -> DataFrame:
    return messages.filter(F.col("session_id") == session_id).orderBy("ts", "id").offset(offset).limit(limit)


def transcript_stats(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """(metric, name, value): totals, by role, by agent, and the ten longest sessions."""
    total = messages.agg(F.count("*").alias("messages"), F.count_distinct("session_id").alias("sessions"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("chars"))
    flat = total.select(F.explode(F.array(*[F.struct(F.lit("total").alias("metric"), F.lit(n).alias("name"), F.col(n).cast("long").alias("value")) for n in ("messages", "sessions", "chars")])).alias("x")).select("x.*")
    role = messages.groupBy("role").agg(F.count("*").alias("value")).select(F.lit("role").alias("metric"), F.col("role").alias("name"), "value")
    agent = sessions.groupBy("agent").agg(F.count("*").alias("value")).select(F.lit("agent").alias("metric"), F.col("agent").alias("name"), "value")
    top = messages.groupBy("session_id").agg(F.count("*").alias("value")).orderBy(F.desc("value"), "session_id").limit(10).select(F.lit("session").alias("metric"), F.col("session_id").cast("string").alias("name"), "value")
    return flat.unionByName(role).unionByName(agent).unionByName(top)


def bump_sessions(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    last = messages.groupBy("session_id").agg(F.max("ts").alias("_last"))
    return sessions.join(last, sessions["id"] == last["session_id"], "left").withColumn("updated_at", F.greatest("updated_at", "_last")).drop("_last", "session_id")


def ensure_sessions(sessions: DataFrame, new: DataFrame) -> DataFrame:
    return sessions.unionByName(new.dropDuplicates(["id"]).join(sessions, "id", "left_anti"), allowMissingColumns=True)


def forget_session(sessions: DataFrame, messages: DataFrame, session_id) -> tuple[DataFrame, DataFrame]:
    return sessions.filter(F.col("id") != session_id), messages.filter(F.col("session_id") != session_id)


# --- feedback --------------------------------------------------------------


def search_feedback(feedback: DataFrame, query: str, topic: str | None = None, limit: int = 20, cols: tuple[str, ...] = ("topic", "context", "predicted", "corrected")) -> DataFrame:
    from loomstore.operators.search import match_all

    rows = match_all(feedback, query, cols) if query.strip() else feedback
    rows = rows.filter(F.col("topic") == topic) if topic else rows
    return rows.orderBy(F.desc("id")).limit(limit)


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """(metric, name, value): total, by topic, and the ten most applied."""
    total = feedback.agg(F.count("*").alias("value")).select(F.lit("total").alias("metric"), F.lit("all").alias("name"), "value")
    topic = feedback.groupBy("topic").agg(F.count("*").alias("value")).select(F.lit("topic").alias("metric"), F.col("topic").alias("name"), "value")
    top = feedback.filter("applied_count > 0").orderBy(F.desc("applied_count"), "id").limit(10).select(F.lit("applied").alias("metric"), F.col("id").cast("string").alias("name"), F.col("applied_count").alias("value"))
    return total.unionByName(topic).unionByName(top)


def record_feedback(feedback: DataFrame, new: DataFrame) -> DataFrame:
    """With new rows, not applied yet."""
    return feedback.unionByName(new.withColumn("applied_count", F.lit(0).cast("long")), allowMissingColumns=True)


def increment_applied(feedback: DataFrame, ids: DataFrame) -> DataFrame:
    """One more for each time that an id is named."""
    times = ids.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("_n"))
    return feedback.join(times, F.col("id") == F.col("_id"), "left").withColumn("applied_count", F.col("applied_count") + F.coalesce("_n", F.lit(0))).drop("_id", "_n")


def delete_feedback(feedback: DataFrame, ids: DataFrame) -> DataFrame:
    return feedback.join(ids.select("id").distinct(), "id", "left_anti")


# --- telemetry -------------------------------------------------------------


def hook_stats(events: DataFrame, mode: str = "nearest") -> DataFrame:
    """event, n, errors, avg_ms, p50, p99. Nearest rank round((n - 1) * q) from a ranking (no lists), interpolated, or approximate."""
    base = events.groupBy("event").agg(F.count("*").alias("n"), F.count_if(F.col("exit_code") != 0).alias("errors"), F.avg("duration_ms").alias("avg_ms"), *([] if mode == "nearest" else [(F.percentile if mode == "interpolated" else F.percentile_approx)("duration_ms", F.lit(q)).cast("long").alias(f"p{round(q * 100)}") for q in (0.5, 0.99)]))
    if mode != "nearest":
        return base
    # equal durations are counted before they are ranked: a running sum over distinct values finds the ranks
    vals = events.groupBy("event", "duration_ms").agg(F.count("*").alias("c"))
    w = Window.partitionBy("event").orderBy("duration_ms").rowsBetween(Window.unboundedPreceding, 0)
    cum = vals.withColumn("upto", F.sum("c").over(w)).join(base.select("event", "n"), "event")
    rank = lambda q: F.floor((F.col("n") - 1) * q + 0.5) + 1
    ps = cum.groupBy("event").agg(*[F.min(F.when(F.col("upto") >= rank(q), F.col("duration_ms"))).alias(f"p{round(q * 100)}") for q in (0.5, 0.99)])
    return base.join(ps, "event")


#: Size of the quantile sketches (KLL), and what the rank of a percentile from them may be off by. At this size the 99 % error of one
#: sketch is 0.4 %, and merging keeps it, so the stated bound has room.
SKETCH_K, RANK_ERROR = 800, 0.0165


def sketch_hours(events: DataFrame) -> DataFrame:
    """One row an event and hour: (event, hour, n, errors, total_ms, sketch). Rows without a time are left out; null durations count in n only."""
    return (
        events.filter("ts is not null")
        .groupBy("event", F.date_trunc("hour", "ts").alias("hour"))
        .agg(F.count("*").alias("n"), F.count_if(F.col("exit_code") != 0).alias("errors"), F.count("duration_ms").alias("timed"), F.sum("duration_ms").alias("total_ms"), F.kll_sketch_agg_bigint("duration_ms", SKETCH_K).alias("sketch"))
    )


def merge_sketches(hours: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """event, n, errors, avg_ms, p50, p90, p99 over the hours from ``since`` and before ``until``, whatever order they are merged in."""
    some = hours if since is None else hours.filter(F.col("hour") >= since)
    some = some if until is None else some.filter(F.col("hour") < until)
    merged = some.groupBy("event").agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"), (F.sum("total_ms") / F.sum("timed")).alias("avg_ms"), F.sum("timed").alias("timed"), F.kll_merge_agg_bigint("sketch", SKETCH_K).alias("s"))
    at = lambda q: F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_bigint("s", F.lit(q)))
    return merged.select("event", "n", "errors", "avg_ms", *[at(q).alias(f"p{round(q * 100)}") for q in (0.5, 0.9, 0.99)])


def number_events(new: DataFrame, last: int = 0, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """New events with ids that go on from the last one, in this order: places within sorted partitions, after the partitions' counts."""
    from loomstore.plans.shared import keep

    rows = keep(new.drop("id").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_k", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_k", 33)
    sizes = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_before", F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))  # a row a partition
    numbered = rows.withColumn("_p", part).join(F.broadcast(before), "_p")
    return numbered.withColumn("id", F.coalesce("_before", F.lit(0)) + F.col("_k").bitwiseAND((1 << 33) - 1) + 1 + last).drop("_p", "_k", "_c", "_before")


def prune_events(events: DataFrame, cutoff) -> DataFrame:
    """Without the events before the cutoff."""
    return events.filter(F.col("ts") >= cutoff)


def recent_events(events: DataFrame, limit: int, event: str | None = None) -> DataFrame:
    rows = events.filter(F.col("event") == event) if event else events
    return rows.orderBy(F.desc("id")).limit(limit)


def code_areas(touches: DataFrame) -> DataFrame:
    """project, file_path, touch_count, first and last touch, tool_name (the last one given)."""
    return touches.groupBy("project", "file_path").agg(F.count("*").alias("touch_count"), F.min("ts").alias("first_touched"), F.max("ts").alias("last_touched"), F.max_by("tool_name", F.when(F.col("tool_name").isNotNull(), F.col("seq"))).alias("tool_name"))


def list_code_areas(areas: DataFrame, project=None, in_file: str | None = None, since=None, limit: int = 50, anywhere: bool = False) -> DataFrame:
    rows = areas.filter(F.col("project") == project) if project is not None else areas
    if in_file:
        rows = rows.filter(F.contains("file_path", F.lit(in_file)) if anywhere else (F.col("file_path") == in_file) | F.endswith("file_path", F.lit("/" + in_file)))
    rows = rows.filter(F.col("last_touched") >= since) if since is not None else rows
    return rows.orderBy(F.desc("last_touched"), "project", "file_path").limit(limit)


def oldest_pending(queue: DataFrame, limit: int) -> DataFrame:
    return queue.orderBy("captured_at", "id").limit(limit)


def nudges(calls: DataFrame, every: int = 10) -> DataFrame:
    """Calls with ``since_store``, the calls since the session's last store, and ``nudge`` from ``every`` on."""
    w = Window.partitionBy("session_id").orderBy("id")
    grouped = calls.withColumn("_g", F.sum(F.when(F.col("is_store"), 1).otherwise(0)).over(w))
    since = F.sum(F.when(F.col("is_store"), 0).otherwise(1)).over(Window.partitionBy("session_id", "_g").orderBy("id"))
    return grouped.withColumn("since_store", since).withColumn("nudge", F.col("since_store") >= every).drop("_g")


def cadence(calls: DataFrame, every: int) -> DataFrame:
    """Every nth call of a session."""
    return calls.withColumn("_n", F.row_number().over(Window.partitionBy("session_id").orderBy("id"))).filter(F.col("_n") % every == 0).drop("_n")
