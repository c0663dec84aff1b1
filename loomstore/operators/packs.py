"""Context packs under a budget: wake-up, snapshot, session start. Budgets are running sums in windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstore.functions.predicates import category, importance_rank, is_preference_topic, project_matches, snapshot_relevant
from loomstore.functions.text import cap_chars, flatten

CATEGORIES = ("identity", "decision", "constraint", "error", "milestone", "context")
TITLE = "Memory wake-up"


def wake_up_score(now: Column) -> Column:
    """Importance times recency times weight; recency halves after 30 days since the last access."""
    weight = F.when(F.col("importance") == "critical", 10.0).when(F.col("importance") == "high", 5.0).when(F.col("importance") == "low", 0.5).otherwise(2.0)
    days = F.greatest(F.floor((F.unix_seconds(now) - F.unix_seconds(F.greatest("created_at", "last_accessed"))) / 86400), F.lit(0))
    return weight * (1 / (1 + days / 30)) * F.greatest("weight", F.lit(0.01))


def most_rows(max_chars: int) -> int:
    """No pack holds more rows: a line costs at least 5 characters."""
    return max_chars // 5 + 1


def wake_up(df: DataFrame, now: Column, max_tokens: int = 200, project: str | None = None, preferences: bool = True) -> DataFrame:
    """(id, topic, category, score, line, cum): the rows of the pack, by score.

    Only the best ``most_rows`` rows can fit, so the running sum sees a top-k result and not the table.
    """
    max_chars = max_tokens * 4
    eligible = F.col("importance").isin("critical", "high")
    if preferences:
        eligible = eligible | is_preference_topic(F.col("topic"))
    rows = df.filter(eligible & project_matches(F.col("topic"), project)).select("id", "topic", "summary", category(F.col("topic"), F.col("summary")).alias("category"), wake_up_score(now).alias("score"))
    top = rows.orderBy(F.desc("score"), "id").limit(most_rows(max_chars)).withColumn("line", cap_chars(F.col("summary"), max(max_chars // 2, 200))).drop("summary")
    w = Window.orderBy(F.desc("score"), "id")
    summed = top.withColumn("cum", F.sum(F.length("line") + 4).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rn", F.row_number().over(w))
    return summed.filter((F.col("cum") <= max_chars) | (F.col("rn") == 1)).drop("rn")


def render_wake_up(pack: DataFrame, project: str | None = None, markdown: bool = True) -> str:
    rows = pack.select("id", "category", "score", flatten(F.col("line")).alias("line")).collect()  # bounded by the budget
    if not rows:
        return f"# {TITLE} (empty)\n\n(no critical memories yet)\n"
    out = [f"# {TITLE}" + (f" (project: {project})" if project else "") + "\n\n"] if markdown else []
    for c in CATEGORIES:
        group = sorted((r for r in rows if r.category == c), key=lambda r: (-r.score, r.id))
        if group:
            out.append(f"## {c.capitalize()}\n" if markdown else f"[{c.capitalize()}]\n")
            out += [f"- {r.line}\n" for r in group] + ["\n"]
    return "".join(out).rstrip("\n") + "\n"


def snapshot(df: DataFrame, max_tokens: int, project: str | None = None) -> DataFrame:
    """(id, section, line, cum): preferences first, then the project's context, both in order of importance and
    falling id, under one budget that is hard but for the very first line."""
    max_chars = max_tokens * 4
    section = F.when(is_preference_topic(F.col("topic")), 1).otherwise(2)
    rows = df.filter(snapshot_relevant(F.col("topic"), project)).select("id", section.alias("section"), importance_rank(F.col("importance")).alias("rank"), cap_chars(flatten(F.col("summary")), max(max_chars // 2, 200)).alias("line"))
    order = [F.desc("rank"), F.desc("id")]
    n = most_rows(max_chars)
    firsts = rows.filter("section = 1").orderBy(*order).limit(n).unionByName(rows.filter("section = 2").orderBy(*order).limit(n))
    w = Window.partitionBy("section").orderBy(*order)  # two sections of at most n rows
    own = firsts.withColumn("own", F.sum(F.length("line") + 4).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rn", F.row_number().over(w))
    one = own.filter((F.col("section") == 1) & ((F.col("own") <= max_chars) | (F.col("rn") == 1)))
    used = one.agg(F.coalesce(F.max("own"), F.lit(0)).alias("used"))
    both = own.crossJoin(F.broadcast(used)).withColumn("cum", F.when(F.col("section") == 2, F.col("used") + F.col("own")).otherwise(F.col("own")))
    fits = (F.col("cum") <= max_chars) | ((F.col("rn") == 1) & ((F.col("section") == 1) | (F.col("used") == 0)))
    return both.filter(fits).select("id", "section", "line", "cum")


def snapshot_summary(df: DataFrame, max_tokens: int, project: str | None = None) -> DataFrame:
    """One row: kept, dropped, used, over_budget (something was dropped and four fifths are used)."""
    max_chars = max_tokens * 4
    eligible = df.filter(snapshot_relevant(F.col("topic"), project)).agg(F.count("*").alias("eligible"))
    kept = snapshot(df, max_tokens, project).agg(F.count("*").alias("kept"), F.coalesce(F.max("cum"), F.lit(0)).alias("used"))
    return kept.crossJoin(eligible).select("kept", (F.col("eligible") - F.col("kept")).alias("dropped"), "used", ((F.col("eligible") > F.col("kept")) & (F.col("used") * 10 >= max_chars * 8)).alias("over_budget"))


def render_snapshot(df: DataFrame, max_tokens: int, project: str | None = None) -> str:
    rows = sorted(snapshot(df, max_tokens, project).collect(), key=lambda r: (r.section, r.cum))
    if not rows:
        return ""
    out = ["# Context Snapshot\n\n"]
    for n, title in ((1, "Identity & preferences"), (2, "Project context")):
        lines = [f"- {r.line}\n" for r in rows if r.section == n]
        out += [f"## {title}\n", *lines, "\n"] if lines else []
    s = snapshot_summary(df, max_tokens, project).first()
    if s.over_budget:
        out.append(f"> snapshot at {s.used}/{max_tokens * 4} chars with {s.dropped} entries dropped\n")
    return "".join(out)


def session_start(df: DataFrame, now: Column, max_tokens: int, project: str | None = None) -> str:
    """Two fifths of the budget for the snapshot (80 at least), the rest for the wake-up pack (50 at least)."""
    snap = max(max_tokens * 2 // 5, 80)
    return render_snapshot(df, snap, project) + render_wake_up(wake_up(df, now, max(max_tokens - snap, 50), project), project)
