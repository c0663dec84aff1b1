"""Predicates and CASE expressions on topics, importance and scores (Column in, Column out)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstore.schemas import IMPORTANCE

SEGMENT = "[-._/:]"


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return any_of([F.contains(text, F.lit(w)) for w in words])


def importance_rank(c: Column) -> Column:
    """critical 4, high 3, medium 2, low 1; anything else counts as medium."""
    out = F.lit(2)
    for rank, name in enumerate(IMPORTANCE, 1):
        out = F.when(c == name, F.lit(rank)).otherwise(out)
    return out


def importance_of_rank(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in IMPORTANCE]), rank.cast("int"))


def cap_importance(c: Column, cap: str) -> Column:
    return importance_of_rank(F.least(importance_rank(c), F.lit(IMPORTANCE.index(cap) + 1)))


def max_importance(a: Column, b: Column) -> Column:
    return importance_of_rank(F.greatest(importance_rank(a), importance_rank(b)))


def is_preference_topic(topic: Column) -> Column:
    t = F.lower(topic)
    return t.isin("preferences", "identity") | t.contains("preference") | any_of([t.startswith(p) for p in ("preferences-", "preferences.", "user-", "user.")])


def topic_matches(topic: Column, wanted: str) -> Column:
    """Substring either way, whatever the case."""
    t, w = F.lower(topic), wanted.lower()
    return t.contains(w) | (F.instr(F.lit(w), t) > 0)


def keyword_matches(keywords: Column, wanted: str) -> Column:
    return F.exists(keywords, lambda k: k.contains(wanted))


def segments(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), SEGMENT), lambda s: s != "")


def project_matches(topic: Column, project: str | None) -> Column:
    """All segments of the project stand among the topic's; preferences match any project."""
    if not project:
        return F.lit(True)
    return is_preference_topic(topic) | (F.size(F.array_except(segments(F.lit(project)), segments(topic))) == 0)


def snapshot_relevant(topic: Column, project: str | None) -> Column:
    pref = is_preference_topic(topic)
    if not project:
        return pref
    t, p = F.lower(topic), project.lower()
    return pref | t.isin(p, f"contexte-{p}", f"context-{p}") | t.startswith(f"contexte-{p}-") | t.startswith(f"context-{p}-")


def category(topic: Column, summary: Column) -> Column:
    t, s = F.lower(topic), F.lower(summary)
    return (
        F.when(is_preference_topic(topic), "identity")
        .when(t.contains("decision") | contains_any(s, ("decided ", "chose ")), "decision")
        .when(contains_any(t, ("constraint", "rule", "convention")) | any_of([s.startswith(p) for p in ("always ", "never ", "must ")]), "constraint")
        .when(contains_any(t, ("error", "bug")) | s.startswith("fixed "), "error")
        .when(contains_any(t, ("milestone", "release")) | s.contains("shipped"), "milestone")
        .otherwise("context")
    )


# Labels of a topic's health, and colours of confidence.
ATTENTION, CONSOLIDATE, STALE, HEALTHY = "!! NEEDS ATTENTION", "!  consolidate", "-  has stale entries", "ok healthy"
COLOURS = ((0.8, "#4CAF50"), (0.5, "#FFC107"), (0.3, "#FF9800"), (float("-inf"), "#F44336"))


def health_status(needs_consolidation: Column, stale: Column) -> Column:
    return F.when(needs_consolidation & (stale > 0), ATTENTION).when(needs_consolidation, CONSOLIDATE).when(stale > 0, STALE).otherwise(HEALTHY)


def confidence_colour(c: Column) -> Column:
    (a, x), (b, y), (d, z), (_, rest) = COLOURS
    return F.when(c >= a, x).when(c >= b, y).when(c >= d, z).otherwise(rest)


def confidence_bar(c: Column) -> Column:
    n = F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 5).cast("int")
    return F.concat(F.repeat(F.lit("#"), n), F.repeat(F.lit("."), 5 - n))


def requires_cloud(scope: Column) -> Column:
    return scope != "user"


def parse_label(c: Column) -> Column:
    """'ns:value', or 'value' under the namespace 'tag'."""
    i = F.instr(c, ":")
    return F.struct(F.when(i > 0, F.substr(c, F.lit(1), i - 1)).otherwise("tag").alias("namespace"), F.when(i > 0, F.substr(c, i + 1)).otherwise(c).alias("value"))


def format_labels(labels: Column) -> Column:
    return F.array_join(F.transform(labels, lambda x: F.concat(x["namespace"], F.lit(":"), x["value"])), ", ")


def parse_relation(c: Column) -> Column:
    """The nine relations, written with or without underscores; null for anything else."""
    from loomstore.schemas import RELATIONS

    key = F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit(""))
    out = F.lit(None).cast("string")
    for r in RELATIONS:
        out = F.when(key == r.replace("_", ""), F.lit(r)).otherwise(out)
    return out


def parse_importance(c: Column) -> Column:
    """Strict: medium for null or empty, an error for an unknown word."""
    t = F.lower(F.trim(c))
    return F.when(c.isNull() | (t == ""), "medium").when(t.isin(*IMPORTANCE), t).otherwise(F.raise_error(F.concat(F.lit("unknown importance: "), c)))


def parse_keywords(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
