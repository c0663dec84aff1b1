"""Context recall: against a plain loop, with ties, repetitions, long entries and the byte budget."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loomstore import store_queries
from loomstore.operators import blocks, context
from loomstore.queries import ORACLE_SQL


def plain(rows, words, limit, project):
    """(ids, text) by the loop: rows (id, topic, summary, weight)."""
    import re

    pref = lambda t: "preference" in t.lower() or t.lower() == "identity"
    of = lambda t: pref(t) or not project or project in re.split("[-._/:]", t.lower())
    order = sorted(rows, key=lambda r: (-r[3], r[0]))
    tokens = lambda r: set(re.findall(r"\w+", f"{r[1]} {r[2]}".lower()))
    hits = [r for r in order if words and words <= tokens(r)][: 4 * limit]
    pool = [r for r in hits if of(r[1])][:limit] or hits[:limit] or [r for r in order if pref(r[1])][:limit]
    kept = []
    for r in pool:
        w = set(r[2].split())
        if not any((len(w & k) / len(w | k) if w | k else 1) > 0.6 for k in (set(x[2].split()) for x in kept)):
            kept.append(r)
    text = context.HEAD
    for r in kept:
        line = "- " + (r[2][:400] + " […]" if len(r[2]) > 400 else r[2]) + "\n"
        if len(text.encode()) + len(line.encode()) > 4000:
            text += context.MORE
            break
        text += line
    return [r[0] for r in kept], text + context.TAIL if kept else ""


@pytest.mark.parametrize("limit, project", [(3, None), (20, "app"), (5, "none")])
def test_contexts_equal_the_loop(spark, tmp_path, limit, project):
    rng = random.Random(limit)
    base = [" ".join(rng.choice("red green blue fast slow rust go".split()) for _ in range(rng.choice([2, 5, 9]))) for _ in range(12)]
    rows = []
    for i in range(150):
        s = rng.choice(base) + rng.choice(["", " again", *["".join(f" é{i}u{j}" for j in range(90))] * 3])
        rows.append((i, rng.choice(["notes-app", "errors-resolved", "preferences", "notes-other"]), s, rng.choice([0.2, 0.5, 0.9])))
    m = spark.createDataFrame(rows, "id long, topic string, summary string, weight double")
    blocks.BlockIndex.add(m, str(tmp_path), 0, cols=("topic", "summary"))
    asked = {1: "red", 2: "rust go", 3: "nothing here", 4: "", 5: "red green blue fast", 6: "again"}
    q = spark.createDataFrame(list(asked.items()), "query_id int, text string")
    got = {r.query_id: (list(r.ids), r.text) for r in context.recall_context(m, q, blocks.BlockIndex(spark, str(tmp_path)), limit, project).collect()}
    assert got == {k: plain(rows, set(t.split()), limit, project) for k, t in asked.items()}
    assert all(len(t.encode()) <= 4000 + len(context.MORE.encode()) + len(context.TAIL) for _, t in got.values())
    if limit == 20:
        assert any(context.MORE in t for _, t in got.values())


def test_nothing_known(spark, tmp_path):
    m = spark.createDataFrame([], "id string, topic string, summary string, weight double")
    q = spark.createDataFrame([(1, "red")], "query_id int, text string")
    got = context.recall_context(m, q, blocks.BlockIndex(spark, str(tmp_path))).select("text", F.size("ids").alias("n")).collect()
    assert [(r.text, r.n) for r in got] == [("", 0)]


def test_heavier_rows_of_others_do_not_keep_the_projects_out(spark, tmp_path):
    """Documents with both words of the item, of which the lightest are the project's; two without a source have a rare word."""
    docs = [(i, f"alpha beta n{i} " + " ".join(f"u{i}x{j}" for j in range(5)), "src1" if i % 20 == 19 else "src2") for i in range(60) if i % 5 != 2]
    docs += [(64, "gamma delta one", None), (69, "gamma delta two", None), (100, "gamma delta epsilon three four", "src2"), (63, "zeta eta", None), (62, "liked words", "src2")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, "alpha beta"), (2, "gamma delta"), (3, "zeta eta"), (4, "nothing here")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = {r.query_id: (r.ids, r.text) for r in store_queries.context_of_items(spark, str(tmp_path)).collect()}
    assert got == {r[0]: r[1:] for r in con.execute(ORACLE_SQL["context_of_items"]).fetchall()}
    assert got[1][0] == "19,39,59" and got[4][0] == "62"
