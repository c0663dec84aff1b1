"""What tasks hold and deal out at once, and that the results are those of a plain version."""

import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from __spark_entry__ import queries
from loomstore.functions.text import tokens
from loomstore.operators import extract, postings, search


def test_postings_are_dealt_out_once(spark):
    """terms are counted where the text is read; rows of one id are one."""
    rows = [(1, "a b a"), (2, ""), (3, None), (4, "B c, c; c"), (1, "a z"), (None, "a")] + [(k, f"w{k % 7} w{k % 3} w{k % 7}") for k in range(10, 1500)]
    words = spark.createDataFrame(rows, "id long, text string").coalesce(2).select("id", tokens(search.all_text(("text",))).alias("toks")).selectExpr("id", "size(toks) as dl", "toks")
    got = postings.rows_of(words)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Repartition") <= 2
    assert len(re.findall(r"Exchange hashpartitioning", got._jdf.queryExecution().executedPlan().toString())) == 1
    want = Counter((i, t) for i, text in rows for t in re.findall(r"\w+", (text or "").lower()))
    assert {(r.id, r.term): r.tf for r in got.collect()} == dict(want)


def test_websearch_reads_a_text_once(spark):
    """F16: the line of words is made once a row, not once a test."""
    texts = ["the end of the day", "The, of  THE! sand", "(of the) the and", "preferences: to", "to preferences", "", None, "bathe of the", "l'été of-the the", "the_of_the", "of\nthe"]
    df = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(texts)], "id long, summary string, weight double")
    query = 'the "of the" -and or preferences to'
    found = search.fts_websearch(df, query, 50, ("summary",))
    assert len(re.findall(r"regexp_\w+\(", found._jdf.queryExecution().optimizedPlan().toString())) == 1

    def fits(t):
        line = f" {' '.join(re.findall(r'[^\W_]+', (t or '').lower()))} "
        return " the " in line and " of the " in line and " and " not in line or " preferences " in line and " to " in line

    assert {r.id for r in found.collect()} == {k for k, t in enumerate(texts) if fits(t)}
    assert {r.id for r in df.filter(search.websearch(query, tokens(search.all_text(("summary",))))).collect()} == {k for k, t in enumerate(texts) if fits(t)}


def test_similarities_of_a_batch_are_bounded():
    """many queries and a whole Arrow batch; the similarities are made some queries at a time."""
    rng = np.random.default_rng(1)
    q, v = rng.integers(-3, 4, (1500, 4)).astype(float), rng.integers(-3, 4, (10_000, 4)).astype(float)
    queries = pa.table({"query_id": np.arange(1500), "q": pa.array(list(q))})
    batch = pa.record_batch({"id": np.arange(10_000), "embedding": pa.array(list(v))})
    run = search._best_of_batch(queries, 3)
    tracemalloc.start()
    best: dict = {}
    for b in run(iter([batch])):
        for i, j, s in zip(*(c.to_pylist() for c in b.columns)):
            if i < 20 or i > 1480:
                best.setdefault(i, []).append((-round(s, 9), j))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000  # all at once: 120 MB for each of several arrays
    sims = q @ v.T / np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :], 1e-10)
    for i, found in best.items():
        assert [j for _, j in sorted(found)[:3]] == np.lexsort((np.arange(10_000), -np.round(sims[i], 9)))[:3].tolist()


def test_sentences_come_in_small_batches(spark):
    """a batch of texts makes many of sentences."""
    texts = ["One. Two? Three", None, "", "Dr. No came.\n```\ncode. x\n```\nEnd"] * 500
    batch = pa.record_batch({"id": np.arange(2000), "summary": pa.array(texts)})
    out = list(extract._sentences(iter([batch])))
    assert max(b.num_rows for b in out) <= 3 * extract.TEXTS and len(out) == 2000 // extract.TEXTS
    want = [(k, n, s) for k, t in enumerate(texts) for n, s in enumerate(extract.sentences_of(t or ""))]
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == want
    df = spark.createDataFrame(list(enumerate(texts[:8])), "id long, summary string")
    assert sorted(tuple(r) for r in extract.split_sentences(df).collect()) == [w for w in want if w[0] < 8]


def test_no_row_holds_a_whole_topic(spark, monkeypatch):
    """digests of topics equal those of the joined rows: nulls, empty texts, equal weights, and pieces cut anywhere."""
    from loomstore.operators import lifecycle

    monkeypatch.setattr(lifecycle, "PIECE_BYTES", 500)
    text = F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 7 == 0, "").otherwise(F.concat(F.lit("é many words "), F.repeat(F.col("id").cast("string"), 30)))
    topic = F.when(F.col("id") % 50 == 1, None).when(F.col("id") == 2, "alone").when(F.col("id") == 11, "null").otherwise("large")
    rows = spark.range(1, 3000).select("id", topic.alias("topic"), text.alias("summary"), F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), (F.col("id") % 3 + 1).cast("int")).alias("importance"), (1.0 / (1 + F.col("id") % 5)).alias("weight"), F.array(F.lit("k")).alias("keywords"))
    rows = rows.repartition(7).unionByName(rows.filter("id % 9 = 0").withColumn("summary", F.concat("summary", F.lit("!"))))  # an id may stand twice
    made = lifecycle.consolidate_digests(rows)
    want = lifecycle.consolidate(rows).select("topic", "importance", "n", F.sha2("summary", 256), F.size("related_ids").cast("long"))
    assert sorted(map(tuple, made.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and want.count() == 4
    # no list of a topic's rows is made
    assert "collect_list" not in queries()["consolidate_topic"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
