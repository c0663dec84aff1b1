"""Exact dedup, SimHash and decontamination against brute force."""

import brute
import numpy as np
import pytest
from brute import DOCS
from pyspark.sql import functions as F

from loomstore.llm import decontaminate, exact_dedup, queries, simhash


@pytest.mark.parametrize("side", ["smallest", "largest"])
def test_exact_groups(docs, side):
    got = {r[0]: tuple(r)[1:] for r in exact_dedup.exact_dedup(docs, keep_id=side, memtable_rows=2, salt_rows=1).collect()}
    assert got == brute.exact_groups(DOCS, min if side == "smallest" else max)


def test_exact_collisions_are_told_apart(docs):
    """With a constant digest all rows collide; the byte check has to sort it out."""
    got = {r[0]: tuple(r)[1:4] for r in exact_dedup.exact_dedup(docs, keep_id="largest", digest=F.lit("x"), salt_rows=2).collect()}
    assert got == {i: v[:3] for i, v in brute.exact_groups(DOCS).items()}


def test_exact_empty_and_null_ids(spark, empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    df = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted((r.doc_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect()) == [(1, 2, True), (1, 2, True)]


def test_index_runs_and_lookup(spark, docs):
    index = exact_dedup.ExactIndex(spark, keep_id="smallest", memtable_rows=2)
    keyed = docs.select(F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    index.flush(keyed.filter("id <= 6"))
    index.flush(keyed.filter("id > 6"))
    first = index.compact().count()
    some = keyed.filter("id = 4").first().digest
    assert index.lookup([some]).first().keep_id == 3
    index.flush(keyed.filter("id = 4").withColumn("id", F.lit(2).cast("long")))
    assert index.compact().count() == first
    assert index.lookup([some]).first().asDict() == {"digest": some, "keep_id": 2, "n": 3}


def test_simhash_contract(docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = {i: brute.simhash_fp(t) for i, t in DOCS}
    assert {i: v[0] for i, v in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    comp = brute.components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert {i: v[1] for i, v in got.items()} == comp


@pytest.mark.parametrize("block", [3, 50, 100_000])
def test_links_connect_what_brute_force_connects(spark, block):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base:  # chains and clusters of near fingerprints
        x = int(b)
        for _ in range(25):
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    from loomstore.operators.components import connected_components

    comp = {r.id: r.component for r in connected_components(simhash.fingerprint_links(df, 4, block)).collect()}
    want = brute.components(list(range(len(fps))), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    groups = lambda of: sorted(sorted(k for k in of if of[k] == v) for v in set(of.values()))
    got = {i: comp.get(signed[i], signed[i]) for i in range(len(fps))}
    assert groups(got) == groups(want)


def test_simhash_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0


def test_segments_leave_one_with_at_most_one_bit():
    for d in range(2, 9):
        cuts = simhash.segments(d)
        assert sum(w for _, w in cuts) == 64 and 2 * len(cuts) > d


ITEM = "A train leaves Paris at 5 km per hour and meets Anna after 7 hours near the old bridge in Lyon"


def test_reparameterised_and_inconsistent_items(spark):
    docs = spark.createDataFrame(
        [
            (1, "Intro text. " + ITEM + ". More."),
            (2, "Hello. A train leaves Berlin at 9 km per hour and meets Maria after 3 hours near the old bridge in Bonn."),
            (3, "Clean words about trains and bridges in the old town, with nothing else to see."),
            (4, None),
            (5, ""),
            (6, ITEM.upper()),
        ],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame([(7, ITEM), (8, "too short"), (9, None)], "item_id long, text string")
    for limit in (3, 500_000):
        got = sorted((r.doc_id, r.item_id, r.kind) for r in decontaminate.find_leaks(docs, bench, block_windows=limit).collect())
        assert got[:2] == [(1, 7, "exact"), (2, 7, "re-parameterised")]
        assert {g[0] for g in got} <= {1, 2, 6}
    twice = "Tom gives 3 apples to Ann and then 3 more apples to Ann before the long walk home"
    mixed = "x. Tom gives 4 apples to Ann and then 5 more apples to Ann before the long walk home"
    t = decontaminate.ItemTable([(1, "so it is that " + twice)], 8, 5)
    assert t.hits("so it is that " + twice, 8, 0.5)[0][1] == "exact"
    assert t.hits("so it is that " + mixed[3:], 8, 0.9) == []


def leak(item, text, coverage=0.5):
    return [(h[1], h[2], h[3]) for h in decontaminate.ItemTable([(1, item)], 8, 5).hits(text, 8, coverage)]


def test_names_at_sentence_starts_and_in_other_case():
    short = "Tom has 3 apples. Tom gives 2 to Ann."
    assert leak(short, short) == [("exact", 9, 9)]
    assert leak(short, "Eva has 5 apples. Eva gives 4 to Lea.") == [("re-parameterised", 9, 9)]
    assert leak(short, "Words before. Eva has 5 apples. Eva gives 4 to Lea. And after") == [("re-parameterised", 9, 9)]
    for other in (ITEM.upper(), ITEM.lower(), ITEM.title()):
        assert leak(ITEM, "so " + other) == [("exact", 21, 21)] or other.istitle() and leak(ITEM, "so " + other)[0][1] > 10


def test_conflicting_and_coinciding_values():
    item = "the shop sells 5 red pens and the baker who lives next door buys 5 blue cups for his old aunt in the far village"
    assert leak(item, item.replace("5 blue", "8 blue")) == [("exact", 24, 25)]  # all but the changed value's own place
    assert leak(item, item.replace("5 red", "7 red").replace("5 blue", "9 blue"))[0][0] == "re-parameterised"
    item = "mix 3 cups of flour with 5 spoons of sugar then stir and wait"
    assert leak(item, item.replace("3", "4").replace("5", "4")) == [("re-parameterised", 14, 14)]
    item = "mix 5 cups of flour and some milk with 5 spoons of sugar"
    assert leak(item, item.replace("5 cups", "7 cups").replace("5 spoons", "9 spoons"))[0][0] == "re-parameterised"


def test_decontamination_against_brute_force(spark, sf):
    import re

    rows = queries.op4_decontaminate(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    flat = lambda t: " " + " ".join(re.findall(r"[^\W\d_]+", t.lower())) + " "
    want = {(d.doc_id, b.item_id) for d in docs for b in items if flat(b.text) in flat(d.text)}
    assert want <= {(r.doc_id, r.item_id) for r in rows}
    assert len(rows) <= len(want) + 1


def test_decontamination_empty(docs, empty, spark):
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs, bench).count() == 0
