"""Counts of changes, several tables by one pointer, and sketches of hook durations."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from loomstore.engine import MemoryEngine
from loomstore.operators import records
from loomstore.schemas import HOOK_EVENT
from loomstore.sources.snapshots import Snapshots


@pytest.fixture()
def engine(spark, tmp_path):
    return MemoryEngine(spark, str(tmp_path / "m"), 64)


def test_changes_return_exact_counts(spark, engine):
    assert engine.decay(0.9) == 0 and engine.forget(["none"]) == 0  # an empty store
    engine.store([{"topic": f"t{k % 3}", "summary": f"row {k}", "importance": "critical" if k == 0 else "low"} for k in range(12)])
    ids = {r.summary: r.id for r in engine.memories.collect()}
    assert engine.decay(0.5) == 11
    assert engine.update(spark.createDataFrame([(ids["row 1"], "new"), ("none", "x")], "id string, summary string")) == 1
    assert engine.forget([ids["row 2"], ids["row 2"], ids["row 3"], "none"]) == 2
    assert engine.forget_topic("t1") == 4 and engine.forget_topic("none") == 0
    left = engine.memories.count()
    n = engine.prune_below(0.5)
    assert n == 5 and engine.memories.count() == left - n == 1
    assert "_hit" not in engine.memories.columns and engine.memories.first().id == ids["row 0"]


def test_counting_takes_no_second_job(spark, engine):
    engine.store([{"topic": "t", "summary": "row"}])
    spark.sparkContext.setJobGroup("counted", "")
    plain = engine.store_.write("memories", engine.memories.filter("topic <> 'none'"))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    spark.sparkContext.setJobGroup("seen", "")
    assert engine.forget_topic("none") == 0 and plain
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("seen")) == jobs
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_one_pointer_for_several_tables(spark, engine, monkeypatch):
    m = engine.create_memoir("a")
    engine.add_concepts(m, [("x", "1"), ("y", "2")])
    x, y = (engine.concept_named(m, n).id for n in ("x", "y"))
    engine.link(x, y, "depends_on")
    version = engine.store_.state["version"]

    def stop(self):
        raise OSError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(Snapshots, "_swap", stop)
        with pytest.raises(OSError):
            engine.delete_concept(x)
    engine.store_.refresh()
    assert engine.store_.state["version"] == version and engine.concepts(m).count() == 2 and not engine.links(x).isEmpty()
    assert engine.delete_concept(x) == 1 and engine.store_.state["version"] == version + 1
    assert engine.concepts(m).count() == 1 and engine.links(x).isEmpty()
    assert engine.delete_concept(x) == 0
    version = engine.store_.state["version"]
    engine.record_messages("s", "agent", "p", [("user", "hello")])
    assert engine.store_.state["version"] == version + 1 and engine.store_.table("messages").count() == 1
    assert engine.delete_memoir(m) == 1 and engine.memoirs().isEmpty() and engine.concepts(m).isEmpty()


def events(spark, rows):
    return spark.createDataFrame([(None, t, e, d, c, None, None, None) for t, e, d, c in rows], HOOK_EVENT)


def test_sketches_within_the_bound_in_any_order(spark):
    g, start = random.Random(5), datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(minutes=k % 1200), "tool", int(g.paretovariate(1.1) * 10), k % 7) for k in range(20_000)]
    hours = records.sketch_hours(events(spark, rows))
    assert hours.count() == 20
    values = sorted(d for _, _, d, _ in rows)
    parts = [hours.filter(F.hour("hour") < 7), hours.filter(F.hour("hour") >= 7)]
    for merged in (hours, hours.orderBy(F.desc("hour")), parts[1].union(parts[0]).repartition(7)):
        r = records.merge_sketches(merged).first()
        assert (r.n, r.errors) == (20_000, sum(c != 0 for *_, c in rows)) and abs(r.avg_ms - sum(values) / 20_000) < 1e-6
        for q, v in ((0.5, r.p50), (0.9, r.p90), (0.99, r.p99)):
            assert sum(x < v for x in values) / 20_000 - records.RANK_ERROR <= q <= sum(x <= v for x in values) / 20_000 + records.RANK_ERROR
    some = records.merge_sketches(hours, F.lit(start + datetime.timedelta(hours=2)), F.lit(start + datetime.timedelta(hours=4))).first()
    assert some.n == sum(start + datetime.timedelta(hours=2) <= t < start + datetime.timedelta(hours=4) for t, *_ in rows)


def test_sketches_of_odd_rows(spark):
    t = datetime.datetime(2024, 1, 1, 5)
    got = {r.event: r for r in records.merge_sketches(records.sketch_hours(events(spark, [(t, "a", None, 0), (None, "a", 5, 0), (t, "b", 7, None), (t, None, 3, 1)]))).collect()}
    assert (got["a"].n, got["a"].p50, got["a"].avg_ms) == (1, None, None)
    assert (got["b"].n, got["b"].errors, got["b"].p99) == (1, 0, 7) and got[None].errors == 1
    assert records.merge_sketches(records.sketch_hours(events(spark, []))).isEmpty()


def test_rolled_up_hours_outlive_events(spark, engine):
    t = datetime.datetime(2024, 1, 1, 5)
    engine.record_hook_events(events(spark, [(t, "a", d, 0) for d in range(100)]))
    assert engine.roll_up_hooks() == 100 == engine.roll_up_hooks()
    engine.record_hook_events(events(spark, [(t - datetime.timedelta(days=1), "a", 1000, 1)]))  # a late one
    engine.prune_hook_events(datetime.datetime(2025, 1, 1))
    assert engine.hook_stats().isEmpty()
    r = engine.hook_percentiles().first()
    assert (r.n, r.errors) == (101, 1) and r.p99 >= 97
    assert engine.hook_percentiles(since=t).first().n == 100
    engine.record_hook_events(events(spark, [(t, "a", 5, 0)]))
    engine.roll_up_hooks()
    assert engine.hook_percentiles().first().n == 102
