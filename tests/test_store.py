"""The store: crashes, two writers, touches; getters, mutations, feedback, hooks and exchange on the engine."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from loomstore.engine import MemoryEngine, hashing_embedder
from loomstore.sources.snapshots import ConflictError, ReadOnlyError, Snapshots


@pytest.fixture
def engine(spark, tmp_path):
    e = MemoryEngine(spark, str(tmp_path / "store"), 64, embedder=hashing_embedder(64))
    e.store([{"topic": "decisions-app", "summary": f"We chose option {k} for the service"} for k in range(4)] + [{"topic": "notes", "summary": "Blue bicycles ride well"}])
    return e


def test_a_torn_pointer_leaves_the_last_state(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path), 64)
    s.meta("a", "1")
    at = s.state["version"]
    torn = tmp_path / f"POINTER-{at + 1:012d}.json"
    torn.write_text('{"version": 99, "tab')
    os.utime(torn, (1, 1))  # long ago: its writer won't finish it
    again = Snapshots(spark, str(tmp_path), 64)
    assert again.state["version"] == at and again.meta("a") == "1"
    again.meta("a", "2")
    assert Snapshots(spark, str(tmp_path), 64).meta("a") == "2"


def test_a_pointer_that_is_being_written_belongs_to_its_writer(spark, tmp_path):
    first, second = Snapshots(spark, str(tmp_path), 64), Snapshots(spark, str(tmp_path), 64)
    at = first.state["version"] + 1
    claim = tmp_path / f"POINTER-{at:012d}.json"
    claim.write_text("")  # the first writer has made its pointer, but not written it
    with pytest.raises(ConflictError):
        second.meta("b", "2")
    claim.write_text(json.dumps(first.state | {"version": at, "metadata": {"a": "1"}}))
    with pytest.raises(ConflictError):
        second.meta("b", "2")
    second.refresh()
    second.meta("b", "2")
    assert Snapshots(spark, str(tmp_path), 64).state["metadata"] == {"a": "1", "b": "2"}
    # old pointers are gone, and a writer of an old state still can't write below the newest
    third = Snapshots(spark, str(tmp_path), 64)
    third.vacuum()
    with pytest.raises(ConflictError):
        first.meta("c", "3")


def test_two_writers(spark, tmp_path):
    one, two = Snapshots(spark, str(tmp_path), 64), Snapshots(spark, str(tmp_path), 64)
    rows = spark.createDataFrame([("1", "p")], "id string, project string")
    one.append("pending", rows)
    with pytest.raises(ConflictError):
        two.write("pending", rows)
    two.refresh()
    two.append("pending", rows.withColumn("id", F.lit("2")))
    assert {r.id for r in Snapshots(spark, str(tmp_path), 64).table("pending").collect()} == {"1", "2"}
    assert one.table("pending").count() == 1 and two.vacuum() >= 1
    assert Snapshots(spark, str(tmp_path), 64).table("pending").count() == 2
    with pytest.raises(ReadOnlyError):
        Snapshots(spark, str(tmp_path), readonly=True).append("pending", rows)


def test_a_recall_writes_little(engine, tmp_path):
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(tmp_path) for f in files if f.endswith(".parquet"))
    engine.recall("bicycles")
    before, path = size(), engine.store_.state["tables"]["memories"]
    hits = engine.recall("bicycles")
    assert size() - before < 5_000 and engine.store_.state["tables"]["memories"] == path
    rows = {r.summary: r.access_count for r in engine.memories.collect()}
    assert hits.count() and rows["Blue bicycles ride well"] == 2
    engine.decay(0.9)
    assert not engine.store_.state["parts"].get("touches")
    assert {r.summary: r.access_count for r in engine.memories.collect()} == rows


def test_parts_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("loomstore.sources.snapshots.MAX_PARTS", 3)
    s = Snapshots(spark, str(tmp_path), 64)
    for k in range(8):
        s.append("pending", spark.createDataFrame([(str(k),)], "id string"))
        assert len(s.state["parts"]["pending"]) <= 3
    assert s.table("pending").count() == 8


def test_getters(engine):
    first = engine.memories.orderBy("summary").first()
    assert engine.get(first.id) == first == engine.get(first.id) and engine.get("none") is None
    engine.forget([first.id])
    assert engine.get(first.id) is None
    ids = [r.id for r in engine.memories.collect()]
    assert engine.get_many([*ids, ids[0], "x"]).count() == len(ids)
    counts = {r.name: r.n for r in engine.counts().collect()}
    assert counts["memories"] == 4 and counts["links"] == 0
    tmp = Snapshots.temporary(engine.spark, 64)
    assert tmp.table("memories").count() == 0


def test_graph_mutations(engine):
    m = engine.create_memoir("system")
    engine.add_concepts(m, [("db", "a database"), ("api", "an interface"), ("ui", "a view")])
    db, api, ui = (engine.concept_named(m, n).id for n in ("db", "api", "ui"))
    engine.link(api, db, "depends_on")
    engine.link(ui, api, "depends_on")
    engine.update_concept(db, definition="a store of rows")
    assert engine.concept(db).definition == "a store of rows" and engine.concept(db).name == "db"
    engine.update_memoir(m, description="all of it")
    assert engine.memoir("system").description == "all of it" and engine.memoir(m).name == "system"
    with pytest.raises(KeyError):
        engine.update_memoir("none", name="x")
    assert [r.name for r in engine.concepts(m).collect()] == ["api", "db", "ui"] and engine.memoirs().count() == 1
    engine.delete_link(engine.links(ui).first().id)
    assert engine.links(api, outgoing=False).isEmpty()
    engine.delete_concept(db)
    assert engine.links(api).isEmpty() and engine.concept(db) is None
    engine.delete_memoir(m)
    assert engine.memoirs().isEmpty() and engine.concepts(m).isEmpty()


def test_feedback_hooks_and_queue(engine):
    a = engine.record_feedback("t", "a context of red", "x", "y")
    b = engine.record_feedback("t", "a context of blue", "x", "z")
    engine.apply_feedback([a, a])
    assert [r.applied_count for r in engine.search_feedback("red").collect()] == [2]
    engine.delete_feedback([a])
    assert [r.id for r in engine.search_feedback("").collect()] == [b]
    day = datetime.datetime(2024, 1, 1)
    rows = engine.spark.createDataFrame([(day + datetime.timedelta(hours=k), "store", k) for k in range(6)], "ts timestamp, event string, duration_ms long").repartition(3)
    engine.record_hook_events(rows)
    engine.record_hook_events(rows.limit(2))
    assert sorted(r.id for r in engine.store_.table("hook_events").collect()) == list(range(1, 9))
    engine.prune_hook_events(day + datetime.timedelta(hours=3))
    assert engine.store_.table("hook_events").filter("id <= 6").count() == 3
    assert [engine.hook_counter(), engine.hook_counter(), engine.hook_counter(reset=True), engine.hook_counter()] == [1, 2, 0, 1]
    engine.enqueue("app", "shell", "We decided to use Postgres because the migration was simple and reliable for the team.")
    engine.enqueue("other", "shell", "x")
    seen = engine.preview(engine.store_.table("pending").select("id", F.col("raw_output").alias("summary")), "app").count()
    n = engine.memories.count()
    assert engine.on_session_end("app") == 1 and engine.store_.table("pending").count() == 1
    assert engine.memories.count() == n + seen
    got = engine.on_prompt("s1", "agent", "app", "bicycles")
    assert got.count() and engine.session("s1").project == "app" and engine.sessions().count() == 1


def test_facts_consolidation_and_exchange(engine, spark, tmp_path):
    engine.set_fact("db", "port", "1")
    engine.set_fact("db", "port", "2")
    assert [r.value for r in engine.fact_history("db", "port").collect()] == ["1", "2"]
    engine.forget_fact("db", "port")
    assert engine.get_fact("db", "port") is None
    assert engine.push(str(tmp_path / "cloud"), ["notes"]) == 1
    other = MemoryEngine(spark, str(tmp_path / "other"), 128)
    other.pull(str(tmp_path / "cloud"))
    other.pull(str(tmp_path / "cloud"))
    row = other.memories.first()
    assert other.memories.count() == 1 and row.summary == "Blue bicycles ride well" and row.embedding is None
    assert engine.maybe_consolidate("notes") == "" and engine.maybe_consolidate("decisions-app", 4, enabled=False) == ""
    assert engine.maybe_consolidate("decisions-app", 4).startswith("consolidated 4") and engine.memories.filter("topic = 'decisions-app'").count() == 1


def test_the_index_is_built_once_a_version(engine):
    got = engine.search_text("bicycles option", 3)
    assert got.count() == 3 and engine.search_text("blue bicycles", mode="and").count() == 1
    path = engine.index().path
    engine.recall("bicycles")
    assert engine.index().path == path
    engine.store([{"topic": "notes", "summary": "Red bicycles too"}])
    assert engine.index().path != path and engine.search_text("red").count() == 1 and engine.search_text("").count() == 0
    rows = engine.index().batch(engine.spark.createDataFrame([(1, "red bicycles"), (2, "option"), (3, "zzz")], "query_id long, text string"), 2).collect()
    assert {(r.query_id, r.rn) for r in rows} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    plan = engine.index().bm25(["red"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "[bucket") or "PartitionFilters: [" in plan


def test_touches_of_rows_that_are_later_than_the_touch(spark, tmp_path):
    """At 0.1 GB some rows were last read after the time of the touches, which the query's SQL sets all the same."""
    import duckdb

    from loomstore import store_queries

    docs = spark.createDataFrame([(i, "en", "web", f"text {i}") for i in (0, 1, 2, 10, 40000, 40001, 40010, 40013)], "doc_id long, lang string, source string, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in store_queries.store_touches(spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(c.sql(store_queries.ORACLE_SQL["store_touches"]).fetchall()) and len(got) == 7
