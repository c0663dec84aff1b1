"""Lifecycle, graph, packs, extraction, sources, streaming and the engine."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from loomstore.engine import MemoryEngine, hashing_embedder
from loomstore.operators import extract, graph, lifecycle, packs, records
from loomstore.operators.components import connected_components
from loomstore.sources import imports, projects, sinks
from loomstore.sources.snapshots import ReadOnlyError, Snapshots, backend
from loomstore.streaming import hooks

ROW = "id string, topic string, summary string, importance string, keywords array<string>, raw_excerpt string, seq long"


def test_merge_rules(spark):
    rows = [("a", "Topic", "One  two", "medium", ["x"], None, 1), ("b", "topic ", "one two", "critical", ["y", "x"], "raw", 2), ("c", "topic", "ONE TWO", "low", ["z"], None, 3), ("d", "other", "one two", "low", [], None, 4)]
    got = {r.id: r for r in lifecycle.merge_rows(lifecycle.validate(spark.createDataFrame(rows, ROW))).collect()}
    assert set(got) == {"a", "d"}
    a = got["a"]
    assert (a.importance, a.keywords, a.raw_excerpt, a.merged, a.topic) == ("critical", ["x", "y", "z"], "raw", 3, "Topic")


def test_validation(spark):
    rows = [(" ok ", "s"), ("", "s"), ("a\nb", "s"), ("t", " "), ("x" * 257, "s"), ("t", "y" * 65537), ("t\0", "s"), (None, "s")]
    got = [r.error for r in lifecycle.validate(spark.createDataFrame(rows, "topic string, summary string")).collect()]
    assert got == [None, "topic is empty", "control character in topic", "summary is empty", "topic is too long", "summary is too long", "NUL character", "topic is empty"]


def test_decay_properties(spark):
    df = spark.createDataFrame([("a", "medium", 1.0, 0), ("b", "medium", 1.0, 100), ("c", "critical", 1.0, 0), ("d", "low", 1.0, 5)], "id string, importance string, weight double, access_count long")
    w = {r.id: r.weight for r in lifecycle.decay(df, 0.8, 5).collect()}
    assert w["a"] < w["b"] < w["c"] == 1.0 and w["a"] == pytest.approx(0.8**5)
    with pytest.raises(ValueError):
        lifecycle.decay(df, 1.0)


@pytest.fixture(scope="module")
def chain(spark):
    return spark.createDataFrame([("a", "b", "part_of"), ("b", "c", "part_of"), ("c", "d", "depends_on")], "source_id string, target_id string, relation string")


def test_bfs_sizes(spark, chain):
    start = spark.createDataFrame([("a",)], "id string")
    assert [graph.neighbourhood(chain, start, d).count() for d in (1, 2, 3, 9)] == [2, 3, 4, 4]
    nodes = graph.neighbourhood(chain, start, 2)
    assert graph.neighbourhood_links(chain, nodes, 2).count() == 2
    assert graph.neighbourhood_links(chain, nodes, 2, distinct=False).count() == 3


def test_cycles(spark, chain):
    cand = spark.createDataFrame([("d", "a", "x"), ("a", "d", "x"), ("a", "a", "x"), ("c", "b", "x")], "source_id string, target_id string, relation string")
    got = {(r.source_id, r.target_id): r.cycle for r in graph.closes_cycle(chain, cand).collect()}
    assert got == {("d", "a"): True, ("a", "d"): False, ("a", "a"): True, ("c", "b"): True}
    assert graph.add_links(chain, cand).count() == 4


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (5, 5)], "a long, b long")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[150] == 100 and connected_components(edges.limit(0)).count() == 0


def test_patterns_with_common_keywords(spark):
    rows = [(i, "t", 1.0, ["all", f"k{i // 3}", f"m{i // 3}"]) for i in range(9)] + [(20, "t", 1.0, []), (21, "t", 2.0, ["ALL", "k0", "m0"])]
    got = graph.pattern_clusters(spark.createDataFrame(rows, "id long, topic string, weight double, keywords array<string>"), 0.5, 3).collect()
    assert sorted((r["size"], r.representative) for r in got) == [(3, 3), (3, 6), (4, 21)]


def test_percentiles(spark):
    rows = [("post", 10, 0), ("post", 20, 0), ("post", 30, 1), ("end", 9, 0)]
    got = {r.event: (r.p50, r.p99, r.errors) for r in records.hook_stats(spark.createDataFrame(rows, "event string, duration_ms long, exit_code int")).collect()}
    assert got == {"post": (20, 30, 1), "end": (9, 9, 0)}


def test_fact_versions(spark):
    log = spark.createDataFrame([("e", "k", v, i) for i, v in enumerate(["a", "a", "b", "a", None, None])], "entity string, key string, value string, seq long")
    got = [(r.value, r.seq, r.superseded) for r in records.fact_versions(log).orderBy("seq").collect()]
    assert got == [("a", 0, 2), ("b", 2, 3), ("a", 3, 4), (None, 4, None)]


def test_budget_equals_the_loop(spark):
    import random

    rnd = random.Random(3)
    now = datetime.datetime(2024, 6, 1)
    for budget in (10, 50, 120):
        rows = [(f"m{i:02d}", rnd.choice(["preferences", "decisions-x", "notes"]), "w" * rnd.randint(1, 300), rnd.choice(["critical", "high", "medium"]), rnd.random(), now - datetime.timedelta(days=rnd.randint(0, 90))) for i in range(30)]
        df = spark.createDataFrame([(*r, r[5]) for r in rows], "id string, topic string, summary string, importance string, weight double, created_at timestamp, last_accessed timestamp")
        pack = packs.wake_up(df, F.lit(now), budget).orderBy("cum").collect()
        cand = sorted(packs.wake_up(df, F.lit(now), 100_000).collect(), key=lambda r: (-r.score, r.id))
        total, want, cap = 0, [], max(budget * 4 // 2, 200)
        for c in cand:
            n = min(len(c.line), cap + 4 if len(c.line) > cap else len(c.line)) + 4
            if want and total + n > budget * 4:
                break
            total += n
            want.append(c.id)
        assert [r.id for r in pack] == want
        snap = packs.snapshot(df, budget, "x").collect()
        assert len(snap) == 1 or max(r.cum for r in snap) <= budget * 4
    assert packs.render_wake_up(packs.wake_up(df.limit(0), F.lit(now))).startswith("# Memory wake-up (empty)")


SENTENCES = [
    ("See https://github.com/a/b.git for the code of version 0.10.32 now.", 1),
    ("We met Dr. Smith at the office on Monday. He approved the whole plan.", 2),
    ("```\nlet x = 1. Do it.\n```\nThis line stands after the fenced block here.", 1),
    ("Is it done? Yes it is! And so on", 3),
    ("", 0),
]


@pytest.mark.parametrize("text, n", SENTENCES)
def test_sentences(text, n):
    assert len(extract.sentences_of(text)) == n


def test_keep_filter(spark):
    bad = ["short", "- a list item that is long enough to be kept", "| a | table row that is long enough | x |", "because the sentence was cut off in the middle of it", "lowercase start of a sentence that is long enough", "A sentence that ends in a dangling url https://"]
    good = ["A proper sentence with enough characters to be kept.", "0.10.42 shipped with the fix for the duplicate rows"]
    rows = spark.createDataFrame([(s,) for s in bad + good], "s string").select("s", extract.keepable(F.col("s")).alias("k")).collect()
    assert [r.k for r in rows] == [False] * len(bad) + [True] * len(good)


def test_facts_and_kinds(spark):
    text = "We decided to use Postgres because replication was needed. I'll now read the file and look at it. The root cause was a race in the cache layer. The root cause was a race in the cache layer! Nothing special in this plain sentence here."
    got = extract.extract_facts(spark.createDataFrame([("d", text), ("e", None)], "id string, summary string")).orderBy("pos").collect()
    assert [r.fact[:20] for r in got] == ["We decided to use Po", "The root cause was a"] and got[0].importance == "high"
    assert got[0].kinds == ["kind:decision"] and got[1].kinds == ["kind:problem"]


def test_entities(spark):
    t = "Yesterday we asked Anna about the plan. Bob's idea was fine, and Carla said no to @Dora with Monday"
    assert spark.range(1).select(extract.entities(F.lit(t))).first()[0] == ["entity:Anna", "entity:Carla", "entity:Dora"]


def test_imports(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.json").write_text("{}")
    files = {
        "a.json": json.dumps([{"uuid": "u", "chat_messages": [{"sender": "human", "text": "hi"}, {"sender": "assistant", "text": "yo"}, {"sender": "human", "text": ""}]}]),
        "b.json": json.dumps([{"conversation_id": "c", "mapping": {"n2": {"message": {"author": {"role": "assistant"}, "content": {"parts": ["two", "2"]}, "create_time": 2.0}}, "n1": {"message": {"author": {"role": "user"}, "content": {"parts": ["one"]}, "create_time": 1.0}}, "n0": {"message": None}}}]),
        "c.jsonl": '{"type":"user","message":{"content":"q"}}\nbroken\n{"type":"assistant","message":{"content":[{"type":"text","text":"r1"},{"type":"tool_use"},{"type":"text","text":"r2"}]}}\n{"type":"result"}',
        "d.json": json.dumps({"messages": [{"user": "U", "text": "hello", "ts": "1"}, {"user": "V", "text": "joined", "subtype": "channel_join", "ts": "2"}]}),
        "e.txt": "> ask 1\nanswer a\nanswer b\n> ask 2\n> ask 3\nend",
        "f.md": "just notes",
    }
    for n, t in files.items():
        (tmp_path / n).write_text(t)
    rows = imports.exchanges(imports.read_files(spark, str(tmp_path))).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.path, r.pos)):
        got.setdefault(r.path.rpartition("/")[2], []).append((r.role, r.content))
    assert got == {
        "a.json": [("user", "hi"), ("assistant", "yo")],
        "b.json": [("user", "one"), ("assistant", "two\n2")],
        "c.jsonl": [("user", "q"), ("assistant", "r1\nr2")],
        "d.json": [("user", "hello")],
        "e.txt": [("user", "ask 1"), ("assistant", "answer a\nanswer b"), ("user", "ask 2"), ("user", "ask 3"), ("assistant", "end")],
        "f.md": [("user", "just notes")],
    }
    text = imports.as_text(imports.exchanges(imports.read_files(spark, str(tmp_path)))).filter("path like '%a.json'").first().text
    assert text == "[user]: hi\n[assistant]: yo\n"


def test_project_scan(spark, tmp_path):
    (tmp_path / "crates" / "core" / "src").mkdir(parents=True)
    (tmp_path / ".github" / "workflows").mkdir(parents=True)
    (tmp_path / "Cargo.toml").write_text('[workspace]\nmembers = ["crates/*"]\n[workspace.dependencies]\nserde = "1"\ntokio = { version = "1.2" }\n')
    (tmp_path / "crates" / "core" / "Cargo.toml").write_text('[package]\nname = "core"\nversion = "0.1"\ndescription = "The core"\n')
    (tmp_path / "crates" / "core" / "src" / "lib.rs").write_text("// lib")
    (tmp_path / "Makefile").write_text("all:\n")
    (tmp_path / ".github" / "workflows" / "ci.yml").write_text("on: push")
    entries = projects.scan(projects.read_project(spark, str(tmp_path)), "proj").cache()
    got = sorted((r.kind, r.name) for r in entries.collect())
    assert got == [("config", ".github/workflows/ci.yml"), ("dependency", "serde"), ("dependency", "tokio"), ("entrypoint", "crates/core/src/lib.rs"), ("identity", "proj"), ("module", "crates/core"), ("script", "Makefile")]
    _, links = projects.graph_of(entries, "proj")
    assert ("crates/core/src/lib.rs", "crates/core", "part_of") in {tuple(r) for r in links.collect()}
    assert projects.parse_manifest("go.mod", "module a.b/c\nrequire (\n\tx.y/z v1.2.0\n)")["deps"] == [("z", "v1.2.0")]
    assert projects.parse_manifest("pyproject.toml", '[project]\nname="p"\ndependencies=["a>=1","b"]')["deps"] == [("a", ">=1"), ("b", "*")]
    assert projects.parse_manifest("package.json", '{"dependencies":{"a":"^1"},"devDependencies":{"b":"2"}}')["deps"] == [("a", "^1"), ("b", "2")]
    assert projects.parse_manifest("package.json", "{")["deps"] == []


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "store")
    assert Snapshots.stored_dims(spark, path) is None
    s = Snapshots(spark, path, 64)
    s.write("memories", spark.createDataFrame([("a", [1.0] * 64), ("b", [1.0] * 3)], "id string, embedding array<float>"))
    pinned = Snapshots(spark, path, readonly=True)
    s.mutate("memories", lambda m: m.filter("id = 'a'"))
    assert pinned.table("memories").count() == 2 and Snapshots(spark, path, 64).table("memories").count() == 1
    with pytest.raises(ReadOnlyError):
        pinned.write("memories", s.table("memories"))
    assert Snapshots.stored_dims(spark, path) == 64
    assert Snapshots(spark, path, 128).table("memories").first().embedding is None
    assert s.vacuum() >= 1
    for bad in (3, 5000):
        with pytest.raises(ValueError):
            Snapshots(spark, path, bad)
    assert backend(None) == "parquet"
    with pytest.raises(ValueError):
        backend("tape")


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    payload = lambda i: json.dumps({"session_id": "s", "tool_name": "Bash", "tool_input": {"command": "ls", "file_path": f"/f{i % 2}"}, "tool_response": {"stdout": f"out {i}"}})
    for k in range(2):
        with open(src / f"{k}.json", "w") as f:
            for i in range(k * 4, k * 4 + 5):  # event 4 comes twice
                f.write(json.dumps({"event_id": i, "ts": f"2024-01-01T00:00:{i:02d}", "payload": payload(i)}) + "\n")
    stream = lambda: hooks.parsed(spark.readStream.schema(hooks.PAYLOAD).option("maxFilesPerTrigger", 1).json(str(src)))
    out = str(tmp_path / "out")
    hooks.start(hooks.archive(hooks.foreign(stream(), "mem")), lambda df, _: df.write.mode("append").parquet(out), str(tmp_path / "c1"), "archive").awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == list(range(9))
    nth = str(tmp_path / "nth")
    q = hooks.every_nth(stream(), 3).writeStream.format("json").option("path", nth).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.schema("event_id long").json(nth).count() == 3
    batch = hooks.parsed(spark.read.schema(hooks.PAYLOAD).json(str(src)))
    assert hooks.touches(batch).count() == 10
    ev = batch.select("ts", F.lit("e").alias("event"), F.lit(5).cast("long").alias("duration_ms"), F.lit(0).alias("exit_code"))
    assert hooks.telemetry(ev).first().n == 10
    queue = hooks.queue_rows(batch, "p").withColumn("captured_at", F.current_timestamp())
    facts, left = hooks.drain(queue.dropDuplicates(["id"]), 4)
    assert left.count() == 5 and facts.count() == 0


def test_renderers(spark):
    df = spark.createDataFrame([("a", "t", "high", 0.0625, 'x, "y"', 0.5)], "id string, topic string, importance string, weight double, summary string, score double")
    assert sinks.render(df) == 'memories[1]{score,id,topic,importance,weight,summary}:\n  0.500,a,t,high,0.062,"x, ""y"""\n'
    assert sinks.render(df.drop("score")).startswith("memories[1]{id,topic")
    assert json.loads(sinks.render(df, "json"))[0]["summary"] == 'x, "y"'
    for style in ("detail", "toml", "jsonl", "compact"):
        assert "high" in sinks.render(df, style)
    assert set(sinks.format_costs(df)) == {"json", "jsonl", "toml", "toon", "compact"}


def test_engine_end_to_end(spark, tmp_path):
    e = MemoryEngine(spark, str(tmp_path / "mem"), 64, embedder=hashing_embedder(64))
    e.store([{"topic": "decisions-app", "summary": "We chose Postgres for the app database", "importance": "high", "keywords": ["postgres"]}, {"topic": "notes", "summary": "The cat sleeps on the warm window"}])
    e.store([{"topic": "Decisions-App", "summary": "we chose  postgres for the app database", "keywords": ["db"]}])
    assert e.memories.count() == 2
    hits = e.recall("postgres database", 5)
    assert hits.first().topic == "decisions-app" and hits.first().keywords == ["postgres", "db"]
    assert e.memories.agg(F.max("access_count")).first()[0] == 1
    assert e.find_duplicate("notes", "The cat sleeps on the warm window").count() == 1
    assert "Postgres" in e.wake_up() and e.render(hits).startswith("memories[")
    with pytest.raises(ValueError):
        e.store([{"topic": "", "summary": "x"}])
    e.decay(0.5)
    assert e.prune(0.6).count() == 1 and e.memories.count() == 1
    e.consolidate("decisions-app")
    assert e.memories.first().weight == 1.0
    e.set_fact("app", "db", "mysql")
    e.set_fact("app", "db", "postgres")
    assert e.get_fact("app", "db") == "postgres" and e.store_.table("facts").count() == 2
    m = e.create_memoir("arch")
    e.add_concepts(m, [("A", "first"), ("B", "second")])
    a, b = [r.id for r in e.store_.table("concepts").orderBy("name").collect()]
    e.link(a, b, "depends_on")
    with pytest.raises(ValueError):
        e.link(b, a, "part_of")
    assert e.inspect(a).count() == 2 and "A --depends_on--> B" in e.export(m)
    assert e.export(m, "dot").startswith("digraph {") and e.export(m, "json") and e.export(m, "ai")
    e.record_messages("s1", "agent", "app", [("user", "how to tune postgres"), ("assistant", "raise shared buffers")])
    assert e.search_transcripts("postgres OR buffers").count() == 2
    e.extract(spark.createDataFrame([("t", "We decided to use Redis because latency was too high.")], "id string, summary string"), "app")
    assert e.memories.filter("topic = 'context-app'").first().importance == "medium"
    ro = MemoryEngine(spark, str(tmp_path / "mem"), 64, readonly=True)
    assert ro.recall("postgres").count() >= 0 and ro.topics().count() >= 1 and ro.maybe_decay() is False
