"""The two jobs: growing input, reruns, command lines, and their queries against SQL."""

import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracles import plain

from jobs import index_transcripts, maintain_memories, queries
from jobs.common import settings
from loomstore.functions.text import tokens


def plain_index(rows):
    """(term, id, tf, dl) of messages (id, role, content)."""
    t = rows.select("id", tokens(F.concat_ws(" ", "role", "content")).alias("toks"))
    return {(r.term, r.id, r.tf, r.dl) for r in t.select("id", F.size("toks").alias("dl"), F.explode("toks").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf")).collect()}


def found(df):
    rows = [tuple(r) for r in df.select("term", "id", "tf", "dl").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture
def talk(spark, sf):
    return spark.read.parquet(f"{sf}/conversations.parquet").cache()


def test_index_takes_only_what_is_new(spark, talk, tmp_path):
    src, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    talk.filter("conv_id % 2 = 0").coalesce(1).write.parquet(src)
    run = lambda: index_transcripts.run(spark, src, out, check)
    first = found(run())
    assert first == plain_index(index_transcripts.messages(talk.filter("conv_id % 2 = 0")))
    assert found(run()) == first  # nothing new
    # the rest, a file that was there before, and a message with another text
    edited = talk.filter("conv_id % 2 = 0").limit(1).withColumn("text", F.lit("quite another zebra text"))
    talk.filter("conv_id % 2 = 1").coalesce(1).write.mode("append").parquet(src)
    talk.filter("conv_id % 2 = 0").coalesce(1).join(edited.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti").limit(5).coalesce(1).write.mode("append").parquet(src)
    edited.coalesce(1).write.mode("append").parquet(src)
    second = found(run())
    now = talk.join(edited.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti").unionByName(edited)
    assert second == plain_index(index_transcripts.messages(now))
    new = spark.read.parquet(f"{out}/messages").filter("segment > 0")
    assert new.count() == talk.filter("conv_id % 2 = 1").count() + 1
    hits = index_transcripts.search(spark, out, "zebra").collect()
    assert [h.content for h in hits] == ["quite another zebra text"]
    # a batch that is run again replaces itself
    last = new.agg(F.max("segment")).first()[0]
    index_transcripts.take(spark.read.parquet(src).filter("conv_id % 2 = 1").unionByName(edited), last, out, ["role", "content"])
    assert found(index_transcripts.BlockIndex(spark, f"{out}/index").postings()) == second


def test_index_of_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None), (1, 1, "user", ""), (1, 2, None, "word word"), (1, 2, "a", "word"), (2, 1, "user", "x " * 5000), (2, 1, "user", "x " * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    src = str(tmp_path / "in")
    df.write.parquet(src)
    got = found(index_transcripts.run(spark, src, str(tmp_path / "out"), str(tmp_path / "check"), files_a_batch=100))
    assert got == {("user", "1-1", 1, 1), ("a", "1-2", 1, 2), ("word", "1-2", 1, 2), ("user", "2-1", 1, 5001), ("x", "2-1", 5000, 5001)}
    df.limit(0).write.parquet(str(tmp_path / "none"))
    assert found(index_transcripts.run(spark, str(tmp_path / "none"), str(tmp_path / "out2"), str(tmp_path / "check2"))) == set()


def test_upkeep_reruns_and_days(spark, sf, tmp_path):
    out = str(tmp_path)
    once = lambda **kw: {r.id: tuple(r) for r in maintain_memories.run(spark, f"{sf}/documents.parquet", f"{sf}/labels.parquet", out, **kw).collect()}
    a = once(day="2024-05-01")
    assert once(day="2024-05-01") == a
    b = once(day="2024-05-02", rounds=20)
    assert once(day="2024-05-01") == a and len(b) < len(a)  # days don't touch one another
    # a rerun with other settings leaves nothing of the former run
    c = once(day="2024-05-01", rounds=20)
    assert set(c) == set(b) and spark.read.parquet(f"{out}/memories").filter("day = '2024-05-01'").count() == len(c)


def test_upkeep_of_odd_rows(spark, tmp_path):
    docs = [(1, "same text", "s"), (2, "Same  text", "s"), (3, None, "s"), (4, " ", "s"), (5, "fine", None), (None, "fine", "s"), (6, "bad words", "t"), (7, "x" * 70_000, "t")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([(6, 0, 1), (6, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/l")
    got = maintain_memories.run(spark, f"{tmp_path}/d", f"{tmp_path}/l", f"{tmp_path}/o", "2024-01-01").collect()
    assert [(r.id, r.importance, r.merged, r.access_count) for r in got] == [(1, "high", 2, 1)]
    bad = {r.id: r.error for r in spark.read.parquet(f"{tmp_path}/o/rejected").collect()}
    assert bad == {3: "summary is empty", 4: "summary is empty", 5: "topic is empty", None: "no id", 7: "summary is too long"}


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"rounds": 3}')
    assert settings(maintain_memories.DEFAULTS, str(tmp_path / "c.json"), factor=0.9)["rounds"] == 3
    with pytest.raises(ValueError, match="unknown"):
        settings(maintain_memories.DEFAULTS, typo=1)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_job_queries_equal_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    rel = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    rows = lambda rs, get: sorted((tuple(plain(get(r, c)) for c in sorted(names)) for r in rs), key=str)
    assert rows(df.collect(), lambda r, c: r[c]) == rows(rel.fetchall(), lambda r, c: r[names.index(c)])


def test_command_line(sf, tmp_path):
    run = lambda: subprocess.run([sys.executable, "-m", "jobs.maintain_memories", "--documents", f"{sf}/documents.parquet", "--labels", f"{sf}/labels.parquet", "--output", str(tmp_path), "--day", "2024-05-01", "--config", "jobs/maintain_memories.json"], capture_output=True, text=True, timeout=120, cwd=__file__.rsplit("/tests/", 1)[0])
    done = run()
    assert done.returncode == 0 and "wrote" in done.stderr, done.stderr[-2000:]
    assert list((tmp_path / "memories" / "day=2024-05-01").glob("importance=*"))
