"""Search semantics: SQLite's FTS5 as an independent oracle, and literal cases."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from loomstore.functions import predicates as P
from loomstore.functions import text as T
from loomstore.operators import records, search

MESSAGES = [
    ("m1", "s1", "user", "We added a BRIN indexes note for postgres today"),
    ("m2", "s1", "assistant", "The mysql replica lags behind the primary"),
    ("m3", "s2", "user", "indexes BRIN are not what you want"),
    ("m4", "s2", "assistant", "postgres postgres postgres and more postgres tuning"),
    ("m5", "s2", "user", "nothing of interest here"),
]
QUERIES = ["postgres OR mysql", '"BRIN indexes"', "postg*", "indexes NOT postgres", "postgres AND indexes", "(mysql OR brin) AND the", "NEAR(note today, 3)", "NEAR(note today, 0)", "content:user OR role:user", "postgres tuning"]


@pytest.fixture(scope="module")
def chat(spark):
    m = spark.createDataFrame(MESSAGES, "id string, session_id string, role string, content string")
    s = spark.createDataFrame([("s1", "alpha"), ("s2", "beta")], "id string, project string")
    return m, s


@pytest.fixture(scope="module")
def fts():
    c = sqlite3.connect(":memory:")
    try:
        c.execute("create virtual table f using fts5(id unindexed, session unindexed, role, content)")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5 here")
    c.executemany("insert into f values (?,?,?,?)", MESSAGES)
    return c


@pytest.mark.parametrize("q", QUERIES)
def test_grammar_equals_fts5(chat, fts, q):
    got = {r.id for r in records.search_transcripts(*chat, q).collect()}
    assert got == {r[0] for r in fts.execute("select id from f where f match ?", (q,))}


@pytest.mark.parametrize("q", ["postgres", "the replica", "indexes brin"])
def test_bm25_equals_fts5(chat, fts, q):
    got = {r.id: r.score for r in records.search_transcripts(*chat, q).collect()}
    want = {i: -s for i, s in fts.execute("select id, bm25(f) from f where f match ?", (q,))}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], abs=1e-6) for i in got)


def test_scopes_and_errors(chat):
    assert {r.id for r in records.search_transcripts(*chat, "postgres", project="beta").collect()} == {"m4"}
    assert {r.id for r in records.search_transcripts(*chat, "postgres", session_id="s1").collect()} == {"m1"}
    for bad in ("AND x", '"open', "(a", "a)", "a OR"):
        with pytest.raises(ValueError):
            records.parse_query(bad)


@pytest.mark.parametrize("query, words", [("sqlite-vec", '"sqlite" "vec"'), ("col:value", '"col" "value"'), ("---", ""), ('say "hi"*', '"say" "hi"'), ("a " * 200, " ".join(['"a"'] * 100))])
def test_sanitiser(query, words):
    assert T.sanitise(query) == words


MATCHES = [("decisions-app-core", "app", True), ("apple-notes", "app", False), ("decisions-app-core", "app-core", True), ("preferences", "x", True), ("a/b:c", "B", True), ("a", None, True), ("a", "", True), ("a", "--", True), ("user-anna", "q", True)]


def test_project_segments(spark):
    for topic, project, want in MATCHES:
        assert spark.range(1).select(P.project_matches(F.lit(topic), project)).first()[0] is want, (topic, project)


def test_like_and_labels(spark):
    one = spark.range(1)
    assert tuple(one.select(P.parse_label(F.lit("ns:v:w"))).first()[0]) == ("ns", "v:w")
    assert tuple(one.select(P.parse_label(F.lit("v"))).first()[0]) == ("tag", "v")
    assert one.select(P.parse_relation(F.lit("DependsOn"))).first()[0] == "depends_on"
    assert one.select(P.parse_keywords(F.lit(" a, ,b "))).first()[0] == ["a", "b"]
    with pytest.raises(Exception):
        one.select(P.parse_importance(F.lit("urgent"))).collect()


def unit(i, dims=64, v=1.0):
    return [v if k == i else 0.0 for k in range(dims)]


def test_vectors(spark):
    df = spark.createDataFrame([("a", unit(0)), ("b", unit(1)), ("c", None)], "id string, embedding array<float>")
    rows = search.knn(df, [0.9, 0.1] + [0.0] * 62).collect()
    assert [r.id for r in rows] == ["a", "b"] and rows[0].sim == pytest.approx(0.9 / (0.82**0.5))
    pairs = search.similar_pairs(df, df, 0.75, 5).collect()
    assert pairs == []
    blocks = search.knn_batch(df.filter("embedding is not null"), df, 1, max_queries=1).collect()
    assert sorted((r.query_id, r.id) for r in blocks) == [("a", "a"), ("b", "b")]


def test_expansion(spark):
    df = spark.createDataFrame([("a", ["x", "b", "y"]), ("b", ["x", "z"]), ("x", []), ("y", []), ("z", [])], "id string, related_ids array<string>")
    ini = spark.createDataFrame([("a", 0.9), ("b", 0.8)], "id string, score double")
    got = [(r.id, round(r.score, 3)) for r in search.expand(ini, df, 2, 0.5, 10).collect()]
    assert got == [("a", 0.9), ("b", 0.8), ("x", 0.45), ("y", 0.45)]


def test_hybrid_without_terms(spark):
    df = spark.createDataFrame([(1, "t", "rust programming", unit(0)), (2, "t", "python", unit(1))], "id long, topic string, summary string, embedding array<float>")
    assert search.hybrid(df, "---", unit(1), 1).first().id == 2
    assert {r.id for r in search.hybrid(df, "rust programming", unit(1), 5).collect()} == {1, 2}


def test_byte_cuts(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=40, deadline=None)
    @given(st.text(alphabet="aé東🎉", max_size=12), st.integers(4, 20))
    def run(t, n):
        h, e = spark.createDataFrame([(t,)], "t string").select(T.head_bytes(F.col("t"), n), T.tail_bytes(F.col("t"), n)).first()
        raw = t.encode()
        assert h == raw[:n].decode("utf-8", "ignore")
        assert e == (t if len(raw) <= n else raw[-n:].decode("utf-8", "ignore"))

    run()


PAYLOADS = [
    ('{"tool_output":"a"}', "a"),
    ('{"tool_response":"plain text"}', "plain text"),
    ('{"tool_response":{"output":"o","exit_code":0}}', "o"),
    ('{"tool_response":{"stdout":"s","stderr":""}}', "s"),
    ('{"tool_response":{"stdout":"","content":"c"}}', "c"),
    ('{"tool_response":{"file":{"content":"f"}}}', "f"),
    ('{"x":1}', None),
]


def test_payload_shapes(spark):
    rows = spark.createDataFrame([(p,) for p, _ in PAYLOADS], "p string").select("p", T.tool_output(F.col("p")).alias("o")).collect()
    assert {r.p: r.o for r in rows} == dict(PAYLOADS)


def test_shell_and_paths(spark):
    one = spark.range(1)
    ok = lambda c: one.select(T.is_tool_command(F.lit(c), "mem")).first()[0]
    assert ok("mem recall x") and ok("/usr/bin/mem a && mem b") and not ok("mem a | sh") and not ok("mem $(x)") and not ok("rm x")
    assert one.select(T.repo_of_url(F.lit("git@host:me/tool.git"))).first()[0] == "tool"
    assert one.select(T.project_of_path(F.lit("/home/me/proj/"))).first()[0] == "proj"
    assert one.select(T.session_of_payload(F.lit('{"transcript_path":"/a/b/sess.1.jsonl"}'))).first()[0] == "sess.1"


def test_batch_for_all_terms_starts_from_the_rarest(spark, tmp_path):
    """Rows that hold only a query's frequent terms never meet the query; a term without rows leaves it empty."""
    from loomstore.operators.postings import Postings

    rows = [(i, "hot warm" + (" rare" if i % 50 == 0 else "")) for i in range(200)]
    ix = Postings.build(spark.createDataFrame(rows, "id long, summary string"), f"{tmp_path}/p", ("summary",))
    q = spark.createDataFrame([(1, "hot rare warm"), (2, "hot nowhere"), (3, "hot"), (4, "")], "query_id long, text string")
    got = ix.batch(q, 3, "and")
    assert sorted((r.query_id, r.rn, r.id) for r in got.collect()) == [(1, 1, 0), (1, 2, 50), (1, 3, 100), (3, 1, 1), (3, 2, 2), (3, 3, 3)]
    each = spark.createDataFrame([(1, 3, t) for t in ("hot", "warm", "rare")], "query_id long, wanted int, term string")
    shares = ix._scored(ix.postings(), ["term"]).select("term", "id", "s")
    assert Postings._with_all(each, shares).count() == 4
