"""Counts of every prefix against the library; stored tables; odd rows."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomstore.llm import queries, token_counts

PATH = queries.vocabulary("word_bpe_49k.json")
PIECES = "a b th e ing ' 're 'll 've ! .. é é İ ß Σ ς 東京 🎉 👩‍👩 <|endoftext|> <|startoftext|> <|end 1 23 ½ ﬁ 각 각 　 أ zzz don n't Å ̈́".split() + [" ", "  ", "\t\n", "\x1c", "\x85"]


@pytest.fixture(scope="module")
def lib():
    t = Tokenizer.from_file(PATH)
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(PATH)


def check(counter, lib, s):
    table = counter.table(s)
    want = [lib(s[:i]) for i in range(len(s) + 1)]
    assert [table.count(i) for i in range(len(s) + 1)] == want == list(table.counts()), s
    assert counter.count(s) == table.total == want[-1]
    for budget in {0, 1, 2, 3, want[-1] - 1, want[-1]} - {-1}:
        assert table.fit(budget) == counter.fit(s, budget) == max(i for i, n in enumerate(want) if n <= budget), (s, budget)


def test_every_prefix_of_random_texts(counter, lib):
    r = random.Random(2)
    for _ in range(400):
        check(counter, lib, "".join(r.choice(PIECES) for _ in range(r.randint(0, 14))))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=25))
def test_every_prefix_of_any_text(counter, lib, s):
    check(counter, lib, s)


def test_characters_of_other_versions_of_unicode(counter, lib):
    """Code points whose kind or case differs between the versions of Unicode that the library and Python have."""
    newer = [chr(c) for c in (0x1E6F0, 0x1C89, 0x1C8A, 0xA7CB, 0xA7DC, 0x10D50, 0x10D40, 0x16D70, 0x1CCF0, 0x2FFFC, 0x88F, 0x1FA89, 0x378, 0xE0FFF, 0x10940, 0x16EA0, 0xA7CE)]
    r = random.Random(4)
    for _ in range(300):
        check(counter, lib, "".join(r.choice([*newer, "a", "1", "!", " ", "é", "É", "'", "́"]) for _ in range(r.randint(1, 7))))


def test_every_prefix_of_provided_words(spark, counter, lib):
    words = {w for (t,) in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() for w in (t or "").split()[:40]}
    for w in sorted(words)[:800]:
        assert [lib(w[:i]) for i in range(1, len(w) + 1)] == list(counter.table(w).counts())[1:], w


def test_long_words_are_cut_inside(counter, lib):
    s = "acgtta" * 30_000
    assert counter.count(s) == lib(s)
    at = counter.fit(s, 2048)
    assert at > 2048 and lib(s[:at]) <= 2048 < lib(s[: at + 1])


def test_stored_tables_answer_without_the_tokenizer(spark, lib):
    rows = [(1, "Hello don't <|endoftext|> wörld 東京"), (2, None), (3, ""), (None, "x"), (3, "é é"), (1, "Hello")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, counts int")
    tables = token_counts.prefix_tables(docs, PATH).cache()
    ask = tables.select("doc_id", F.size("counts").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(30))).alias("k"), "counts")
    got = ask.select("doc_id", "n", "k", token_counts.prefix_count(F.col("counts"), F.col("k")).alias("tokens"), token_counts.fit_chars(F.col("counts"), F.col("k")).alias("fit")).collect()
    assert len(got) == 31 * len(rows)
    texts = {(i, len(t or "") + 1): t or "" for i, t in rows}
    for r in got:
        t = texts[r.doc_id, r.n]
        assert r.tokens == lib(t[: r.k]) and r.fit == max(i for i in range(len(t) + 1) if lib(t[:i]) <= r.k)
    query = token_counts.token_counts(docs, PATH, limit=2).collect()
    assert len(query) == len(rows) and {(r.doc_id, r.n_tokens, r.over_limit) for r in query} == {(i, lib(t or ""), lib(t or "") > 2) for i, t in rows}
    assert token_counts.prefix_tables(docs.limit(0), PATH).count() == 0
