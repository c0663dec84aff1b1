"""Baum-Welch learns from every training text before its last rounds, not from some of them."""

from loomstore.llm import hidden_markov as hmm


def test_every_training_text_is_learned_from(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"word{k % 7} and word{k % 5} again") for k in range(200)], "doc_id long, text string")
    rows, plain = [], hmm.one_round

    def counted(texts, *more):
        rows.append(texts.count())
        return plain(texts, *more)

    monkeypatch.setattr(hmm, "one_round", counted)
    f = hmm.fit(docs, rounds=1)
    assert sum(rows[:-1]) == 200 and rows[-1] == 200
    assert len(f.log10) == len(rows)


def test_shared_symbols_are_remembered_within_bounds(monkeypatch):
    monkeypatch.setattr(hmm, "MEMO", 3)
    s = hmm.Symbols([b"own", b" "])
    got = [s[w] for w in (b"a", b"b", b"c", b"d", b"own", b"a", b" ")]
    assert got == [2 + hmm.bucket_of(b"a"), 2 + hmm.bucket_of(b"b"), 2 + hmm.bucket_of(b"c"), 2 + hmm.bucket_of(b"d"), 0, 2 + hmm.bucket_of(b"a"), 1] and len(s) <= 5
