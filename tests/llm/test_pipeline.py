"""run() against plain versions of its stages, and on odd rows."""

import brute
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from loomstore.llm import common, decontaminate, piece_lattice, queries, toxicity

MODEL = queries.vocabulary("piece_bpe_32k.model")


def grams(t):
    w = (t or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def plain(rows, toxic, items):
    """Rows (doc_id, text, ...) that the stages keep; ``toxic``: ids that the first one rejects."""
    rows = [r for r in rows if r[0] not in toxic]
    # rows without an id are no one's copies
    named = [r for r in rows if r[0] is not None]
    gone = {i for i, (keep, _, kept, _) in brute.exact_groups([(r[0], r[1]) for r in named]).items() if not kept}
    rows = [r for r in rows if r[0] not in gone]
    sets = {r[0]: grams(r[1]) for r in rows if r[0] is not None}
    first = brute.components(sorted(sets), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    rows = [r for r in rows if r[0] is None or first[r[0]] == r[0]]
    table = decontaminate.ItemTable(items, 8, 5)
    return [r for r in rows if not table.hits(r[1] or "", 8, 0.5)]


def check(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("labels", "benchmark"))
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, labels).filter("predicted = 1").collect()} - {None}
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    want = plain(rows, toxic, [(r.item_id, r.text or "") for r in bench.collect()])
    got = corpus_pipeline.run(spark, str(folder)).collect()
    assert sorted((str(r.doc_id), r.lang, r.source) for r in got) == sorted((str(i), lang, s) for i, _, lang, s in want)
    texts = {r[0]: r[1] or "" for r in want}
    lattice = piece_lattice.lattice(MODEL)
    for r in got:
        assert lattice.decode(list(r.ids)) == texts[r.doc_id].replace("▁", " ") and r.n_pieces == len(r.ids)
        assert list(r.ids) == piece_lattice.encode_text(MODEL, texts[r.doc_id], 2)[0][1].tolist()
    return toxic, got


def test_provided_rows(spark, sf):
    _, got = check(spark, sf)
    assert 0 < len(got) < spark.read.parquet(f"{sf}/documents.parquet").count()


def test_odd_rows(spark, tmp_path):
    q = "Tom has 3 apples and Ann gives 4 red apples to the people of the town after two hours"
    base = [f"w{k}" for k in range(120)]
    rows = [(k, f"calm words number {k} of a plain text with nothing in it {k * 7}") for k in range(120)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "Same Text here"), (204, "same text HERE"), (205, " ".join(base)), (206, " ".join([*base[:60], "x", *base[61:]])), (207, " ".join(reversed(base)))]
    rows += [(208, "before it " + q.lower() + " after it"), (209, "word " * 50_000), (205, "another text of the id 205"), (None, "a text without an id"), (None, "Same text here")]
    spark.createDataFrame([(*r, "en", f"s{n % 3}", 0, "x") for n, r in enumerate(rows)], "doc_id long, text string, lang string, source string, score int, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 0, 0) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, q), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = sorted(r.doc_id for r in got if r.doc_id is not None)
    assert {200, 202, 203, 206, 208} & set(ids) == set() and {201, 204, 205, 207, 209} <= set(ids) and ids.count(205) == 2
    assert sum(r.doc_id is None for r in got) == 2


def test_empty_tables(spark, tmp_path):
    for name, kind in (("documents", "doc_id long, text string, lang string, source string"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_last_stage_holds_a_bounded_memo(spark):
    """Workers run beside a heap that four stages have grown; the memo of 300,000 distinct words was 300,000 entries."""
    words = F.expr("concat_ws(' ', transform(sequence(0, 199), k -> translate(conv((id * 200 + k) * 7919 + 60466176, 10, 36), '0123456789', 'abcdefghij')))")
    docs = spark.range(0, 1500, 1, 1).select(F.col("id").alias("doc_id"), words.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    sums = [F.count("*"), F.sum("n_pieces"), F.sum(F.xxhash64("doc_id", "score", "next_score", "ids").cast("decimal(38,0)"))]

    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(len(m) + len(m.old) for m in common._LIVE.values() if isinstance(m, piece_lattice._Memo))]})

    got = corpus_pipeline.encode_pieces(spark, docs, "").agg(*sums).first()
    # workers outlive a stage: the one that encoded is among those that tell what they hold
    told = spark.range(0, 64, 1, 16).mapInArrow(held, "n long").agg(F.max("n")).first()[0]
    assert 0 < told < 240_000
    assert got == piece_lattice.encode_best(docs, MODEL, carry=("lang", "source")).agg(*sums).first()
