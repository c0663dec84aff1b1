"""Corpus cleaning pipeline over ``documents``: each stage works on what its predecessor kept.

1. toxicity: documents that the Kneser-Ney models reject go.
2. exact dedup: of equal texts the row with the largest doc_id stays.
3. SimHash near-dedup: of each class of near copies (five-word shingles, Jaccard similarity of at least 0.8, found by their SimHash
   fingerprints, and by a join of shingles where these are too far apart) the document with the smallest doc_id stays.
4. benchmark decontamination: documents that hold a benchmark item go.
5. SentencePiece: what is left is encoded; the last stage returns ids and counts.

The first four stages return the columns of their input, whatever else these hold. Null texts count as empty: the empty texts are
copies of one another, and one of them stays. Of equal texts with one id all rows stay or go together, as a dropped id drops all rows of that
id; rows without an id can't be named, so stages 2 and 3 keep them. Texts are read whole, however long. Empty tables give an empty
result, and without labels nothing is rejected by the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomstore.llm import decontaminate, exact_dedup, near_copies, piece_lattice, toxicity
from loomstore.llm.common import fresh_path, keep, table, without_keys
from loomstore.llm.queries import vocabulary
from loomstore.plans.shared import remove, scratch

#: Entries of a generation of the last stage's memo.
PIECE_WORDS = 80_000


def _without(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """``docs`` without the ids in ``drop``: all rows of such an id go, rows without an id stay."""
    return without_keys(docs, keep(drop, "drop"), "doc_id")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), threshold=0.7)
    return _without(docs, scored.filter("predicted = 1").select("doc_id"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(docs, keep_id="largest")
    return _without(docs, found.filter("not kept").select("doc_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_copies.near_copies(docs, width=5, similarity=0.8)
    return _without(docs, found.filter("component_id != doc_id").select("doc_id"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select("doc_id").distinct())


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the best segmentation, their number, its score and that of the next best."""
    # an executor's heap has grown in the stages before, so the workers get a small memo
    return piece_lattice.encode_best(docs, vocabulary("piece_bpe_32k.model"), carry=("lang", "source"), words=PIECE_WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece encoding", encode_pieces),
]

#: SQL can't express the models, fingerprints and segmentations; tests hold run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    name = uuid.uuid4().hex
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage-{name}-{k}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            remove(spark, before)
        before = path
    return docs
