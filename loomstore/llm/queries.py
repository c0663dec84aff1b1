"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, hidden_markov, html_text, oracles, pii, piece_lattice, secrets, simhash, spelling, token_counts, toxicity, warc
from .common import table


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; LOOMSTORE_TOKENIZERS names another folder."""
    folder = os.environ.get("LOOMSTORE_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.encode_digest(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), n=2, original=True)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, max_diff=4)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep_id="largest")
    return out.withColumnRenamed("digest", "text_sha256")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(secrets.scan(table(spark, sf_dir, "documents")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_warc(table(spark, sf_dir, "pages"), repeats=True)
    return warc.read_warc(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), limit=2048)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score_texts(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pieces, op2_simhash, op3_exact_dedup, op4_decontaminate, op5_pii, op6_secrets, op7_warc, op8_toxicity, op9_token_counts, op10_html_text, op11_spelling, op12_hidden_markov)
}
ORACLE_SQL = oracles.ORACLE_SQL
