"""A persistent inverted index: postings (term, id, tf, dl) in folders by the term's bucket, and one row of corpus statistics.

A search reads the folders of its terms' buckets only, and in these the row groups whose range of terms fits, instead of
tokenising the corpus. It is built once a version of a table and serves any number of searches, alone or in batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstore.functions.text import tokens
from loomstore.operators.search import B, K1, all_text, topk
from loomstore.plans.shared import keep

BUCKETS = 64
#: Texts whose terms are counted together.
TEXTS = 500


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class Postings:
    """The index under ``path``. ``cols`` are the columns that it was built on."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def build(df: DataFrame, path: str, cols: tuple[str, ...] = ("topic", "summary", "keywords"), key: str = "id") -> "Postings":
        words = df.select(F.col(key).alias("id"), tokens(all_text(cols)).alias("toks")).select("id", F.size("toks").alias("dl"), "toks")
        rows_of(words).write.partitionBy("bucket").parquet(f"{path}/postings")
        words.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).write.parquet(f"{path}/stats")
        return Postings(df.sparkSession, path)

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def stats(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/stats")

    def _scored(self, rows: DataFrame, by: list[str]) -> DataFrame:
        """Adds each posting's share of its row's score. ``by``: what a document count is counted by."""
        df = rows.groupBy(*by).agg(F.count("*").alias("df"))
        one = self.stats().first()
        full = rows.join(df, by)
        idf = F.greatest(F.log((F.lit(one.n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        return full.withColumn("s", idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(one.avgdl))))

    def bm25(self, terms: list[str], mode: str = "or") -> DataFrame:
        """(id, score) of the rows with any or all of the terms; only their buckets are read."""
        some = list(dict.fromkeys(terms))
        if not some:
            return self.spark.createDataFrame([], self.postings().select("id").schema.add("score", "double"))
        buckets = sorted({r[0] for r in self.spark.createDataFrame([(t,) for t in some], "term string").select(bucket_of(F.col("term"))).collect()})
        rows = self.postings().filter(F.col("bucket").isin(buckets) & F.col("term").isin(some))
        out = self._scored(rows, ["term"]).groupBy("id").agg(F.sum("s").alias("score"), F.count("*").alias("k"))
        return out.filter(F.col("k") == len(some)).drop("k") if mode == "and" else out.drop("k")

    def top(self, terms: list[str], k: int = 10, mode: str = "or") -> DataFrame:
        return topk(self.bm25(terms, mode), k, F.desc("score"), F.asc("id"))

    def batch(self, queries: DataFrame, k: int = 10, mode: str = "or") -> DataFrame:
        """(query_id, id, score, rn): the best k rows of each query (query_id, text), for many queries at once."""
        terms = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("terms")).withColumn("wanted", F.size("terms"))
        each = terms.select("query_id", "wanted", F.explode("terms").alias("term")).withColumn("bucket", bucket_of(F.col("term")))
        # a term's postings are scored once, whatever number of queries asks for it
        rows = self.postings().join(each.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
        shares = self._scored(rows, ["term"]).select("term", "id", "s")
        if mode == "and":
            both = self._with_all(each, shares)
        else:
            both = each.join(shares, "term").groupBy("query_id", "id").agg(F.sum("s").alias("score"))
        w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 8)), F.asc("id"))
        return both.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).select("query_id", "id", "score", "rn")

    @staticmethod
    def _with_all(each: DataFrame, shares: DataFrame) -> DataFrame:
        """(query_id, id, score) of the rows with all terms of a query: only rows that hold its rarest term meet the others."""
        shares = keep(shares, "shares")
        seen = keep(shares.groupBy("term").agg(F.count("*").alias("df")), "terms-df")
        sized = each.select("query_id", "wanted", "term").join(seen, "term")
        # queries with a term that no row has are out
        sized = sized.withColumn("have", F.count("*").over(Window.partitionBy("query_id"))).filter(F.col("have") == F.col("wanted"))
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy("df", "term"))
        sized = keep(sized.withColumn("nth", nth).select("query_id", "wanted", "term", "nth"), "terms-by-df")
        some = keep(sized.filter("nth = 1").join(shares, "term").select("query_id", "wanted", "id", F.col("s").alias("first")), "rarest")
        pairs = some.join(sized.filter("nth > 1").select("query_id", "term"), "query_id").select("query_id", "id", "term")
        rest = pairs.join(shares, ["id", "term"]).groupBy("query_id", "id").agg(F.sum("s").alias("rest"), F.count("*").alias("k"))
        both = some.join(rest, ["query_id", "id"], "left").filter(F.coalesce("k", F.lit(0)) == F.col("wanted") - 1)
        return both.select("query_id", "id", (F.col("first") + F.coalesce("rest", F.lit(0.0))).alias("score"))


def rows_of(words: DataFrame) -> DataFrame:
    """(id, term, tf, dl, bucket) of texts (id, dl, toks), dealt out once: by bucket, and sorted there."""
    kind = words.schema["id"].dataType.simpleString()
    counts = words.mapInArrow(_counted, f"id {kind}, dl int, term string, tf int").withColumn("bucket", bucket_of(F.col("term"))).repartition(BUCKETS, "bucket")
    # rows of one id are one; their bucket has all of them
    whole = counts.groupBy("bucket", "term", "id").agg(F.sum("tf").cast("int").alias("tf"), F.first("dl").alias("dl"))
    return whole.select("id", "term", "tf", "dl", "bucket").sortWithinPartitions("bucket", "term", "id")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, dl, term, tf) of texts (id, dl, toks): a text's terms are counted where it is read."""
    for whole in batches:
        for at in range(0, whole.num_rows, TEXTS):
            b = whole.slice(at, TEXTS)
            flat = pc.list_flatten(b.column(2)).dictionary_encode()
            if not len(flat):
                continue
            sizes = pc.fill_null(pc.list_value_length(b.column(2)), 0).to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(sizes)), sizes)
            key, n = np.unique(of * len(flat.dictionary) + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
            own, term = np.divmod(key, len(flat.dictionary))
            rows = b.select([0, 1]).take(pa.array(own))
            yield pa.RecordBatch.from_arrays([*rows.columns, flat.dictionary.take(pa.array(term)), pa.array(n.astype("int32"))], names=["id", "dl", "term", "tf"])


def phrase_terms(text: str) -> list[str]:
    """A query's terms, as the index has them."""
    from loomstore.functions.text import query_terms

    return reduce(lambda a, t: a if t in a else [*a, t], query_terms(text), [])
