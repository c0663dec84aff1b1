"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a text is a blob, named by the SHA-256 of its bytes. The ledger is a
Parquet table of (blob, rule_version, spans) in the shared folder. A scan reads only
blobs whose (blob, rule_version) pair the ledger lacks, one copy of each, appends what it
finds (empty findings too, so that a clean blob isn't scanned again), and joins the
findings back to all paths that hold the blob.

One copy of a blob is its smallest path id: picking it needs ids and digests only. Texts of
which a cheap hint speaks then move once, spread by id, so that a text with a third of all
copies weighs on no task; all other texts stay where they are. Paths of clean blobs stay where they are too; of the
others, those of hot blobs do.

Scans may share a ledger: each appends whole files of its own, and what two scans found in one blob at the same time (the same, as it is the
blob and the rules that decide) counts once where the ledger is read. Null counts as an empty text. Empty tables give empty results, extra columns
are ignored, and repeated rows of one path are scanned once and reported once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstore.functions.predicates import any_of
from loomstore.plans.shared import join_counted, key_filter

from .common import fresh_path, keep
from .spans import spans

# The rules of the contract in its order, then the added ones.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
PEM = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
PREFIXED = r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,})"
KINDS = ("assign", "access", "hex", "pem", "prefixed")
BASE = KINDS[:3]
#: Raise it with any change of the rules: all blobs are then unseen.
RULE_VERSION = 1

SPAN = "array<struct<start:int,end:int,value:string>>"
LEDGER = "blob string, rule_version int, " + ", ".join(f"`{k}` {SPAN}" for k in KINDS)


def hints(text: Column) -> dict[str, Column]:
    """A cheap test for each kind that is true wherever its rule matches."""
    return {
        "assign": F.lower(text).rlike("passw|secret|token|api_?key"),
        "access": F.contains(text, F.lit("AKIA")),
        "hex": text.rlike(HEX),
        "pem": F.contains(text, F.lit("PRIVATE KEY-----")),
        "prefixed": text.rlike("gh[pousr]_|xox[abprs]-"),
    }


def scan_columns(text: Column) -> dict[str, Column]:
    """The span arrays of each kind. A run of 32 hexadecimal digits or of AKIA and 12 more
    is the leftmost match of the open pattern that is long enough: nothing else is dropped."""
    value_ok = lambda s: F.length(F.regexp_extract(s["value"], ASSIGN_VALUE, 1)) >= 8
    rules = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "pem": PEM, "prefixed": PREFIXED}
    found = {k: spans(text, rules[k], hint) for k, hint in hints(text).items()}
    return found | {"assign": F.filter(found["assign"], value_ok)}


class BlobLedger:
    """The scans made so far, under ``path`` in the shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, rule_version: int = RULE_VERSION):
        self.spark, self.path, self.rule_version = spark, path or fresh_path(spark, "blob-ledger"), rule_version

    @property
    def empty(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def seen(self) -> DataFrame:
        """One row for each scan of a blob."""
        if self.empty:
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.path).filter(F.col("rule_version") == self.rule_version)

    def append(self, scanned: DataFrame) -> None:
        scanned.write.mode("append").parquet(self.path)

    def findings(self) -> DataFrame:
        """(blob, spans) of the blobs that hold something, once each."""
        return self.seen().filter(" or ".join(f"size(`{k}`) > 0" for k in KINDS)).drop("rule_version").dropDuplicates(["blob"])


def scan(docs: DataFrame, ledger: BlobLedger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, blob and one span array a kind, for every row of ``docs``."""
    spark = docs.sparkSession
    ledger = ledger or BlobLedger(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("path_id"), text.alias("text"))
    # what no hint speaks of has no findings: its blob is entered as clean, and its text stays where it is
    suspect = any_of(list(hints(F.col("text")).values()))
    paths = keep(rows.select("path_id", F.sha2("text", 256).alias("blob"), suspect.alias("suspect")), "paths")
    todo = paths.groupBy("blob").agg(F.min("path_id").alias("path_id"), F.max("suspect").alias("suspect"))
    if not ledger.empty:
        todo = todo.join(ledger.seen().select("blob"), "blob", "left_anti")
    todo = keep(todo, "unseen")
    pick = todo.filter("suspect").select(F.col("path_id").alias("pick_id"), "blob")
    picked = key_filter(pick.select("pick_id"))
    unseen = rows.filter(picked(F.col("path_id"))).join(pick.hint("shuffle_hash"), F.col("path_id").eqNullSafe(F.col("pick_id")))
    if _repeats(paths):
        unseen = unseen.filter(F.sha2("text", 256) == F.col("blob")).dropDuplicates(["blob"])
    found = unseen.select("blob", F.lit(ledger.rule_version).alias("rule_version"), *[c.alias(k) for k, c in scan_columns(F.col("text")).items()])
    none = F.expr(f"cast(array() as {SPAN})")
    clean = todo.filter("not suspect").select("blob", F.lit(ledger.rule_version).alias("rule_version"), *[none.alias(k) for k in KINDS])
    ledger.append(found.unionByName(clean))
    hits = keep(ledger.findings(), "findings")
    test = key_filter(hits.select("blob"))
    clean = paths.filter(~test(F.col("blob"))).select("path_id", "blob", *[none.alias(k) for k in KINDS])
    dirty = keep(paths.filter(test(F.col("blob"))).select("path_id", "blob"), "dirty-paths")
    counted = keep(dirty.groupBy("blob").count().join(hits, "blob", "left").select("blob", "count", *[F.coalesce(F.col(k), none).alias(k) for k in KINDS]), "counted-findings")
    both = clean.unionByName(join_counted(dirty, counted, ["blob"], "count").drop("count"))
    return both.withColumnRenamed("path_id", id_col)


def _repeats(paths: DataFrame) -> bool:
    """True if a path id stands on several rows (or is null)."""
    got = paths.groupBy("path_id").count().filter("count > 1 or path_id is null")
    return not got.isEmpty()


def secrets_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns: spans by start, then by kind as listed."""
    rank = {k: i for i, k in enumerate(KINDS)}

    def merged(kinds: tuple[str, ...]) -> Column:
        def keyed(k: str) -> Column:
            return F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), F.lit(rank[k]).alias("rank"), s["end"].alias("end"), F.lit(k).alias("kind")))

        parts = [keyed(k) for k in kinds]
        return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(id_col, *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(merged(BASE), 256).alias("base_sha256"), merged(KINDS).alias("spans"))
