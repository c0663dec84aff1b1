"""Personal data by patterns, validators and context, in DataFrame functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod 97
for IBANs, parts up to 255 for addresses, digit counts for phones), and words near a
span move its score. The four base kinds (email, ip, card, phone) stay whatever
their score is; the added kinds stay from ``min_score`` on.

The patterns are those of the contract, written so that they can't backtrack over
long runs: possessive repeats, and a start only where a run begins or the last match
ended. Null counts as an empty text: no spans. Rows without an id and repeated rows give a row each. Very long texts are read whole: spans take about
linear time in their matches, and the words near a span are found without a walk from the text's start. Empty tables give empty results, extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import around, digits, luhn, mod97, pieces, render, spans

# Patterns of the kinds, in the order of the contract; then the added kinds.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

# The prior score of a kind, and the words near a span that raise it.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.5, "phone": 0.5, "iban": 0.5, "ssn": 0.3}
CONFIRMED = {"card": 0.3, "iban": 0.4, "ip": 0.1, "phone": 0.1, "email": 0.0, "ssn": 0.0}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|visa|master|credit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|transfer",
    "ssn": "ssn|social|security|insurance",
}
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
WINDOW = 40


def _ip_ok(v: Column) -> Column:
    part = lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(F.ltrim(p, F.lit("0")).rlike("^([0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    return F.forall(F.split(v, r"\."), part)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = 0.6) -> DataFrame:
    """id_col and one array a kind of (start, end, value, score): start and end in code points, end exclusive."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    has = lambda s: F.contains(F.col("_t"), F.lit(s))
    digit = F.col("_t").rlike("[0-9]")
    rows = docs.select(F.col(id_col), t.alias("_t"))
    text = F.col("_t")
    n = lambda v: F.length(digits(v))
    raw = {
        "email": spans(text, EMAIL, has("@")),
        "ip": F.filter(spans(text, IP, digit & has(".")), lambda s: _ip_ok(s["value"])),
        "card": F.filter(spans(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")), lambda s: n(s["value"]).between(16, 19) & luhn(digits(s["value"]))),
        "phone": F.filter(spans(text, PHONE, has("+")), lambda s: n(s["value"]).between(8, 15)),
        "iban": F.filter(spans(text, IBAN, text.rlike(r"[A-Z]{2}[0-9]{2}")), lambda s: mod97(F.replace(s["value"], F.lit(" "), F.lit("")))),
        "ssn": spans(text, SSN, text.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")),
    }

    def scored(kind: str) -> Column:
        def one(s: Column) -> Column:
            at = F.greatest(s["start"] - WINDOW, F.lit(0))
            near = F.concat_ws(" ", around(F.col("_p"), at, s["start"] - at), around(F.col("_p"), s["end"], F.lit(WINDOW)))
            bonus = F.when(F.lower(near).rlike(f"(?:{CONTEXT[kind]})"), F.lit(0.3)).otherwise(F.lit(0.0))
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.least(F.lit(1.0), F.lit(PRIOR[kind] + CONFIRMED[kind]) + bonus).alias("score"))

        all_ = F.transform(kind, one)
        return all_ if kind in BASE else F.filter(all_, lambda s: s["score"] >= min_score)

    # a step of its own, so that spans and pieces are made once
    found = rows.select(id_col, pieces(text).alias("_p"), *[c.alias(k) for k, c in raw.items()])
    return found.select(id_col, *[scored(k).alias(k) for k in KINDS])


def pii_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from the spans."""
    base = F.array_join(F.concat(*[render(k, F.col(k)) for k in BASE]), ",")
    all_ = F.array_join(F.concat(*[render(k, F.col(k)) for k in KINDS]), ",")
    return found.select(id_col, *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(base, 256).alias("base_sha256"), all_.alias("spans"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[4:]])


def pii_report(docs: DataFrame, **kw) -> DataFrame:
    return pii_digest(find_pii(docs, **kw))
