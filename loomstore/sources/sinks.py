"""Renderings of recall results: TOON, detail, JSON, JSONL, TOML, compact. Rows are a search result, bounded by its limit."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("id", "topic", "importance", "weight", "summary")


def toon_escape(c: Column) -> Column:
    """Quoted, with quotes doubled, if a comma, a quote or a line end is in it."""
    return F.when(c.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def fixed3(c: Column) -> Column:
    """Three decimals, ties to even."""
    return F.replace(F.format_number(c, 3), F.lit(","), F.lit(""))


def toon_lines(df: DataFrame, scored: bool) -> DataFrame:
    cells = ([F.coalesce(fixed3(F.col("score")), F.lit("-"))] if scored else []) + [toon_escape(fixed3(F.col("weight")) if f == "weight" else F.col(f).cast("string")) for f in FIELDS]
    return df.select(F.concat(F.lit("  "), F.concat_ws(",", *cells)).alias("line"))


def render(df: DataFrame, style: str = "toon") -> str:
    """The rows in their order, in one of the styles toon, detail, json, jsonl, toml, compact."""
    scored = "score" in df.columns
    cols = (["score"] if scored else []) + list(FIELDS)
    if style == "toon":
        lines = [r.line for r in toon_lines(df, scored).collect()]
        return f"memories[{len(lines)}]{{{','.join(cols)}}}:\n" + "".join(f"{x}\n" for x in lines)
    rows = [r.asDict() for r in df.select(*cols).collect()]
    if style == "json":
        return json.dumps(rows, ensure_ascii=False)
    if style == "jsonl":
        return "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)
    if style == "toml":
        return "\n".join("[[memories]]\n" + "".join(f"{k} = {json.dumps(v, ensure_ascii=False)}\n" for k, v in r.items() if v is not None) for r in rows)
    if style == "compact":
        return "".join("|".join(str(r[c]) for c in cols) + "\n" for r in rows)
    if style == "detail":
        return "".join("".join(f"{k}: {v}\n" for k, v in r.items()) + "\n" for r in rows)
    raise ValueError(f"unknown style: {style}")


def format_costs(df: DataFrame) -> dict[str, tuple[int, int]]:
    """(bytes, estimated tokens) of each style for the same rows."""
    out = {}
    for style in ("json", "jsonl", "toml", "toon", "compact"):
        text = render(df, style)
        out[style] = (len(text.encode()), -(-len(text) // 4))
    return out


def negotiate(wanted: str | None, accept: str | None) -> str:
    """'json' or 'toon': what is asked for by name, else JSON only if it is accepted and no text is."""
    if (wanted or "").lower() in ("json", "toon"):
        return wanted.lower()
    a = (accept or "").lower()
    return "json" if "application/json" in a and "text/" not in a else "toon"
