"""Text expressions: tokens, hashes, flattening, byte-safe cuts, JSON probes, shell tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstore.schemas import MAX_QUERY_BYTES, MAX_TOKENS

TOKEN, NO_TOKEN = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"
# Operator characters of the full-text grammar.
OPERATORS = '-*"(){}:^+~\\'


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN})"), F.lit(1))


def query_terms(query: str) -> list[str]:
    """Driver side: the query cut at its byte limit, operators blanked, at most MAX_TOKENS words, as index terms."""
    import regex

    cut = query.encode()[:MAX_QUERY_BYTES].decode("utf-8", "ignore")
    words = cut.translate(str.maketrans(OPERATORS, " " * len(OPERATORS))).split()[:MAX_TOKENS]
    return list(dict.fromkeys(t for w in words for t in regex.findall(TOKEN, w.lower())))


def sanitise(query: str) -> str:
    """The query as quoted words, joined by blanks: an implicit AND."""
    cut = query.encode()[:MAX_QUERY_BYTES].decode("utf-8", "ignore")
    return " ".join(f'"{w}"' for w in cut.translate(str.maketrans(OPERATORS, " " * len(OPERATORS))).split()[:MAX_TOKENS])


def summary_hash(topic: Column, summary: Column) -> Column:
    flat = F.lower(F.trim(F.regexp_replace(summary, r"\s+", " ")))
    return F.sha2(F.concat(F.lower(F.trim(topic)), F.lit("\0"), flat), 256)


def flatten(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.trim(c), "\n\r", "  "), " +", " ")


def cap_chars(c: Column, cap: Column | int) -> Column:
    """The head of at most ``cap`` characters, marked if it was cut."""
    n = F.lit(cap) if isinstance(cap, int) else cap
    return F.when(F.length(c) > n, F.concat(F.substr(c, F.lit(1), n), F.lit(" […]"))).otherwise(c)



def head_bytes(c: Column, limit: int) -> Column:
    """At most ``limit`` bytes of UTF-8, cut between characters."""
    raw = F.encode(c, "utf-8")
    # back up over continuation bytes: a cut is good if the byte after it starts a character
    cut = lambda k: F.substring(raw, 1, limit - k)
    starts = lambda k: F.conv(F.hex(F.substring(raw, limit - k + 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(0xC0)) != 0x80
    out = cut(3)
    for k in (2, 1, 0):
        out = F.when(starts(k), cut(k)).otherwise(out)
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.decode(out, "utf-8"))


def tail_bytes(c: Column, limit: int) -> Column:
    """The last ``limit`` bytes at most, starting at a character."""
    raw, n = F.encode(c, "utf-8"), F.octet_length(c)
    at = lambda k: F.substr(raw, n - limit + 1 + k, F.lit(limit))
    starts = lambda k: F.conv(F.hex(F.substr(raw, n - limit + 1 + k, F.lit(1))), 16, 10).cast("int").bitwiseAND(F.lit(0xC0)) != 0x80
    out = at(3)
    for k in (2, 1, 0):
        out = F.when(starts(k), at(k)).otherwise(out)
    return F.when(n <= limit, c).otherwise(F.decode(out, "utf-8"))


def embed_text(topic: Column, summary: Column) -> Column:
    return F.concat_ws(" ", topic, summary)


def estimate_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / 4).cast("long")


def jaccard(a: Column, b: Column) -> Column:
    """Of two word arrays; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def greedy_distinct(items: Column, threshold: float = 0.6) -> Column:
    """Of an array of strings in order, those not similar to one kept before."""
    empty = F.expr("cast(array() as array<string>)")
    return F.aggregate(items, empty, lambda kept, x: F.when(F.exists(kept, lambda y: jaccard(words(y), words(x)) > threshold), kept).otherwise(F.concat(kept, F.array(x))))


def first_json(payload: Column, *paths: str) -> Column:
    """The first path with a text that isn't empty."""
    return F.coalesce(*[F.nullif(F.get_json_object(payload, p), F.lit("")) for p in paths])


def tool_output(payload: Column) -> Column:
    """The text of a tool's answer: tool_output, or tool_response as a string or by its members."""
    response = F.get_json_object(payload, "$.tool_response")
    text = F.when(~F.ltrim(response).rlike(r"^[\[{]"), response)
    return F.coalesce(first_json(payload, "$.tool_output"), F.nullif(text, F.lit("")), first_json(payload, "$.tool_response.stdout", "$.tool_response.output", "$.tool_response.content", "$.tool_response.file.content"))


def tool_file_path(payload: Column) -> Column:
    return first_json(payload, "$.tool_input.file_path", "$.file_path", "$.tool_input.arguments.file_path")


def session_of_payload(payload: Column) -> Column:
    stem = F.regexp_extract(F.get_json_object(payload, "$.transcript_path"), r"([^/]+?)(\.[^./]*)?$", 1)
    return F.coalesce(first_json(payload, "$.session_id"), F.nullif(stem, F.lit("")))


def repo_of_url(url: Column) -> Column:
    name = F.element_at(F.split(F.element_at(F.split(F.rtrim(F.trim(url), F.lit("/")), "/"), -1), ":"), -1)
    return F.nullif(F.regexp_replace(name, r"\.git$", ""), F.lit(""))


def project_of_path(path: Column) -> Column:
    return F.nullif(F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1), F.lit(""))


def has_shell_meta(cmd: Column) -> Column:
    return cmd.rlike(r"\$\(|`|[<>]")


def is_tool_command(cmd: Column, tool: str) -> Column:
    """Every segment of a command line runs ``tool`` itself, and nothing is substituted or redirected."""
    parts = F.filter(F.transform(F.split(cmd, r"[&|;\n]"), lambda x: F.trim(x)), lambda s: s != "")
    base = lambda s: F.element_at(F.split(F.element_at(F.split(s, r"\s+"), 1), "/"), -1)
    return (F.size(parts) > 0) & F.forall(parts, lambda s: base(s) == tool) & ~has_shell_meta(cmd)


def parse_time(c: Column) -> Column:
    return F.try_to_timestamp(c)


def instructed(text: Column, model: str, role: str) -> Column:
    """The text as a model wants it: models of the E5 family have a word before queries and passages."""
    from loomstore.schemas import E5_PREFIXES

    return F.concat(F.lit(E5_PREFIXES[role]), text) if "-e5-" in model.lower() else text


def local_time(ts: Column, zone: str, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    """A timestamp as the clocks of a zone show it, whatever the session's zone."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit(zone), ts.cast("timestamp_ntz")), pattern)
