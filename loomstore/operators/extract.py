"""Rule-based fact extraction: sentences, scores, kinds, entities. Scores are sums of CASE columns; only
the sentence splitter, a state machine, is an Arrow UDF."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstore.schemas import ANCHORS
from loomstore.functions.predicates import any_of, contains_any
from loomstore.functions.text import greedy_distinct

# What each group of words adds to a sentence's score, and whether it raises the importance to high.
SIGNALS = (
    (1.5, False, (
        "maximum", "minimum", "default", "requires", "supports", "timeout", "threshold", "configured", "limited by", "port", "nodes", "cluster", "protocol", "phase",
    )),
    (2.0, False, (
        "architecture", "module", "pipeline", "component", "design", "structure", "layer", "implementation", "deployed", "system", "framework", "model",
    )),
    (3.0, True, (
        "algorithm", "implements", "complexity", "o(n", "recursive", "tolerance", "consensus", "replication", "latency", "throughput", "bandwidth", "fault",
    )),
    (2.5, True, (
        "chose", "chosen", "decided", "because", "instead of", "trade-off", "rather than", "reason", "motivated", "proposed", "introduced", "invented", "ok so we",
        "ok, so we", "so we'll", "so we will", "let's go with", "going with", "final answer:", "the call is", "settled on", "opted for",
    )),
    (2.0, False, (
        "benchmark", "performance", "measured", "achieves", "tps", "latency", "availability", "scales",
    )),
    (1.0, False, (
        "licensed", "published", "paper", "team", "professor", "university", "company", "stanford", "mit",
    )),
    (2.5, True, (
        "fixed", "resolved", "bug", "workaround", "root cause", "regression", "patch",
    )),
    (2.0, False, (
        "configured", "installed", "migrated", "upgraded", "downgraded", "enabled", "disabled", "deprecated",
    )),
    (2.0, False, (
        "error:", "failed:", "warning:", "panic", "traceback", "exception", "denied", "unauthorized", "not found", "timed out",
    )),
    (1.5, False, (
        "version", "release", "v0.", "v1.", "v2.", "changelog", "breaking change",
    )),
    (1.5, False, (
        "provider", "database", "credential", "endpoint", "webhook", "api key", "token", "connection", "cluster",
    )),
    (2.5, True, (
        "always ", "never ", "must ", "should not", "shouldn't", "don't ", "do not ", "prefer ", "avoid ", "make sure", "important to", "remember to", "rule:",
        "convention:",
    )),
    (2.5, True, (
        "learned", "realized", "turns out", "the trick is", "the fix was", "the solution", "the key is", "the problem was", "discovered that", "figured out", "gotcha",
        "caveat", "pitfall", "note to self",
    )),
    (2.5, False, (
        "we're using", "we use ", "we switched", "we migrated", "we deploy", "the project", "the repo ", "the codebase", "our stack", "we went with", "we picked",
    )),
    (2.5, True, (
        "doesn't work", "does not work", "won't work", "will not work", "incompatible", "breaks when", "only works", "doesn't support", "does not support",
        "limitation", "can't use", "cannot use", "not compatible", "not supported",
    )),
)
# Starts of sentences that tell what somebody is about to do.
NARRATION = (
    "let me ", "let's ", "i will ", "i'll ", "i'm going to ", "i am going to ", "i'm now ", "i am now ", "now i'll ", "now let me ", "next, i'll ", "next i'll ",
    "first, i'll ", "first i'll ", "first, let me ", "first let me ", "reading the ", "looking at the ", "checking the ", "running the ", "storing this ", "i should ",
    "i need to check", "i need to look", "i need to read", "i need to verify", "i'll start by ", "i will start by ", "let me start by ", "let me check ",
)
# Starts of clauses cut off from their sentence.
SUBORDINATE = (
    "because ", "rather than ", "instead of ", "although ", "though ", "since ", "while ", "whereas ", "whether ", "due to ", "such that ", "so that ", "as if ",
    "as though ", "in order to ",
)
# Abbreviations whose dot ends no sentence.
HONORIFICS = (
    "Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Sr.", "Jr.", "St.", "Mt.", "Rev.", "Hon.", "Lt.", "Sgt.", "Cpl.", "Pvt.", "Gen.", "Col.", "Maj.", "Capt.", "Cmdr.",
)
# Words of each kind of fact.
KINDS = (
    ("kind:decision", (
        "decided", "chose", "chosen", "went with", "picked", "switched to", "instead of", "rather than", "trade-off", "trade off", "we chose", "settled on",
        "opted for",
    )),
    ("kind:preference", (
        "always ", "never ", "prefer ", "avoid ", "convention:", "rule:", "make sure", "important to", "must ", "should not", "shouldn't", "don't ", "do not ",
    )),
    ("kind:problem", (
        "bug", "error:", "failed:", "root cause", "workaround", "doesn't work", "does not work", "breaks when", "limitation", "incompatible", "regression", "crash",
    )),
    ("kind:milestone", (
        "shipped", "launched", "deployed", "released", "migrated", "completed", "go live", "went live", "milestone", "v1.", "v2.", "v3.",
    )),
)
# Capitalised words that are no names, and what stands before and after names.
NO_NAMES = (
    "The", "This", "That", "These", "Those", "When", "Where", "What", "Which", "How", "But", "And", "Also", "However", "Furthermore", "Moreover", "Therefore",
    "Because", "After", "Before", "During", "Since", "Until", "While", "Although", "Though", "Some", "Many", "Most", "Each", "Every", "All", "Any", "Both", "Other",
    "Here", "There", "Now", "Then", "Just", "Only", "Even", "Still", "Yet", "Yes", "No", "Not", "Can", "Could", "Would", "Should", "Will", "May", "Might", "Monday",
    "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "January", "February", "March", "April", "May", "June", "July", "August", "September",
    "October", "November", "December", "API", "CLI", "URL", "HTTP", "HTTPS", "JSON", "HTML", "CSS", "SQL", "SSH", "DNS", "TCP", "UDP", "TLS", "SSL", "REST", "GRPC",
    "OAuth", "JWT", "AWS", "GCP", "Azure", "Docker", "Linux", "Mac", "Windows", "Rust", "Python", "Java", "Node", "React", "Vue", "Svelte", "Next", "Git", "Github",
    "Gitlab", "Slack", "Chrome", "Firefox", "Safari", "Postgres", "Redis", "Mongo", "SQLite", "MySQL", "True", "False", "None", "Null", "Ok", "Err",
)
BEFORE_NAMES = (
    "with ", "from ", "ask ", "tell ", "cc ", "ping ", "by ", "per ", "asked ", "told ", "called ", "messaged ", "emailed ", "thank ", "thanks ",
)
AFTER_NAMES = (
    " said", " mentioned", " suggested", " proposed", " agreed", " thinks", " wants", " noted", " confirmed", " replied", " approved", " reviewed", " reported",
    " fixed", " built", "'s ", "'s,", "'s.", "'s:",
)
# Common words that answers are not judged by.
STOP_WORDS = (
    "the", "and", "that", "this", "with", "from", "have", "has", "was", "were", "been", "being", "would", "could", "should", "they", "them", "their", "there", "then",
    "than", "what", "when", "where", "which", "who", "whom", "will", "about", "into", "over", "after", "before", "between", "under", "pour", "dans", "avec", "mais",
    "que", "qui", "les", "des", "une", "est", "sont", "par", "sur", "pas", "plus",
)

_HONORIFIC = re.compile(rf"(?:^|[ \t\n\r\f])(?:{'|'.join(re.escape(h) for h in HONORIFICS)})\s*$")
MIN_FRAGMENT = 30
#: Texts that are cut into sentences together.
TEXTS = 100


def sentences_of(text: str) -> list[str]:
    """Fragments ended by .?! before white space, by a line end or by the text's end; fenced code is skipped."""
    out: list[str] = []
    fenced = False
    for line in re.findall(r"[^\n]*\n|[^\n]+$", text):
        if line.startswith("```"):
            fenced = not fenced
            continue
        if fenced:
            continue
        start = 0
        for m in re.finditer(r"[.?!](?=\s|$)", line):
            if _HONORIFIC.search(line[start : m.end()]) and m.end() < len(line):
                continue
            out.append(line[start : m.end()].strip())
            start = m.end()
        out.append(line[start:].strip())
    return [s for s in out if s]


def split_sentences(df: DataFrame, text: str = "summary") -> DataFrame:
    """(id, pos, sentence) of rows (id, text)."""
    rows = df.select("id", text)
    return rows.mapInArrow(_sentences, f"id {rows.schema['id'].dataType.simpleString()}, pos int, sentence string")


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some texts at a time: only these and their sentences are ever Python's strings, and no batch of all sentences is made."""
    for whole in batches:
        for at in range(0, whole.num_rows, TEXTS):
            b = whole.slice(at, TEXTS)
            lists = [sentences_of(t or "") for t in b.column(1).to_pylist()]
            of = [k for k, x in enumerate(lists) for _ in x]
            pos = [n for x in lists for n in range(len(x))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), pa.array(pos, pa.int32()), pa.array([s for x in lists for s in x], pa.string())], names=["id", "pos", "sentence"])


def keepable(s: Column) -> Column:
    """Long enough, no markup, no cut-off clause, no lower-case start, no dangling address at the end."""
    t = F.ltrim(s)
    low = F.lower(t)
    return (F.length(s) >= MIN_FRAGMENT) & ~t.rlike(r"^(?:> |- |\* |\+ |# |```|\|)") & ~any_of([low.startswith(w) for w in SUBORDINATE]) & ~t.rlike(r"^\p{Ll}") & ~s.rlike(r"(?:/|\\|=)\s*$")


def fact_score(s: Column, low: Column | None = None) -> Column:
    """``low``: the sentence in lower case, where a column has it."""
    low = F.lower(s) if low is None else low
    caps = F.size(F.filter(F.slice(F.filter(F.split(s, r"\s+"), lambda w: w != ""), 2, 100_000), lambda w: w.rlike(r"^\p{Lu}") & (F.octet_length(w) > 1) & ~w.rlike(r"^\p{Lu}+$")))
    total = F.when(s.rlike("[0-9]"), 1.5).otherwise(0.0) + F.when(caps >= 2, 1.5).otherwise(0.0)
    for weight, _, group in SIGNALS:
        for w in group:
            total = total + F.when(low.contains(w), F.lit(weight)).otherwise(0.0)
    total = total + F.when(contains_any(low, (".rs", "fn ", "struct ")), 1.0).otherwise(0.0)
    return total + F.when(s.contains("/") & contains_any(low, (".rs", ".ts", ".py", ".toml", ".json")), 1.5).otherwise(0.0)


def fact_importance(s: Column, low: Column | None = None) -> Column:
    words = tuple(w for _, high, group in SIGNALS if high for w in group)
    return F.when(contains_any(F.lower(s) if low is None else low, words), "high").otherwise("medium")


def candidate(s: Column) -> Column:
    return F.octet_length(s).between(20, 500) & ~any_of([F.lower(s).startswith(w) for w in NARRATION])


def score_sentences(sentences: DataFrame, min_score: float = 2.0) -> DataFrame:
    """rows (id, pos, sentence) -> (id, pos, sentence, score, importance) of the candidates from min_score on."""
    fine = sentences.filter(candidate(F.col("sentence"))).withColumn("low", F.lower("sentence"))
    scored = fine.select("id", "pos", "sentence", "low", fact_score(F.col("sentence"), F.col("low")).alias("score")).filter(F.col("score") >= min_score)
    return scored.select("id", "pos", "sentence", "score", fact_importance(F.col("sentence"), F.col("low")).alias("importance"))


def extract_facts(df: DataFrame, min_score: float = 2.0, max_facts: int = 20) -> DataFrame:
    """(id, fact, importance, kinds): the best sentences of each text, without near repetitions."""
    sent = split_sentences(df).filter(keepable(F.col("sentence")))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "pos")
    top = score_sentences(sent, min_score).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 2 * max_facts)
    kept = top.groupBy("id").agg(F.slice(greedy_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rn", "sentence"))), lambda x: x["sentence"])), 1, max_facts).alias("facts"))
    facts = kept.select("id", F.posexplode("facts").alias("pos", "fact"))
    return facts.select("id", "pos", "fact", fact_importance(F.col("fact")).alias("importance"), classify(F.col("fact")).alias("kinds"))


def classify(s: Column) -> Column:
    low = F.lower(s)
    return F.array_compact(F.array(*[F.when(contains_any(low, words), F.lit(tag)) for tag, words in KINDS]))


def entities(text: Column) -> Column:
    """Names within sentences: capitalised words next to a telling word, possessives and mentions."""
    ws = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    low = F.lower(text)
    clean = lambda w: F.regexp_replace(F.regexp_replace(w, "^@+", ""), r"[^\p{L}\p{N}']+$", "")
    base = lambda w: F.regexp_replace(clean(w), "(?:'s|’s)+$", "")

    def name(w: Column, i: Column) -> Column:
        b = base(w)
        prev = F.get(ws, i - 1)
        shaped = (i > 0) & F.octet_length(b).between(2, 15) & b.rlike(r"^\p{Lu}") & b.rlike(r"\p{Ll}") & ~prev.rlike(r"[.!?]$") & ~b.isin(*dict.fromkeys(NO_NAMES))
        known = any_of([F.contains(low, F.concat(F.lit(p), F.lower(b))) for p in BEFORE_NAMES]) | any_of([F.contains(low, F.concat(F.lower(b), F.lit(p))) for p in AFTER_NAMES])
        return F.when(shaped & (known | F.contains(text, F.concat(F.lit("@"), b)) | clean(w).rlike("(?:'s|’s)$")), F.concat(F.lit("entity:"), b))

    return F.array_sort(F.array_distinct(F.array_compact(F.transform(ws, name))))


def token_f1(prediction: Column, reference: Column) -> Column:
    """F1 of two sets of lower-case words."""
    ws = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    p, r = ws(prediction), ws(reference)
    both = F.size(F.array_intersect(p, r))
    pr, rc = both / F.size(p), both / F.size(r)
    return F.when(F.size(r) == 0, F.when(F.size(p) == 0, 1.0).otherwise(0.0)).when((F.size(p) == 0) | (both == 0), 0.0).otherwise(2 * pr * rc / (pr + rc))


def keyword_hit(response: Column, answer: Column, threshold: float = 0.3) -> Column:
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    ws = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(answer, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), F.lower), lambda w: (F.length(w) > 3) & ~F.array_contains(stop, w)))
    low = F.lower(response)
    return F.when(F.size(ws) == 0, True).otherwise(F.size(F.filter(ws, lambda w: F.contains(low, w))) / F.size(ws) >= threshold)


def answer_scores(answers: DataFrame) -> DataFrame:
    """Adds matches, total and score to rows (answer, expected array, min_matches): 100 from ``min_matches`` expected words on, else the share
    of them that was found."""
    low = F.lower("answer")
    found = F.size(F.filter("expected", lambda w: F.contains(low, F.lower(w))))
    rows = answers.withColumn("matches", found).withColumn("total", F.size("expected"))
    share = F.when(F.col("matches") >= F.col("min_matches"), F.lit(100.0)).otherwise(F.col("matches") * 100.0 / F.col("min_matches"))
    return rows.withColumn("score", F.least(share, F.lit(100.0)))


def anchor_importance(kind: Column) -> Column:
    """How important a sentence is that an anchor of this kind found."""
    return F.create_map(*[F.lit(x) for pair in ANCHORS.items() for x in pair])[kind]


def anchor_tag(kind: Column) -> Column:
    return F.when(kind.isin(list(ANCHORS)), F.concat(F.lit("kind:"), kind))


def merge_prompt(df: DataFrame, max_tokens: int = 200) -> DataFrame:
    """(topic, prompt): what a language model is asked to make one entry of a topic's entries, the heaviest first, as many as fit
    four characters a token; the rest is counted."""
    w = Window.partitionBy("topic").orderBy(F.desc("weight"), "id")
    line = F.concat(F.lit("- "), F.regexp_replace("summary", r"\s+", " "))
    rows = df.select("topic", line.alias("line"), F.sum(F.length(line) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.row_number().over(w).alias("rn"))
    fits = F.col("upto") <= 4 * max_tokens
    some = rows.groupBy("topic").agg(F.array_sort(F.collect_list(F.when(fits, F.struct("rn", "line")))).alias("rows"), F.count_if(~fits).alias("more"))  # as many as fit
    text = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    head = F.concat(F.lit("Merge these entries on "), "topic", F.lit(f" into one of at most {max_tokens} tokens. Keep each fact once and names as they are.\n"))
    return some.select("topic", F.concat(head, text, F.when(F.col("more") > 0, F.concat(F.lit("\n("), F.col("more").cast("string"), F.lit(" more)"))).otherwise("")).alias("prompt"))
