"""Text, vector and hybrid search. Query terms are found on the driver; everything else is a DataFrame plan.

A search for given terms needs no postings: term counts come from each row's token array, inside one
scan, and only one row of corpus statistics is shared. Many queries at once go through
postings filtered by the query terms before any shuffle.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstore.functions.text import NO_TOKEN, query_terms, tokens
from loomstore.functions.vectors import cosine, literal
from loomstore.plans.shared import keep, with_keys
from loomstore.schemas import MAX_HYBRID, MAX_KEYWORDS, MAX_LIMIT

K1, B = 1.2, 0.75
#: Similarities that a task holds at once (8 bytes each).
SIMS = 2_000_000


def all_text(cols: tuple[str, ...]) -> Column:
    return F.concat_ws(" ", *[F.col(c) if c != "keywords" else F.array_join("keywords", " ") for c in cols])


def topk(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def match_all(df: DataFrame, query: str, cols: tuple[str, ...] = ("topic", "summary", "keywords")) -> DataFrame:
    """Rows that hold every term of the sanitised query; none for an empty query."""
    terms = query_terms(query)
    if not terms:
        return df.limit(0)
    t = tokens(all_text(cols))
    return df.filter(F.size(F.array_except(F.array(*[F.lit(x) for x in terms]), t)) == 0)


def fts_by_weight(df: DataFrame, query: str, limit: int = 10, cols: tuple[str, ...] = ("topic", "summary", "keywords")) -> DataFrame:
    """The AND search of memories: ordered by weight, not by relevance."""
    return topk(match_all(df, query, cols), min(limit, MAX_LIMIT), F.desc("weight"), F.asc("id"))


def bm25(df: DataFrame, terms: list[str], cols: tuple[str, ...], mode: str = "or", boosts: dict[str, float] | None = None) -> DataFrame:
    """(id, score) with the score as the sum of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)).

    mode 'or' keeps rows with any term, 'and' rows with all. ``boosts`` multiplies the counts of single columns.
    """

    def count(term: str, c: str) -> Column:
        return F.size(F.filter(F.col(f"_t_{c}"), lambda x: x == F.lit(term)))

    toks = df.select("id", *[tokens(all_text((c,))).alias(f"_t_{c}") for c in cols])
    counted = toks.select("id", reduce(lambda a, b: a + b, [F.size(f"_t_{c}") for c in cols]).alias("dl"), *[reduce(lambda a, b: a + b, [count(t, c) * F.lit((boosts or {}).get(c, 1)) for c in cols]).alias(f"tf{i}") for i, t in enumerate(terms)])
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    keep_if = [F.col(f"tf{i}") > 0 for i in range(len(terms))]
    test = reduce((lambda a, b: a & b) if mode == "and" else (lambda a, b: a | b), keep_if, F.lit(mode == "and"))
    rows = counted.filter(test).crossJoin(F.broadcast(stats))  # one row of statistics

    def part(i: int) -> Column:
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
        tf = F.col(f"tf{i}")
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))

    return rows.select("id", reduce(lambda a, b: a + b, [part(i) for i in range(len(terms))]).alias("score"))


def keyword_search(df: DataFrame, words: list[str], limit: int = 20) -> DataFrame:
    """Rows where a word is found in the topic, the summary or the keywords; by weight."""
    some = [w.lower() for w in words[:MAX_KEYWORDS]]
    hay = [F.lower("topic"), F.lower("summary"), F.lower(F.to_json("keywords"))]
    test = reduce(lambda a, b: a | b, [h.contains(w) for w in some for h in hay], F.lit(False))
    return topk(df.filter(test), min(limit, MAX_LIMIT), F.desc("weight"), F.asc("id"))


def keyword_or_search(df: DataFrame, words: list[str], limit: int = 20) -> DataFrame:
    """The analysed dialect: exact keywords, or words of the topic or summary."""
    some = F.array(*[F.lit(w.lower()) for w in words[:MAX_KEYWORDS]])
    test = F.arrays_overlap("keywords", some) | F.arrays_overlap(tokens(F.concat_ws(" ", "topic", "summary")), some)
    return topk(df.filter(test), min(limit, MAX_LIMIT), F.desc("weight"), F.asc("id"))


def topic_prefix(df: DataFrame, prefix: str, limit: int = 500) -> DataFrame:
    """The relational dialect: topics that begin so, case and all; by weight."""
    return topk(df.filter(F.startswith("topic", F.lit(prefix))), limit, F.desc("weight"), F.asc("id"))


def keyword_like(df: DataFrame, words: list[str], limit: int = 20) -> DataFrame:
    """The relational dialect: words may hold the wildcards % and _, and case doesn't count."""
    some = [f"%{w}%" for w in words[:MAX_KEYWORDS]]
    test = reduce(lambda a, b: a | b, [c.ilike(w) for w in some for c in (F.to_json("keywords"), F.col("summary"), F.col("topic"))], F.lit(False))
    return topk(df.filter(test), min(limit, MAX_LIMIT), F.desc("weight"), F.asc("id"))


_WEB = re.compile(r'(-?)(?:"([^"]*)"?|([^\s"]+))')


def websearch(query: str, toks: Column) -> Column:
    """The relational dialect's query language over an array of words: all words, "phrases", -exclusions, and ``or`` between groups."""
    return _web_test(query, F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" ")))


def _web_test(query: str, text: Column) -> Column:
    """Of a text of words between blanks, which is made once a row, whatever the number of tests."""
    groups: list[list[tuple[bool, str]]] = [[]]
    for minus, phrase, word in _WEB.findall(query):
        if word.lower() == "or" and not minus:
            groups.append([])
            continue
        terms = query_terms(phrase or word)
        if terms:
            groups[-1].append((bool(minus), f" {' '.join(terms)} "))
    some = [g for g in groups if g]
    if not some:
        return F.lit(False)

    def test(line: Column) -> Column:
        each = [[~F.contains(line, F.lit(x)) if minus else F.contains(line, F.lit(x)) for minus, x in g] for g in some]
        return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, g) for g in each])

    return F.exists(F.array(text), test)


def fts_websearch(df: DataFrame, query: str, limit: int = 10, cols: tuple[str, ...] = ("topic", "summary", "keywords")) -> DataFrame:
    line = F.concat(F.lit(" "), F.regexp_replace(F.lower(all_text(cols)), NO_TOKEN, " "), F.lit(" "))
    return topk(df.filter(_web_test(query, line)), min(limit, MAX_LIMIT), F.desc("weight"), F.asc("id"))


def knn(df: DataFrame, query: list[float], limit: int = 10) -> DataFrame:
    """(id, sim): exact nearest neighbours by cosine; rows without a vector are left out."""
    return topk(df.filter("embedding is not null").select("id", cosine(F.col("embedding"), literal(query)).alias("sim")), limit, F.desc("sim"), F.asc("id"))


def knn_batch(queries: DataFrame, df: DataFrame, k: int, max_queries: int = 10_000) -> DataFrame:
    """(query_id, id, sim, rn): for each query vector its k best rows. The queries are a stated set; they are
    counted first and shared with all tasks only up to ``max_queries``, else taken in blocks of that size.

    Tasks multiply batches of rows with all queries of a block as matrices, and send on the best k of each batch and query only.
    """
    q = queries.select(F.col("id").alias("query_id"), F.col("embedding").alias("q")).filter("q is not null")
    kind, query_kind = df.schema["id"].dataType.simpleString(), queries.schema["id"].dataType.simpleString()
    blocks = max(1, -(-q.count() // max_queries))
    out = None
    for b in range(blocks):
        some = (q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()
        part = df.filter("embedding is not null").select("id", "embedding").mapInArrow(_best_of_batch(some, k), f"query_id {query_kind}, id {kind}, sim double")
        w = Window.partitionBy("query_id").orderBy(F.desc("sim"), F.asc("id"))
        part = part.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
        out = part if out is None else out.unionByName(part)
    return out


def _matrix(col) -> np.ndarray:
    """Rows of a list column; those of another length than the first's are an error."""
    flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def _best_of_batch(queries, k: int):
    ids, vectors = queries.column(0).combine_chunks(), _matrix(queries.column(1).combine_chunks())
    lengths = np.sqrt((vectors**2).sum(axis=1))

    def run(batches):
        for b in batches:
            if not b.num_rows or not len(ids):
                continue
            rows = _matrix(b.column(1))
            sizes = np.sqrt((rows**2).sum(axis=1))
            # some queries at a time, so that their similarities with the batch stay small
            step = max(1, SIMS // b.num_rows)
            for start in range(0, len(ids), step):
                some = slice(start, start + step)
                sims = (vectors[some] @ rows.T) / np.maximum(lengths[some, None] * sizes[None, :], 1e-10)
                if k < sims.shape[1]:
                    # all that reach the kth best, so that ties are settled by id later
                    least = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]
                    at, of = np.nonzero(sims >= least[:, None] - 1e-12)
                else:
                    at, of = (x.ravel() for x in np.indices(sims.shape))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at + start)), b.column(0).take(pa.array(of)), pa.array(sims[at, of])], names=["query_id", "id", "sim"])

    return run


def hybrid(df: DataFrame, query: str, vector: list[float], limit: int = 10, cols: tuple[str, ...] = ("topic", "summary"), dialect: str = "embedded", monotone: bool = False, index=None) -> DataFrame:
    """(id, score): 30 % text and 70 % vector over two candidate pools of 4 * limit rows.

    With an ``index`` (``blocks.BlockIndex``) of ``df`` the text pool comes from it, over the columns that it was made of.
    Dialects: 'embedded' scores text by 1 / (1 + bm25), so a better text match gets less (``monotone``
    turns that round); 'ranked' divides by the pool's best; 'minmax' scales both families over the pool.
    """
    limit = min(limit, MAX_HYBRID)
    pool = 4 * limit
    terms = query_terms(query)
    vec = knn(df, vector, pool)
    if terms and index is not None:
        text = index.top(query, pool, "or" if dialect == "minmax" else "and")
    elif terms:
        text = topk(bm25(df, terms, cols, "or" if dialect == "minmax" else "and"), pool, F.desc("score"), F.asc("id"))
    else:
        text = df.select("id", F.lit(0.0).alias("score")).limit(0)
    one = Window.partitionBy(F.lit(1))  # over at most 4 * limit rows
    scale = lambda c: (F.col(c) - F.min(c).over(one)) / F.greatest(F.max(c).over(one) - F.min(c).over(one), F.lit(1e-9))
    if dialect == "embedded":
        t = F.col("score") / (1 + F.col("score")) if monotone else 1 / (1 + F.abs("score"))
        text, vec = text.select("id", t.alias("t")), vec.select("id", F.col("sim").alias("v"))
    elif dialect == "ranked":
        text, vec = text.select("id", (F.col("score") / F.max("score").over(one)).alias("t")), vec.select("id", F.col("sim").alias("v"))
    else:
        text, vec = text.select("id", scale("score").alias("t")), vec.select("id", scale("sim").alias("v"))
    both = text.join(vec, "id", "full_outer").select("id", (0.3 * F.coalesce("t", F.lit(0.0)) + 0.7 * F.coalesce("v", F.lit(0.0))).alias("score"))
    return topk(both, limit, F.desc("score"), F.asc("id"))


def match_batch(queries: DataFrame, df: DataFrame, text: str = "summary") -> DataFrame:
    """(query_id, id): rows that hold all terms of a query, for many queries at once.

    Of each query only the rarest term (by counted rows) looks for candidates, so common words bring nothing
    together; a candidate is then tested for all terms.
    """
    terms = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("terms")).filter(F.size("terms") > 0)
    each = terms.select("query_id", F.explode("terms").alias("term"))
    post = df.select("id", F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    counts = with_keys(post, keep(each.select("term").distinct(), "terms"), "term").groupBy("term").agg(F.count("*").alias("n"))
    # a term that no row holds has no count: its query matches nothing
    rare = each.join(counts, "term", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")).alias("m")).filter("m.n > 0").select("query_id", F.col("m.term").alias("term"))
    candidates = keep(with_keys(post, keep(rare, "rare"), "term").select("query_id", "id"), "candidates")
    tested = with_keys(df.select("id", F.col(text).alias("text")), candidates, "id").join(terms, "query_id").withColumn("toks", tokens(F.col("text")))
    return tested.filter(F.size(F.array_except("terms", "toks")) == 0).select("query_id", "id")


def find_similar(df: DataFrame, vector: list[float], topic: str, threshold: float) -> DataFrame:
    """The best row overall if it scores over the threshold and has the topic (in that order)."""
    best = topk(df.filter("embedding is not null").select("id", "topic", cosine(F.col("embedding"), literal(vector)).alias("sim")), 1, F.desc("sim"), F.asc("id"))
    return best.filter((F.col("sim") > threshold) & (F.col("topic") == topic))


def similar_pairs(new: DataFrame, df: DataFrame, threshold: float, k: int, max_queries: int = 10_000) -> DataFrame:
    """Auto-links: for each new row its best k other rows with a similarity of at least the threshold."""
    found = knn_batch(new, df, k + 1, max_queries)
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), F.asc("id"))
    return found.filter((F.col("query_id") != F.col("id")) & (F.col("sim") >= threshold)).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def expand(initial: DataFrame, df: DataFrame, max_neighbours: int, discount: float, total: int) -> DataFrame:
    """(id, score): the initial rows and their first unseen related ids in score order, at a discount."""
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), F.asc("id"))  # the initial set is a search result
    ranked = initial.join(df.select("id", "related_ids"), "id").withColumn("rank", F.row_number().over(w))
    near = ranked.select("rank", "score", F.posexplode("related_ids").alias("pos", "near")).join(initial.select(F.col("id").alias("near")), "near", "left_anti")
    first = near.groupBy("near").agg(F.min(F.struct("rank", "pos", "score")).alias("m"))
    there = first.join(df.select(F.col("id").alias("near")), "near", "left_semi")
    some = topk(there.select("near", "m"), max_neighbours, F.asc("m"), F.asc("near")).select(F.col("near").alias("id"), (F.col("m.score") * discount).alias("score"))
    return topk(initial.select("id", "score").unionByName(some), total, F.desc("score"), F.asc("id"))


def recall(df: DataFrame, query: str, vector: list[float] | None = None, limit: int = 10, project: str | None = None, topic: str | None = None, keyword: str | None = None, expand_hops: bool = True, index=None) -> DataFrame:
    """Hybrid search, then the filters, then one hop of related rows at half the score, filtered again. With an ``index`` of the rows no text is read but that of hits."""
    from loomstore.functions.predicates import keyword_matches, project_matches, topic_matches

    limit = max(1, min(limit, MAX_LIMIT))

    def scoped(d: DataFrame) -> DataFrame:
        d = d.filter(project_matches(F.col("topic"), project))
        d = d.filter(topic_matches(F.col("topic"), topic)) if topic else d
        return d.filter(keyword_matches(F.col("keywords"), keyword)) if keyword else d

    if vector is not None:
        hits = hybrid(df, query, vector, limit, index=index)
    elif index is not None and query_terms(query):
        one = df.sparkSession.createDataFrame([(0, " ".join(query_terms(query)))], "query_id int, text string")
        hits = topk(df.join(index.matching(one).select("id"), "id", "left_semi"), min(limit, MAX_LIMIT), F.desc("weight"), F.asc("id")).select("id", F.lit(1.0).alias("score"))
    else:
        hits = fts_by_weight(df, query, limit).select("id", F.lit(1.0).alias("score"))
    hits = scoped(hits.join(df, "id")).select("id", "score")
    if expand_hops:
        hits = scoped(expand(hits, df, max(limit // 3, 1), 0.5, limit).join(df, "id")).select("id", "score")
    return topk(hits.join(df, "id"), limit, F.desc("score"), F.asc("id"))


def fallback_tiers(df: DataFrame, query: str, project: str | None, limit: int) -> DataFrame:
    """Context recall: project hits, else all hits, else preference topics; each by weight. (id, tier, weight, topic, summary)."""
    from loomstore.functions.predicates import is_preference_topic, project_matches

    hits = fts_by_weight(df, query, 4 * limit)
    tier = F.when(project_matches(F.col("topic"), project), 1).otherwise(2)
    pool = hits.withColumn("tier", tier).unionByName(topk(df.filter(is_preference_topic(F.col("topic"))), limit, F.desc("weight"), F.asc("id")).withColumn("tier", F.lit(3)))
    best = pool.withColumn("best", F.min("tier").over(Window.partitionBy(F.lit(1))))  # at most 5 * limit rows
    chosen = best.filter((F.col("tier") == F.col("best")) | ((F.col("best") == 2) & (F.col("tier") <= 2)))
    return topk(chosen.select("id", "tier", "weight", "topic", "summary"), limit, F.desc("weight"), F.asc("id"))


def semantic_margin(df: DataFrame, anchors: DataFrame, threshold: float = 0.025) -> DataFrame:
    """(id, kind, margin): best positive anchor and its lead over the best negative one (anchors: kind null = negative)."""
    pairs = df.filter("embedding is not null").crossJoin(F.broadcast(anchors.select("kind", F.col("embedding").alias("anchor"))))  # a fixed list of anchors
    sims = pairs.select("id", "kind", cosine(F.col("embedding"), F.col("anchor")).alias("sim"))
    agg = sims.groupBy("id").agg(F.max_by("kind", F.struct(F.when(F.col("kind").isNotNull(), F.col("sim")), F.col("kind"))).alias("kind"), (F.max(F.when(F.col("kind").isNotNull(), F.col("sim"))) - F.max(F.when(F.col("kind").isNull(), F.col("sim")))).alias("margin"))
    return agg.filter(F.col("margin") >= threshold)
