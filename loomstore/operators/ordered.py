"""New rows placed in order: each sees what the rows before it left.

A row whose nearest row (over the threshold, by cosine) has its topic overwrites it: the slot keeps its id, and holds the new vector
from then on. Any other row opens a slot and is linked to the nearest ones that live at that moment. Earlier rows of the same batch
count like stored ones. Similarities are compared with nine digits; of equal ones a row of the same topic goes first, then the one
written last, then the smaller id (links: the smaller slot).

Rows of one topic and vector are one class. A class that is no duplicate of another new one follows itself whatever its size; only its
first row is looked at. Of all other rows each gets a list of the ``width`` rows before it that come first in that order, so what is kept
grows with the batch and not with its square (the similarities themselves are computed between all, in blocks, and forgotten). A list is long
enough when one of its rows can't be taken by a row in between that has it in its list: if this holds for all rows, none ever looks beyond its
list. Rows without such a one get longer lists until it does. The lists are resolved in rounds: a row is decided when no undecided earlier
row may still take what is its best. Copies are decided in one round, since each takes the one before it. Once few edges are left, they
are walked through in one task. Rows whose list holds too few living ones for their links get a list of these alone. Hot groups whose rows differ a
little and alternate cost an edge a pair and a round a step until then.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstore.plans.shared import keep
from loomstore.schemas import DUPLICATE_SCORE, LINK_SCORE, MAX_LINKS

#: Digits that similarities are compared with.
DIGITS = 9
#: Edges from which on rounds are left to one task.
IN_ONE = 50_000
#: Rows in a list at first, and by what it grows.
WIDTH, GROW = 32, 4
#: Later than any row.
NEVER = (1 << 63) - 1


def _matrix(col) -> np.ndarray:
    flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m**2).sum(axis=1, keepdims=True)), 1e-10)


def nearest(queries: DataFrame, rows: DataFrame, threshold: float, k: int, own_topic: bool = False, block: int = 20_000) -> DataFrame:
    """(r, p, pseq, sim, same): for every query (r, topic, embedding) the first k rows (p, pseq, at, topic, embedding) that reach the threshold, among
    those with pseq < r < at (at null: whatever r); ``own_topic``: of its topic only. Queries are counted and shared with all tasks in blocks
    of ``block``; a task sends on k rows a query at most, and there are as many tasks as the cluster has cores."""
    spark = rows.sparkSession
    queries = queries.select("r", "topic", "embedding")
    rows = keep(rows.select("p", "pseq", F.coalesce("at", F.lit(NEVER)).alias("at"), "topic", "embedding").repartition(spark.sparkContext.defaultParallelism), "ordered-rows")
    w = Window.partitionBy("r").orderBy(F.desc("sim"), F.desc("same"), F.desc("pseq"), F.asc("p"))
    blocks, out = max(1, -(-queries.count() // block)), None
    for b in range(blocks):
        some = (queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("r"), F.lit(blocks)) == b)).toArrow()
        sent = spark.sparkContext.broadcast(some)
        found = rows.sortWithinPartitions("p").mapInArrow(_first(sent, threshold, k, own_topic), "r long, p string, pseq long, sim double, same boolean")
        part = keep(found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n"), "ordered-lists")
        sent.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


class _Firsts:
    """The first k rows so far of some queries; of rows that are equal otherwise, those that came first."""

    def __init__(self, n: int, k: int, threshold: float):
        self.k, self.n = k, n
        #: the kth of each query, or what any row that reaches the threshold comes before
        self.sim, self.other, self.age = np.full(n, threshold), np.ones(n, np.int8), np.full(n, NEVER)
        self.rows = [np.zeros(0, t) for t in (np.int64, np.float64, np.int8, np.int64, np.int64)]

    def add(self, q, sim, other, age, row) -> None:
        late = (sim < self.sim[q]) | (sim == self.sim[q]) & ((other > self.other[q]) | (other == self.other[q]) & (age > self.age[q]))
        if late.all():
            return
        q, sim, other, age, row = (np.concatenate((a, b[~late])) for a, b in zip(self.rows, (q, sim, other, age, row), strict=True))
        order = np.lexsort((row, age, other, -sim, q))
        starts = np.searchsorted(q[order], np.arange(self.n))
        rank = np.arange(len(order)) - starts[q[order]]
        last = order[rank == self.k - 1]
        self.sim[q[last]], self.other[q[last]], self.age[q[last]] = sim[last], other[last], age[last]
        order = order[rank < self.k]
        self.rows = [x[order] for x in (q, sim, other, age, row)]


def _first(sent, threshold: float, k: int, own_topic: bool, chunk: int = 500, piece: int = 2000):
    def run(batches):
        queries = sent.value
        if not queries.num_rows:
            return
        r = queries.column(0).to_numpy()
        codes: dict = {}
        mine = np.array([codes.setdefault(t, len(codes)) for t in queries.column(1).to_pylist()])
        vectors = _unit(_matrix(queries.column(2).combine_chunks()))
        parts = [slice(x, x + chunk) for x in range(0, len(r), chunk)]
        firsts = [_Firsts(len(r[x]), k, threshold) for x in parts]
        names, seen = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, piece):
                b = whole.slice(at, piece)
                pseq, until = b.column(1).to_numpy(), b.column(2).to_numpy()
                theirs = np.array([codes.get(t, -1) for t in b.column(3).to_pylist()])
                columns = _unit(_matrix(b.column(4))).T
                for x, f in zip(parts, firsts, strict=True):
                    sims = vectors[x] @ columns
                    q, o = np.nonzero(sims >= f.sim[:, None] - 10.0**-DIGITS)
                    before = (pseq[o] < r[x][q]) & (r[x][q] < until[o])
                    q, o = q[before], o[before]
                    sim, other = np.round(sims[q, o], DIGITS), (mine[x][q] != theirs[o]).astype(np.int8)
                    if own_topic:
                        q, o, sim, other = (y[other == 0] for y in (q, o, sim, other))
                    f.add(q, sim, other, -pseq[o], seen + o)
                names.append(b.column(0))
                seen += b.num_rows
        names = pa.chunked_array(names, pa.string())
        for x, f in zip(parts, firsts, strict=True):
            q, sim, other, age, row = f.rows
            if len(q):
                p = names.take(pa.array(row)).combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array(r[x][q]), p, pa.array(-age), pa.array(sim), pa.array(other == 0)], names=["r", "p", "pseq", "sim", "same"])

    return run


def _ends(lists: DataFrame) -> DataFrame:
    """(r, floor): of the lists that are full, the last similarity; at it and below there may be rows that are not in the list."""
    return lists.groupBy("r", "k").agg(F.count("*").alias("n"), F.min("sim").alias("floor")).filter("n >= k").select("r", "floor")


def _lists(queries: DataFrame, rows: DataFrame, duplicate: float, threshold: float, width: int) -> DataFrame:
    """(r, p, pseq, sim, same, k): lists of k rows at most, such that no row will look beyond its own."""
    lists, k = nearest(queries, rows, threshold, width).withColumn("k", F.lit(width)), width
    while True:
        taken = lists.filter("same").filter(F.col("sim") > duplicate).groupBy("p").agg(F.min("r").alias("first"))
        safe = lists.join(taken, "p", "left").filter("first is null or first >= r").select("r").distinct()
        short = keep(_ends(lists).filter(F.col("floor") > duplicate).select("r").join(safe, "r", "left_anti"), "ordered-short")
        if short.isEmpty():
            return lists
        k *= GROW
        longer = nearest(queries.join(short, "r", "left_semi"), rows, threshold, k).withColumn("k", F.lit(k))
        lists = keep(lists.join(short, "r", "left_anti").unionByName(longer), "ordered-lists")


def _walk(edges: pd.DataFrame) -> pd.DataFrame:
    """The rounds' result, row by row."""
    edges = edges.assign(other=~edges.same).sort_values(["r", "sim", "other", "pseq", "p"], ascending=[True, False, True, False, True])
    dead, out = set(), []
    for r, mine in edges.groupby("r", sort=True):
        for p, sim, same in zip(mine.p, mine.sim, mine.same):
            if p not in dead:
                if same:
                    dead.add(p)
                    out.append((r, p, sim))
                break
    return pd.DataFrame(out, columns=["r", "p", "sim"]).astype({"r": "int64", "p": "object", "sim": "float64"})


def _targets(edges: DataFrame, in_one: int) -> DataFrame:
    """(r, p, sim): which row each row overwrites. edges: (r, p, pseq, sim, same), all over the threshold."""
    found = None
    order = F.struct((-F.col("sim")).alias("far"), F.when(F.col("same"), 0).otherwise(1).alias("other"), (-F.col("pseq")).alias("age"), "p")
    while True:
        left = edges.count()
        if left <= in_one:
            # at most ``in_one`` edges
            last = edges.groupBy(F.lit(1).alias("_")).applyInPandas(lambda d: _walk(d), "r long, p string, sim double") if left else edges.select("r", "p", "sim")
            return keep(last if found is None else found.unionByName(last), "ordered-targets")
        first = edges.filter("same").groupBy("p").agg(F.min("r").alias("first"))
        seen = keep(edges.join(first, "p", "left").withColumn("safe", F.col("first").isNull() | (F.col("first") >= F.col("r"))).drop("first").withColumn("b", order), "ordered-seen")
        # what no undecided earlier row may take is there: nothing after it matters
        ends = seen.groupBy("r").agg(F.min("b").alias("best"), F.min(F.when(F.col("safe"), F.col("b"))).alias("end"))
        sure = keep(ends.filter("best = end").select("r", F.col("best.p").alias("p"), (-F.col("best.far")).alias("sim"), (F.col("best.other") == 0).alias("same")), "ordered-sure")
        edges = seen.join(ends.filter("end is null or best < end").select("r", "end"), "r").filter("end is null or b <= end").select(*edges.columns)
        took = sure.filter("same").select("r", "p", "sim")
        found = took if found is None else found.unionByName(took)
        # rows before the one that took p still see it: those of another topic may be undecided
        gone = took.select("p", F.col("r").alias("at"))
        edges = keep(edges.join(gone, "p", "left").filter("at is null or r < at").drop("at"), "ordered-edges")


def _roots(targets: DataFrame) -> DataFrame:
    """(r, root): the first row of the chain of overwritten ones, by pointers that double."""
    up = targets.select("r", F.col("p").alias("root"))
    while True:
        over = up.select(F.concat(F.lit("e"), F.col("r")).alias("root"), F.col("root").alias("next"))
        up = keep(up.join(over, "root", "left").select("r", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ordered-roots")
        if up.filter("moved").isEmpty():
            return up.select("r", "root")
        up = up.drop("moved")


def _busy(many: DataFrame, others: DataFrame, duplicate: float) -> DataFrame:
    """(cls): the classes (r, topic, embedding) that are duplicates of another one. Of the two nearest of its topic one at least is another class."""
    near = nearest(many, others, duplicate, 2, own_topic=True).filter(F.col("sim") > duplicate)
    return near.select((F.lit(NEVER - 1) - F.col("r")).alias("cls"), "pseq").filter("pseq <> cls").select("cls").distinct()


def _alive(lists: DataFrame, opened: DataFrame, killed: DataFrame, queries: DataFrame, rows: DataFrame, link: float, most: int, width: int) -> DataFrame:
    """(r, src, p, sim): of each row that opened a slot the rows that lived then and reach ``link``; the first ``most`` are among them."""
    killed = keep(killed, "ordered-killed")
    live = keep(lists.join(opened, "r").join(killed, "p", "left").filter("at is null or at > r").select("r", "src", "p", "sim"), "ordered-live")
    ends, k = _ends(lists), width
    then = None
    while True:
        enough = live.join(ends, "r").filter("sim > floor").groupBy("r").agg(F.count("*").alias("n")).filter(F.col("n") >= most).select("r")
        lack = keep(ends.filter(F.col("floor") >= link).select("r").join(opened, "r").join(enough, "r", "left_anti"), "ordered-lack")
        if lack.isEmpty():
            return live.filter(F.col("sim") >= link)
        then = then if then is not None else keep(rows.drop("at").join(killed, "p", "left"), "ordered-then")
        k *= GROW
        longer = keep(nearest(queries.join(lack, "r", "left_semi"), then, link, k).withColumn("k", F.lit(k)), "ordered-longer")
        live = keep(live.join(lack.select("r"), "r", "left_anti").unionByName(longer.join(lack, "r").select("r", "src", "p", "sim")), "ordered-live")
        ends = _ends(longer)


def place(old: DataFrame, new: DataFrame, duplicate: float = DUPLICATE_SCORE, link: float = LINK_SCORE, most: int = MAX_LINKS, in_one: int = IN_ONE, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Where each new row (seq, id, topic, embedding; seq 0 or more, unique) goes, given the stored ones (id, topic, embedding).

    Returns (seq, slot, updated, sim) and links (src, dst, rn, sim) of slots that were opened to those that they were linked to. ``sim``
    is null for rows that opened their slot. Rows without a vector (or an id, or a seq) are left out; vectors of zeros are near nothing.
    A link threshold over that of duplicates works as well. Tables of the work are kept: call it inside of ``shared.scratch``, and write
    the results before its end.
    """
    stored = old.filter("embedding is not null and id is not null").select("id", "topic", "embedding")
    rows = keep(new.filter("embedding is not null and id is not null and seq is not null").select(F.col("seq").cast("long").alias("seq"), F.col("id").cast("string").alias("id"), F.coalesce("topic", F.lit("")).alias("topic"), "embedding"), "ordered-rows")
    # a vector of zeros isn't near itself either: its rows are classes of their own
    zero = F.forall("embedding", lambda x: x == 0)
    rows = rows.withColumn("alone", F.when(zero, F.col("seq")).otherwise(F.lit(-1)))
    classes = keep(rows.groupBy("topic", "embedding", "alone").agg(F.min("seq").alias("cls")), "ordered-classes")
    key = lambda seq: F.concat(F.lit("e"), F.col(seq))
    member = keep(rows.join(classes, ["topic", "embedding", "alone"]).select("seq", "id", "cls", "topic", "embedding"), "ordered-members")
    many = classes.join(member.filter("seq <> cls").select("cls").distinct(), "cls", "left_semi").select((F.lit(NEVER - 1) - F.col("cls")).alias("r"), "topic", "embedding")  # asked as if after all
    others = classes.select(key("cls").alias("p"), F.col("cls").alias("pseq"), F.lit(None).cast("long").alias("at"), "topic", "embedding")
    busy = keep(_busy(many, others, duplicate), "ordered-busy")
    events = keep(member.filter("seq = cls").unionByName(member.join(busy, "cls", "left_semi").filter("seq <> cls").select(*member.columns)), "ordered-events")

    queries = events.select(F.col("seq").alias("r"), "topic", "embedding")
    against = stored.select(F.concat(F.lit("o"), "id").alias("p"), F.lit(-1).cast("long").alias("pseq"), F.coalesce("topic", F.lit("")).alias("topic"), "embedding").unionByName(events.select(key("seq").alias("p"), F.col("seq").alias("pseq"), "topic", "embedding"))
    against = keep(against.withColumn("at", F.lit(None).cast("long")), "ordered-against")
    edges = keep(_lists(queries, against, duplicate, min(link, duplicate), width), "ordered-edges")

    rivals = edges.filter(F.col("sim") > duplicate).drop("k")
    targets = _targets(rivals.join(rivals.filter("same").select("r").distinct(), "r", "left_semi"), in_one)
    roots = _roots(targets)
    named = events.select("seq", "id", "cls").join(roots.withColumnRenamed("r", "seq"), "seq", "left")
    firsts = named.filter("root is null").select("seq", F.col("id").alias("slot"))
    by_event = firsts.select(F.concat(F.lit("e"), F.col("seq")).alias("root"), "slot")
    slots = named.filter("root is not null").join(by_event, "root", "left").select("seq", F.coalesce("slot", F.substring("root", 2, 1 << 30)).alias("slot"))
    slots = keep(firsts.unionByName(slots), "ordered-slots")

    decided = slots.join(targets.select(F.col("r").alias("seq"), "sim"), "seq", "left").select("seq", "slot", F.col("sim").isNotNull().alias("updated"), "sim")
    later = member.join(busy, "cls", "left_anti").filter("seq <> cls").join(slots.select(F.col("seq").alias("cls"), "slot"), "cls").select("seq", "slot", F.lit(True).alias("updated"), F.lit(1.0).alias("sim"))

    opened = firsts.select(F.col("seq").alias("r"), F.col("slot").alias("src"))
    killed = targets.select("p", F.col("r").alias("at"))
    alive = _alive(edges, opened, killed, queries, against, link, most, width)
    dst = slots.select(F.concat(F.lit("e"), F.col("seq")).alias("p"), F.col("slot").alias("dst"))
    near = alive.join(dst, "p", "left").select("src", F.coalesce("dst", F.substring("p", 2, 1 << 30)).alias("dst"), "sim")
    w = Window.partitionBy("src").orderBy(F.desc("sim"), F.asc("dst"))
    links = near.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most).select("src", "dst", "rn", "sim")
    return decided.unionByName(later), links


def contents(new: DataFrame, placed: DataFrame) -> DataFrame:
    """What the rows of a batch leave in each slot: (slot, first, summary, importance, keywords, raw_excerpt, embedding, opened). The last row
    counts; keywords are the last that aren't empty, the excerpt the last that isn't null (null: none in the batch); ``first`` is the first seq.
    ``opened`` tells slots of the batch from stored ones."""
    rows = placed.select("seq", "slot", "updated").join(new, "seq")
    given = F.when(F.size("keywords") > 0, F.col("seq"))
    return rows.groupBy("slot").agg(
        F.min("seq").alias("first"),
        F.min_by("topic", "seq").alias("topic"),
        *[F.max_by(c, "seq").alias(c) for c in ("summary", "importance", "embedding")],
        F.max_by("keywords", given).alias("keywords"),
        F.max_by("raw_excerpt", F.when(F.col("raw_excerpt").isNotNull(), F.col("seq"))).alias("raw_excerpt"),
        F.bool_or(~F.col("updated")).alias("opened"),
    )
