"""Near copies by SimHash: pairs whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

First the fingerprints look for pairs (``simhash``: those of 4 or fewer differing bits), and the pairs' shingles decide. What this connects is settled.
At a similarity of 0.8 fingerprints differ in some 10 of 64 bits, so a join then adds the links that are beyond 4 bits: it compares
pairs of different classes only.

The join is by prefixes. All shingles stand in one order; of a set of n the first n - ceil(0.8 n) + 1 are its prefix. Two
sets of that similarity share a shingle of their prefixes whatever the order is, so an equality grouping on prefix
shingles finds every pair. The order puts shingles last that were seen to be common (within batches, summed up): a
passage that many texts quote is then in the prefix of those alone that are hardly more than the passage.

Pairs that meet are first held to the ratio of their sizes and to the distance of their SimHash fingerprints, two of 64 bits by
independent hashes (at 0.8 the 128 bits differ in 19 with a deviation of 4; ``max_diff`` is 42), then their shingles are compared.

In a group of up to ``block`` texts all pairs meet, and pairs that stand the tests are compared once, by a join. In a larger group
all texts first meet the four of its first texts that are nearest to these texts' majority fingerprint. What this connects isn't compared again;
pairs of different classes are: a task looks at the group's sizes and fingerprints (``_tiles``) and gives back the pairs that stand the tests, which
go the same way as those of small groups. A group with more than ``dense`` such pairs a text goes to a task with its
shingles, which joins classes as it finds links and gives back the links that joined two, not the pairs. Two texts that share several large groups
are compared in one of them only, that of the smallest key. A group of over ``tile`` texts (or ``tile_shingles`` shingles) is dealt out as pairs
of blocks.

Words and shingles are those of ``simhash``; texts without words are copies of each other. Ids are longs; rows of one id are one
document with all of their texts' links. Rows without an id are left out. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstore.operators.components import connected_components

from .common import join_counted, keep, only, small_batches, with_keys
from .simhash import fingerprint_links, fingerprint_of, fingerprints, shingle_hashes

ROOTS = 4
COMMON = 32
COMMON_SHINGLES = 1_000_000
BATCH = 2_000
KEYED = "key long, id long, n int, fp long, gp long"
MET = "key long, a long, b long, n int, fp long, gp long"


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Distinct shingle hashes, ascending; a text without words has one that no other text is likely to have."""
    return distinct(np.array(shingle_hashes(text or "", width), np.uint64))


def distinct(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes) if len(hashes) else np.zeros(1, np.uint64)


def _map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with ``fn(batch) -> columns`` in the order of the schema."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays(fn(b), names=names)

    return df.mapInArrow(run, schema)


def common_shingles(docs: DataFrame, width: int, least: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, counts) of shingles seen at least ``least`` times in batches that hold them more than once."""

    def fn(b):
        found, n = np.unique(np.concatenate([shingle_set(t, width) for t in b.column(1).to_pylist()]), return_counts=True)
        return [pa.array(found[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))]

    seen = _map(docs, fn, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    got = seen.orderBy(F.desc("n"), "h").limit(COMMON_SHINGLES).toArrow()
    h, n = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
    by = np.argsort(h)
    return h[by], n[by]


def prefix(s: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The part of an ascending set that a set of this similarity must share a member of."""
    size = len(s) - math.ceil(similarity * len(s) - 1e-9) + 1
    if not len(common):
        return s[:size]
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    often = common[at] == s
    rare = s[~often]
    if len(rare) >= size:
        return rare[:size]
    by = np.argsort(counts[at[often]], kind="stable")
    return np.concatenate([rare, s[often][by][: size - len(rare)]])


def differing(fp: np.ndarray, gp: np.ndarray) -> np.ndarray:
    """Bits set in both numbers together."""
    return np.bitwise_count(fp.view(np.uint64)).astype(np.int64) + np.bitwise_count(gp.view(np.uint64))


def second_hashes(h: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _met(similarity: float, max_diff: int, block: int):
    """Of rows sorted by key: pairs (null, a, b, null, null) that may be similar, and the rows of groups of over ``block``."""

    def batch(pairs: list, rows: list) -> pa.RecordBatch:
        a, b = (np.concatenate([p[k] for p in pairs] or [np.zeros(0, np.int64)]) for k in (0, 1))
        key, ids, n, fp, gp = (np.concatenate([r[k] for r in rows] or [np.zeros(0, np.int64)]) for k in range(5))
        none = lambda k, t: pa.nulls(k, t)
        cols = [
            pa.concat_arrays([none(len(a), pa.int64()), pa.array(key, pa.int64())]),
            pa.concat_arrays([pa.array(a, pa.int64()), pa.array(ids, pa.int64())]),
            pa.concat_arrays([pa.array(b, pa.int64()), none(len(key), pa.int64())]),
            pa.concat_arrays([none(len(a), pa.int32()), pa.array(n.astype(np.int32))]),
            pa.concat_arrays([none(len(a), pa.int64()), pa.array(fp, pa.int64())]),
            pa.concat_arrays([none(len(a), pa.int64()), pa.array(gp, pa.int64())]),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["key", "a", "b", "n", "fp", "gp"])

    def pairs_of(x: list[np.ndarray], y: list[np.ndarray], i: np.ndarray, j: np.ndarray):
        n, m = x[2][i], y[2][j]
        ok = (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9) & (x[1][i] != y[1][j])
        ok &= differing(x[3][i] ^ y[3][j], x[4][i] ^ y[4][j]) <= max_diff
        return x[1][i[ok]], y[1][j[ok]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, roots = None, [], 0, None
        pairs: list = []
        rows: list = []

        def star(x: list[np.ndarray]) -> None:
            rows.append(x)
            i, j = np.divmod(np.arange(len(roots[0]) * len(x[0])), len(x[0]))
            pairs.append(pairs_of(roots, x, i, j))

        def close() -> None:
            if roots is None and size > 1:
                whole = [np.concatenate(c) for c in zip(*held, strict=True)]
                pairs.append(pairs_of(whole, whole, *np.triu_indices(size, 1)))

        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if not len(cols[0]):
                continue
            cut = np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(cols[0])]))
            # runs of one row inside the batch meet nothing
            some = (ends - starts > 1) | (starts == 0) | (ends == len(cols[0]))
            for s, e in zip(starts[some], ends[some], strict=True):
                x = [c[s:e] for c in cols]
                if x[0][0] != key:
                    close()
                    key, held, size, roots = x[0][0], [], 0, None
                if roots is not None:
                    star(x)
                    continue
                held.append(x)
                size += e - s
                if size > block:
                    whole = [np.concatenate(c) for c in zip(*held, strict=True)]
                    bits = (whole[3][:, None] >> np.arange(64)) & 1
                    near = np.argsort((bits != (2 * bits.sum(0) > len(bits))).sum(1), kind="stable")[:ROOTS]
                    roots, held = [c[near] for c in whole], []
                    star(whole)
            if len(pairs) > 2_000 or rows:
                yield batch(pairs, rows)
                pairs, rows = [], []
        close()
        yield batch(pairs, rows)

    return run


class _Sets:
    """Sets one after the other, as codes; values that only one set holds are left out."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        values, codes, n = np.unique(flat, return_inverse=True, return_counts=True)
        some = n[codes] > 1
        self.codes, owner = codes[some], owner[some]
        self.ends = np.searchsorted(owner, np.arange(len(sets)), side="right")
        self.starts = np.concatenate(([0], self.ends[:-1])) if len(sets) else self.ends
        self.mark = np.zeros(len(values), bool)

    def shared(self, r: int, rows: np.ndarray) -> np.ndarray:
        """How many values each of these sets shares with set r."""
        mine = self.codes[self.starts[r] : self.ends[r]]
        if not len(mine) or not len(rows):
            return np.zeros(len(rows), np.int64)
        self.mark[mine] = True
        if len(rows) * 4 < len(self.starts):
            at = np.concatenate([np.arange(self.starts[k], self.ends[k]) for k in rows])
            sums = np.concatenate(([0], np.cumsum(self.mark[self.codes[at]])))
            ends = np.cumsum(self.ends[rows] - self.starts[rows])
            got = sums[ends] - sums[np.concatenate(([0], ends[:-1]))]
        else:
            sums = np.concatenate(([0], np.cumsum(self.mark[self.codes])))
            got = sums[self.ends[rows]] - sums[self.starts[rows]]
        self.mark[mine] = False
        return got


class Tile:
    """Texts of a group or of two of its blocks, without those that can't matter: what meets what."""

    def __init__(self, key: int, ids: np.ndarray, parts: np.ndarray, c: np.ndarray, n: np.ndarray, fp: np.ndarray, gp: np.ndarray, keys: list[np.ndarray], similarity: float, max_diff: int):
        self.ids, self.parts, self.n, self.fp, self.gp = ids, parts, n, fp, gp
        _, self.cls, self.sizes = np.unique(c, return_inverse=True, return_counts=True)
        self.others = _Sets([k[k < key] for k in keys])
        self.cross = len(np.unique(parts)) > 1
        self.similarity, self.max_diff = similarity, max_diff

    def meetings(self) -> Iterator[tuple[int, np.ndarray]]:
        """(text, texts that it must be compared with): those of other classes that stand the tests and share no smaller key. Each pair
        comes once; classes may be joined meanwhile. Texts of one part meet only if there is one part."""
        done = np.zeros(len(self.ids), bool)
        # a pair of the first largest class and another text is met by the other text
        for r in np.flatnonzero(self.cls != self.sizes.argmax()):
            done[r] = True
            n = self.n[r]
            ok = ~done & (self.cls != self.cls[r]) & (np.minimum(self.n, n) >= self.similarity * np.maximum(self.n, n) - 1e-9)
            ok &= differing(self.fp ^ self.fp[r], self.gp ^ self.gp[r]) <= self.max_diff
            if self.cross:
                ok &= self.parts != self.parts[r]
            rows = np.flatnonzero(ok)
            if len(rows):
                rows = rows[self.others.shared(r, rows) == 0]
            if len(rows):
                yield int(r), rows

    def pairs(self, most: int) -> list[tuple[int, int]] | None:
        """All pairs that must be compared, or None if there are more than ``most``."""
        out: list[tuple[int, int]] = []
        for r, rows in self.meetings():
            out += [(int(self.ids[r]), int(self.ids[k])) for k in rows]
            if len(out) > most:
                return None
        return out

    def links(self, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """Links that join two classes: with the classes known before they connect what all links of the tile connect."""
        words, out = _Sets(sets), []
        for r, rows in self.meetings():
            o = words.shared(r, rows)
            for k in rows[o >= self.similarity * (self.n[rows] + self.n[r] - o) - 1e-9]:
                if self.cls[k] != self.cls[r]:
                    out.append((int(self.ids[r]), int(self.ids[k])))
                    self.cls[self.cls == self.cls[k]] = self.cls[r]
        return out


def _tiles(similarity: float, max_diff: int, dense: int | None = None):
    """Of rows sorted by (key, i, j): (key, a, b) of each tile's links, or with ``dense`` of the pairs to compare, or (key, null, null) of a tile with
    more than ``dense`` of these a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        out: list[tuple] = []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["key", "a", "b"])

        def close() -> None:
            if not held:
                return
            plain = [np.concatenate([h[k] for h in held]) for k in range(6)]
            keys, *sets = ([x for h in held for x in h[k]] for k in range(6, len(held[0])))
            tile = Tile(now[0], *plain, keys, similarity, max_diff)
            found = tile.links(*sets) if dense is None else tile.pairs(dense * len(keys))
            out.extend([(int(now[0]), None, None)] if found is None else [(int(now[0]), a, b) for a, b in found])

        for b in batches:
            if not b.num_rows:
                continue
            k, i, j = (c.to_numpy(zero_copy_only=False) for c in b.columns[:3])
            cut = np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            lists = []
            for col in b.columns[9:]:
                flat, at = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
                lists.append([flat[x:y] for x, y in zip(at, at[1:], strict=False)])
            plain = [c.to_numpy(zero_copy_only=False) for c in b.columns[3:9]]
            for s, e in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(k)])), strict=True):
                if (k[s], i[s], j[s]) != now:
                    close()
                    now, held = (k[s], i[s], j[s]), []
                held.append([*[c[s:e].copy() for c in plain], *[[v.copy() for v in x[s:e]] for x in lists]])
            if len(out) > 50_000:
                yield rows()
                out.clear()
        close()
        yield rows()

    return run


def shingle_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, s): the shingles of the documents in ``ids`` (a kept table), a row for each text."""

    def fn(b):
        return [b.column(0), pa.array([shingle_set(t, width).view(np.int64) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))]

    return keep(_map(with_keys(docs, ids, "id").select("id", "text"), fn, "id long, s array<long>"), "shingles")


def similar(docs: DataFrame, pairs: DataFrame, similarity: float, width: int) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose shingle sets have at least this similarity."""
    sets = shingle_sets(docs, keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "met-ids"), width)
    sides = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    both = sides.select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("o"))
    return both.filter(F.col("o") >= F.lit(similarity) * (F.col("n") - F.col("o")) - 1e-9).select("a", "b").distinct()


def ordered(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def near_fingerprints(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """(a, b): pairs of documents whose fingerprints differ by at most ``bits``, enough to join all that such pairs join."""
    fps = keep(fingerprints(docs, "id", "text", width), "fingerprints")
    firsts = keep(fps.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "firsts")
    equal = join_counted(fps, firsts, ["fp"], "n").filter("id != first").select(*ordered("first", "id"))
    side = lambda c: firsts.select(F.col("fp").alias(c), F.col("first").alias(f"of_{c}")).hint("shuffle_hash")
    near = fingerprint_links(fps, bits).join(side("a"), "a").join(side("b"), "b").filter("of_a != of_b").select(*ordered("of_a", "of_b"))
    return equal.unionByName(near).distinct()


def between(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) that no class of ``classes`` (id, component) holds both of."""
    side = lambda c: classes.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").filter("not (of_a <=> of_b) or of_a is null").select("a", "b")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, max_diff: int = 42, block: int = 16, dense: int = 16, tile: int = 4096, tile_shingles: int = 4_000_000, bits: int = 4) -> DataFrame:
    """(id_col, component_id) of the documents that have near copies: the smallest id reachable over similar pairs. Fingerprints link at ``bits`` or
    fewer differing bits of 64; ``max_diff`` of 128 is for pairs that the prefix join brings together."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    small_batches(spark, BATCH)
    by_print = keep(near_fingerprints(docs, width, bits), "near-fingerprints")
    small_batches(spark, BATCH)
    linked = keep(similar(docs, by_print, similarity, width), "linked")
    settled = keep(connected_components(linked), "settled")
    shared, name = spark.sparkContext.broadcast(common_shingles(docs.select("id", "text"), width)), uuid.uuid4().hex

    def keyed(b):
        common = only(("common", name), lambda: shared.value)
        parts, sizes, fps, gps = [], [], np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64)
        for k, t in enumerate(b.column(1).to_pylist()):
            hashes = np.array(shingle_hashes(t or "", width), np.uint64)
            fps[k], gps[k] = fingerprint_of(hashes), fingerprint_of(second_hashes(hashes))
            s = distinct(hashes)
            parts.append(prefix(s, similarity, *common))
            sizes.append(len(s))
        n = np.array([len(p) for p in parts])
        keys = np.concatenate(parts).view(np.int64)
        return [pa.array(keys), pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(np.repeat(np.array(sizes, np.int32), n)), *[pa.array(np.repeat(x.view(np.int64), n)) for x in (fps, gps)]]

    # one order of texts in all groups: the groups of one text's copies have much the same first texts, which meet the others once
    rows = _map(docs, keyed, KEYED).repartition("key").sortWithinPartitions("key", F.xxhash64("id"))
    met = keep(rows.mapInArrow(_met(similarity, max_diff, block), MET), "met")
    first = keep(met.filter("b is not null").select(*ordered("a", "b")).distinct(), "pairs")
    edges = keep(similar(docs, keep(between(first, settled), "open-pairs"), similarity, width).unionByName(linked), "similar")
    classes = connected_components(edges)
    large = met.filter("b is null").select("key", F.col("a").alias("id"), "n", "fp", "gp")
    if not large.isEmpty():
        known = keep(large.join(classes, "id", "left").select("key", "id", "n", "fp", "gp", F.coalesce("component", "id").alias("c")), "large")
        by = known.groupBy("key", "c").agg(F.count("*").alias("m"), F.sum("n").alias("n")).groupBy("key").agg(F.sum("m").alias("all"), F.sum("n").alias("n"), F.count("*").alias("classes"))
        groups = keep(by.filter("classes > 1").select("key", F.ceil(F.greatest(F.col("all") / tile, F.col("n") / tile_shingles)).cast("int").alias("blocks")), "large-groups")
        live = keep(known.join(groups.hint("shuffle_hash"), "key").distinct(), "live")
        found = _large_links(docs, live, first, similarity, width, max_diff, dense)
        classes = connected_components(edges.unionByName(found))
    return classes.select(F.col("id").alias(id_col), F.col("component").alias("component_id"))


def _large_links(docs: DataFrame, live: DataFrame, first: DataFrame, similarity: float, width: int, max_diff: int, dense: int) -> DataFrame:
    """(a, b): links within the large groups, enough to join the classes that all of their links join."""
    keys = keep(live.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("keys")), "large-keys")
    part = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ends = [F.least("part", "other").cast("int").alias("i"), F.greatest("part", "other").cast("int").alias("j")]
    light = live.withColumn("part", part).withColumn("other", other).select("key", *ends, "id", "part", "c", "n", "fp", "gp")
    in_tiles = lambda rows: rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    seen = keep(in_tiles(light.join(keys, "id").select(*light.columns, "keys")).mapInArrow(_tiles(similarity, max_diff, dense), "key long, a long, b long"), "large-pairs")
    pairs = keep(seen.filter("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    found = similar(docs, pairs, similarity, width)
    many = keep(seen.filter("a is null").select("key").distinct(), "dense-keys")
    if many.isEmpty():
        return found
    rows = keep(light.join(many.hint("shuffle_hash"), "key"), "dense")
    ids = keep(rows.select("id").distinct(), "dense-ids")
    whole = keep(keys.join(ids.hint("shuffle_hash"), "id").join(shingle_sets(docs, ids, width), "id"), "dense-sets")
    dealt = rows.join(whole, "id").withColumn("n", F.size("s")).select(*light.columns, "keys", "s")
    return found.unionByName(keep(in_tiles(dealt).mapInArrow(_tiles(similarity, max_diff), "key long, a long, b long").select("a", "b"), "large-links"))
