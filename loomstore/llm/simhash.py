"""SimHash near-duplicates through deletion-variant signatures.

Two fingerprints that differ by at most d bits, cut into d // 2 + 1 segments, have a
segment that differs by at most one bit (else they would differ by two bits in each). A
segment's variants are its value with one bit made a wildcard; two segments differ by at
most one bit exactly if they share a variant. The bits outside of the segment differ by d at most, so of d + 1 blocks of
them one is equal. So every distinct fingerprint is indexed
under 64 variants (wildcard place, rest of the segment), each with d + 1 blocks, and an equality grouping on
these brings all linked pairs together, where the Hamming distance is checked.

Equal fingerprints collapse before that. Within a variant's group the check walks from
a fingerprint to all it links to and takes those out of the rest: it gives one edge for
each fingerprint reached, not the pairs, and costs little in dense groups. A group of over
``block`` fingerprints is dealt out as pairs of blocks. Components come from DataFrame
rounds (``loomstore.operators.components``).

Words are runs of characters other than blanks (x20, x09-x0D) after lower-casing A-Z; a
text of fewer than ``width`` words is one shingle, and one without words has fingerprint
zero and is linked like any other. Null counts as empty. Rows that repeat an id, and rows without one, are each reported;
a null id is never the smallest of a class with others. Empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstore.operators.components import connected_components

from .common import join_counted, keep, map_arrow, small_batches

CHUNK = 200_000


def shingle_hashes(text: str, width: int) -> list[int]:
    import xxhash

    h = xxhash.xxh64_intdigest
    w = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone, and x20, x09-x0D alone
    if len(w) <= width:
        return [h(b" ".join(w), 42)] if w else []
    return [h(b" ".join(q), 42) for q in zip(*[w[i:] for i in range(width)])]


def fingerprint_batch(texts: list[str], width: int) -> np.ndarray:
    """Fingerprints as unsigned 64-bit numbers; hashes are counted in chunks of bounded size."""
    out = np.zeros(len(texts), np.uint64)
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
    pend: list[int] = []
    hashes: list[int] = []

    def ones(hs: list[int]) -> np.ndarray:
        bits = np.unpackbits(np.array(hs, np.uint64).view(np.uint8), bitorder="little").reshape(-1, 64)
        return bits

    def flush() -> None:
        if not pend:
            return
        lengths = np.array([n for _, n in pend])
        bits = ones(hashes)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        for (i, n), c in zip(pend, counts, strict=True):
            out[i] = powers[2 * c > n].sum()
        pend.clear()
        hashes.clear()

    for i, t in enumerate(texts):
        hs = shingle_hashes(t, width)
        if len(hs) > CHUNK:  # a very long text alone, piece by piece
            c = sum(ones(hs[k : k + CHUNK]).sum(0, dtype=np.int64) for k in range(0, len(hs), CHUNK))
            out[i] = powers[2 * c > len(hs)].sum()
        elif hs:
            if len(hashes) + len(hs) > CHUNK:
                flush()
            pend.append((i, len(hs)))
            hashes += hs
    flush()
    return out


def fingerprint_of(hashes: np.ndarray) -> np.uint64:
    """The fingerprint of one text's shingle hashes, repeats included."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[k : k + CHUNK].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return (np.uint64(1) << np.flatnonzero(2 * ones > len(hashes)).astype(np.uint64)).sum(dtype=np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """id_col, fp (the 64 bits as a long)."""

    def fn(b):
        return {id_col: b.column(0), "fp": fingerprint_batch([t or "" for t in b.column(1).to_pylist()], width).view(np.int64)}

    return map_arrow(docs.select(id_col, text_col), fn, f"{id_col} long, fp long")


def segments(max_diff: int, bits: int = 64) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one differs by at most one bit."""
    n = max_diff // 2 + 1
    cuts = [round(i * bits / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def variants(fps: DataFrame, max_diff: int) -> DataFrame:
    """(key, fp): rows for each wildcard place. The key holds the place and the segment without that bit, and one of the max_diff + 1
    blocks that the bits outside of the segment are cut into: of these one at least is equal. It costs that many rows more, and makes
    chance meetings some 80 times rarer."""
    place = F.col("place")
    seg = masks = F.lit(None).cast("long")
    blocks = F.lit(None).cast("array<long>")
    for start, width in segments(max_diff):
        inside = place.between(start, start + width - 1)
        masks = F.when(inside, F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << width) - 1))).otherwise(masks)
        seg = F.when(inside, F.lit(start)).otherwise(seg)
        below = F.col("fp").bitwiseAND(F.lit((1 << start) - 1))
        above = F.shiftleft(F.shiftrightunsigned("fp", start + width), start) if start + width < 64 else F.lit(0).cast("long")
        cuts = [round(i * (64 - width) / (max_diff + 1)) for i in range(max_diff + 2)]
        parts = [F.shiftrightunsigned(below.bitwiseOR(above), x).bitwiseAND(F.lit((1 << (y - x)) - 1)).cast("long") for x, y in zip(cuts, cuts[1:], strict=False)]
        blocks = F.when(inside, F.array(*parts)).otherwise(blocks)
    bit = F.expr("shiftleft(1L, cast(place - first as int))")
    rows = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("place"))
    rows = rows.select("fp", "place", masks.alias("value"), seg.alias("first"), blocks.alias("blocks"))
    key = F.shiftleft(place.cast("long"), 56) + F.col("value").bitwiseAND(F.bitwise_not(bit))
    return rows.select("fp", key.alias("key"), F.posexplode("blocks").alias("b", "v")).select(F.xxhash64("key", "b", "v").alias("key"), "fp")


def _walk(f: np.ndarray, max_diff: int) -> Iterator[tuple[int, int]]:
    """(root, member) edges that connect exactly what links of at most max_diff bits connect in ``f``."""
    rest = f
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        todo = [root]
        while todo and len(rest):
            near = np.bitwise_count(rest ^ todo.pop()) <= max_diff
            if near.any():
                got = rest[near]
                rest = rest[~near]
                todo.extend(got)
                for x in got:
                    yield int(root), int(x)


def _links(max_diff: int, block: int, defer: bool):
    """Edges of each run of equal keys (rows come sorted). With ``defer`` a run of over ``block`` rows is given back in blocks."""
    names = ["key", "part", "a", "b"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        key, part, size = None, 0, 0
        out: list[tuple] = []

        def close() -> None:
            nonlocal held, part, size
            if part:  # the rest of a deferred run
                out.extend((key, part, int(x), 0) for a in held for x in a.view(np.int64))
            elif size > 1:
                f = np.concatenate(held)
                for a, b in _walk(f, max_diff):
                    out.append((-1, -1, int(np.uint64(a).view(np.int64)), int(np.uint64(b).view(np.int64))))
            held, part, size = [], 0, 0

        for b in batches:
            ks = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[:-1]])
            fs = b.columns[-1].to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(fs):
                continue
            cut = np.flatnonzero((ks[1:] != ks[:-1]).any(axis=1)) + 1
            starts = np.concatenate(([0], cut))
            ends = np.concatenate((cut, [len(fs)]))
            # runs of one row inside the batch link nothing
            lone = (ends - starts == 1) & (starts > 0) & (ends < len(fs))
            for s, e in zip(starts[~lone], ends[~lone], strict=True):
                k = tuple(ks[s])
                now = k if len(k) > 1 else int(k[0])
                if now != key:
                    close()
                    key = now
                held.append(fs[s:e])
                size += e - s
                while defer and size > block:
                    f = np.concatenate(held)
                    out.extend((key, part, int(x), 0) for x in f[:block].view(np.int64))
                    part, held, size = part + 1, [f[block:]], len(f) - block
                if len(out) > 50_000:
                    yield batch(out)
                    out.clear()
        close()
        if out:
            yield batch(out)

    return run


LINKS = "key long, part int, a long, b long"


def fingerprint_links(fps: DataFrame, max_diff: int = 4, block: int = 20_000) -> DataFrame:
    """(a, b): edges over distinct fingerprints with the same components as all links of at most max_diff bits."""
    spark = fps.sparkSession
    # distinct fingerprints are small, but their variants aren't: all cores make them
    some = fps.select("fp").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = variants(some, max_diff).repartition("key").sortWithinPartitions("key")
    small_batches(spark, 100_000)
    first = keep(keyed.mapInArrow(_links(max_diff, block, True), LINKS), "links")
    edges = first.filter("part = -1").select("a", "b")
    hot = first.filter("part >= 0").select("key", "part", F.col("a").alias("fp"))
    if hot.isEmpty():
        return edges.distinct()
    parts = hot.groupBy("key").agg(F.max("part").alias("last"))
    other = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
    pairs = hot.join(parts, "key").select("key", "part", "fp", other).select("key", F.least("part", "other").cast("long").alias("i"), F.greatest("part", "other").cast("long").alias("j"), "fp")
    pairs = pairs.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = pairs.mapInArrow(_links(max_diff, block, False), LINKS).select("a", "b")
    return edges.union(more).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_diff: int = 4, block: int = 20_000) -> DataFrame:
    """id_col, fingerprint (16 hexadecimal digits), component_id (smallest id reachable over links)."""
    fps = keep(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes = connected_components(fingerprint_links(fps, max_diff, block))
    least = fps.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n"))
    least = keep(least.join(classes.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("root")), "least")
    roots = keep(least.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "roots")
    named = keep(join_counted(least, roots, ["root"], "members").select("fp", "n", "component_id"), "named")
    return join_counted(fps, named, ["fp"], "n").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
