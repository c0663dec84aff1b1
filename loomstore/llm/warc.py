"""A deterministic sharded WARC writer, and the reader of its archives.

* Payload digests decide what a record is: of equal payloads of at least
  ``min_revisit_bytes`` the one with the smallest id is a response, the others are
  revisits of it.
* Records are range-sorted by id into shards of at most ``shard_records`` (more only if there would be over ``MAX_SHARDS`` of them, or
  one id has more rows). Their bounds come from a histogram of the ids whose heavy bins are cut again until they are light, so
  they depend on the rows alone. A shard rolls to a new file when its compressed size passes ``roll_bytes``.
* Headers are made anew from the row (record id, date, digests, lengths), each record is
  one gzip member without a time stamp: equal rows give equal bytes.
* A task writes under temporary names and returns manifest rows. The files of the tasks that counted are moved to their
  names (by tasks too; a move that was made already is left as it is), MANIFEST.json is written last, and
  the rest is dropped: a lost executor leaves nothing that a reader would see.

Null payloads count as empty ones; null urls as "". Rows without an id are left out, for a
record is named by its id. Runs of white space in urls become one space, as headers are lines. A repeated id raises an error unless ``repeats`` is set: then each of its rows gets a record
with its own payload's digest, and what repeats both id and payload is numbered in the record id. An empty table gives a manifest
without files. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, join_counted, keep, small_batches

BINS = 4096
#: Bits by which a heavy bin is cut.
FINER = 6
MAX_SHARDS = 100_000
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "file string, tmp string, shard int, part int, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32_of_hex(hex40: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: 5 of these are 4 letters."""

    def group(g: Column) -> Column:
        v = F.conv(F.substr(hex40, g * 5 + 1, F.lit(5)), 16, 10).cast("int")
        letter = lambda shift: F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
        return F.concat(*[letter(s) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), group), "")


def plan_records(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: from ids and digests only."""
    body = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    # the digest stands in a column of its own: the 32 letters made of it must not each take it anew
    hashed = pages.select(F.col(id_col).alias("page_id"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("hex"), F.xxhash64(body).alias("check"))
    # payloads made to share a SHA-1 differ in the other hash
    ids = keep(hashed.select("page_id", "payload_bytes", base32_of_hex(F.col("hex")).alias("payload_digest"), "check"), "payloads")
    same = ["payload_digest", "payload_bytes", "check"]
    large = ids.filter(F.col("payload_bytes") >= min_revisit_bytes)
    first = keep(large.groupBy(*same).agg(F.min("page_id").alias("first"), F.count("*").alias("n")), "payload-groups")
    refers = F.when(F.col("first") < F.col("page_id"), F.col("first"))
    known = join_counted(large, first, same, "n").select("page_id", "payload_bytes", "payload_digest", refers.alias("refers_to"))
    small = ids.filter(F.col("payload_bytes") < min_revisit_bytes).select("page_id", "payload_bytes", "payload_digest", F.lit(None).cast("long").alias("refers_to"))
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    return known.unionByName(small).select("page_id", "payload_bytes", "payload_digest", kind.alias("record_type"), "refers_to")


def shard_bounds(ids: DataFrame, shard_records: int) -> list[int]:
    """First ids of the shards but the first one. Bins are ranges of ids that agree in their upper bits."""
    lo, hi, n = ids.agg(F.min("page_id"), F.max("page_id"), F.count("page_id")).first()
    if lo is None:
        return []
    most = max(shard_records, -(-n // MAX_SHARDS))
    shift = next(k for k in range(65) if (hi >> k) - (lo >> k) < BINS)
    light: list[tuple[int, int]] = []
    heavy = None
    while True:
        rows = ids
        if heavy is not None:
            # each has over ``most`` rows, so there are at most MAX_SHARDS
            rows = ids.join(F.broadcast(ids.sparkSession.createDataFrame(heavy, "bin long")), F.shiftright("page_id", above) == F.col("bin"))
        bins = [(v << shift, c, v) for v, c in rows.groupBy(F.shiftright("page_id", shift).alias("v")).count().collect()]
        light += [(a, c) for a, c, _ in bins if c <= most or not shift]
        heavy = [(v,) for _, c, v in bins if c > most and shift]
        if not heavy:
            break
        above, shift = shift, max(0, shift - FINER)
    bounds, n = [], 0
    for a, c in sorted(light):
        if n and n + c > most:
            bounds.append(a)
            n = 0
        n += c
    return bounds


def with_shard(df: DataFrame, bounds: list[int]) -> DataFrame:
    """``df`` and its column shard: how many bounds are at most page_id, by binary search, a step a projection."""
    if not bounds:
        return df.withColumn("shard", F.lit(0))
    table = df.sparkSession.createDataFrame([(bounds,)], "bounds array<long>").scalar()
    df = df.withColumn("shard", F.lit(0))
    for k in reversed(range(len(bounds).bit_length())):
        there = F.get(table, F.col("shard") + ((1 << k) - 1)) <= F.col("page_id")
        df = df.withColumn("shard", F.col("shard") + F.when(there, 1 << k).otherwise(0))
    return df


def _open(path: str):
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs, at


def _record(page_id: int, url: str, payload: bytes, size: int, digest: str, kind: str, refers: int | None, again: int = 0) -> bytes:
    rid = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}:{digest}" + (f":{again}" if again else ""))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{rid}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Page-ID: {page_id}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {size}",
        "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page-ID: {refers}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers}:{digest}')}>"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write_warc(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roll_bytes: int = 256 << 20, shard_records: int = 5_000, min_revisit_bytes: int = 0, repeats: bool = False) -> str:
    """Writes the archives under ``path`` and returns it; MANIFEST.json lists the files."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    pages = pages.filter(F.col(id_col).isNotNull())
    tmp = f"{path}/_tmp-{uuid.uuid4().hex}"
    plan = plan_records(pages, id_col, html_col, min_revisit_bytes)
    plan = keep(plan, "warc-plan")
    bounds = shard_bounds(plan.select("page_id"), shard_records)
    # one shuffle: what the plan says of a page stands right before the page in its shard
    said = plan.select("page_id", F.lit(0).alias("page"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "payload_bytes", "payload_digest", "record_type", "refers_to")
    own = F.col(id_col).cast("long").alias("page_id")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("payload_bytes", "long"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "long"))]
    body = pages.select(own, F.lit(1).alias("page"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), *none)
    said, body = (with_shard(x, bounds).select("shard", *x.columns) for x in (said, body))
    rows = said.unionByName(body).repartition(max(1, len(bounds) + 1), "shard").sortWithinPartitions("shard", "page_id", "page", *(("url", "html") if repeats else ()))
    small_batches(spark, 500)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = now = None
        plans: dict[str, list] = {}  # of the current id, by digest: what the plan says, records so far, rows planned
        out = name = sha = None
        shard_now = part = size = n = 0
        done: list[tuple] = []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"part-{shard_now:06d}-{part:04d}.warc.gz", name, shard_now, part, n, size, sha.hexdigest()))
                out = None

        for b in batches:
            for s, i, page, url, html, *meta in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if not page:
                    if i != now:
                        now, plans = i, {}
                    plans.setdefault(meta[1], [meta, 0, 0])[2] += 1
                    continue
                if i != now or not repeats and sum(p[2] for p in plans.values()) != 1:
                    raise ValueError(f"page {i} has no plan of its own: are ids unique?")
                body = html.encode()
                mine = next(iter(plans.values())) if len(plans) == 1 else plans[base64.b32encode(hashlib.sha1(body).digest()).decode()]
                length, digest, kind, refers = mine[0]
                mine[1] += 1
                if out is not None and (s != shard_now or size >= roll_bytes):
                    close()
                    part = part + 1 if s == shard_now else 0
                elif out is None:
                    part = 0
                if out is None:
                    shard_now, size, n, sha = s, 0, 0, hashlib.sha256()
                    name = f"{tmp}/{s:06d}-{part:04d}-{uuid.uuid4().hex}"
                    if fs is None:
                        fs, at = _open(tmp)
                        fs.create_dir(at, recursive=True)
                    out = fs.open_output_stream(_open(name)[1], compression=None)
                raw = _record(i, " ".join(url.split()), body, length, digest, kind, refers, mine[1] - 1)
                out.write(raw)
                sha.update(raw)
                size += len(raw)
                n += 1
        close()
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "tmp", "shard", "part", "records", "bytes", "sha256"), d, strict=True)) for d in done], schema=pa.schema([("file", pa.string()), ("tmp", pa.string()), ("shard", pa.int32()), ("part", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    files = sorted((r.asDict() for r in rows.mapInArrow(write, MANIFEST).collect()), key=lambda r: r["file"])
    _commit(spark, path, tmp, files)
    return path


def _commit(spark: SparkSession, path: str, tmp: str, files: list[dict]) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tmp, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                to = f"{path}/{name}"
                where, source = _open(tmp)
                # a task that is run again finds some files moved
                if where.get_file_info(source).type == pafs.FileType.NotFound and where.get_file_info(_open(to)[1]).type == pafs.FileType.File:
                    continue
                where.move(source, _open(to)[1])
            yield b

    if files:
        todo = spark.createDataFrame([(f.pop("tmp"), f["file"]) for f in files], "tmp string, file string").repartition(max(1, len(files) // 64))
        if todo.mapInArrow(move, "tmp string, file string").count() != len(files):
            raise OSError("not all files were moved")
    fs.delete(jvm.org.apache.hadoop.fs.Path(tmp), True)
    out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{path}/MANIFEST.json"), True)
    out.write(bytearray(json.dumps({"files": files}, sort_keys=True).encode()))
    out.close()


def manifest(spark: SparkSession, path: str) -> list[dict]:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/MANIFEST.json")
    s = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return json.loads(bytes(s.readAllBytes()))["files"]
    finally:
        s.close()


def _records(stream) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record of one archive: one gzip member at a time."""
    rest, eof = b"", False
    while True:
        z, raw = zlib.decompressobj(31), []
        while not z.eof:
            if not rest:
                rest = stream.read(1 << 16)
                eof = not rest
                if eof:
                    break
            raw.append(z.decompress(rest))
            rest = z.unused_data
        if not z.eof:
            if any(raw):
                raise ValueError("an archive ends inside a record")
            return
        head, _, body = b"".join(raw).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        yield fields, body[: int(fields["Content-Length"])]


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the files in the manifest; block digests and lengths are checked."""
    files = manifest(spark, path)
    if not files:
        return spark.createDataFrame([], RECORD)
    todo = spark.createDataFrame([(f["file"],) for f in files], "file string").repartition(len(files), "file")
    schema = RECORD if payloads else RECORD.replace(", payload binary", "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                fs, at = _open(f"{path}/{name}")
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for f, block in _records(stream):
                        if "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != f["WARC-Block-Digest"]:
                            raise ValueError(f"{name}: a block doesn't match its digest")
                        body = block.partition(b"\r\n\r\n")[2] if f["WARC-Type"] == "response" else None
                        size = int(f["WARC-Payload-Length"])
                        if body is not None:
                            digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                            if len(body) != size or f["WARC-Payload-Digest"] != f"sha1:{digest}":
                                raise ValueError(f"{name}: a payload doesn't match its digest")
                        refers = f.get("WARC-Refers-To-Page-ID")
                        row = (int(f["WARC-Page-ID"]), f.get("WARC-Target-URI", ""), size, f["WARC-Payload-Digest"][5:], f["WARC-Type"], int(refers) if refers else None, body)
                        rows.append(dict(zip(names, row, strict=False)))
                        held += len(body or b"") if payloads else 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return todo.mapInArrow(read, schema)
