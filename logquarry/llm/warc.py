"""WARC archives: a deterministic sharded writer and a reader.

Pages are sorted by id, then by a hash of url and payload, and shards are
ranges of that order in which as many bytes end: bounds come from exact running
sums over narrow keys, so the same pages always give the same shards, and a
page id that very many rows share is cut as well. Which records are revisits is
found on the keys, too, and meets the payloads in their shard, so payloads are
exchanged once. A task writes one gzip member per record and rolls to a new
file when the compressed size passes a limit. Records get fresh headers and
digests. A file appears under a temporary name and is renamed when complete;
the list of files is the manifest, a Parquet table that Spark commits as a
whole after all tasks. Readers open only what the manifest names, so files of
failed attempts are never read, and a repeated attempt writes the same bytes
again.

Executors reach the archive folder through pyarrow's file systems.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logquarry.llm.common import stored, text_bytes, work_dir

#: Payloads below this many bytes are never revisits.
LEAST_REVISIT = 100
#: Bytes of payloads and headers in a shard, more if there were more than so many shards (their bounds are broadcast, 17 bytes each).
SHARD_BYTES, MOST_SHARDS = 32 << 20, 100_000
#: A file is full at this part of a shard's bytes, compressed: a shard has some files.
FILE_SHARE = 16
HEADER_BYTES = 400
#: The date of all records, as a clock would make every run's bytes differ.
DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("7d0b4e0a-4d0e-4a8e-9d52-1f0f5a8f3c11")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def _clean(url: str | None) -> str:
    """A URI of one line without blanks; a missing one becomes about:blank."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "") or "about:blank"


def _block(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in [*headers, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", len(block))] if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit without payload when ``refers_to`` names the response's page."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Profile", None if refers_to is None else _REVISIT),
        ("WARC-Refers-To", None if refers_to is None else record_id(refers_to, digest)), ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-ID", page_id), ("X-Refers-To-Page-ID", refers_to), ("X-Payload-Length", len(payload)),
    ]
    return _block(headers, http + (payload if refers_to is None else b""))


def member(raw: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def info(name: str) -> bytes:
    body = b"software: logquarry\r\nformat: WARC File Format 1.1\r\n"
    return _block([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], body)


class Roller:
    """Writes records to files of a shard, the next when one is full."""

    def __init__(self, uri: str, shard: int, attempt: int, most: int):
        self.fs, self.root = pafs.FileSystem.from_uri(uri)
        self.shard, self.attempt, self.most, self.number, self.done = shard, attempt, most, 0, []
        self.out = None

    def add(self, raw: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.number:04d}.warc.gz"
            self.part = f"{self.root}/_parts/{self.name}.{self.attempt}"
            self.out, self.size, self.records, self.hash = self.fs.open_output_stream(self.part), 0, 0, hashlib.sha256()
            self._write(member(info(self.name)))
        self._write(member(raw))
        self.records += 1
        if self.size >= self.most:
            self.close()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.hash.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.fs.move(self.part, f"{self.root}/data/{self.name}")
        self.done.append((self.name, self.records, self.size, self.hash.hexdigest()))
        self.number, self.out = self.number + 1, None

    def abandon(self) -> None:
        """After an error: the unfinished file goes."""
        if self.out is not None:
            self.out.close()
            self.fs.delete_file(self.part)
            self.out = None


def _sort_keys(ids: pa.Array, hashes: pa.Array) -> np.ndarray:
    """Byte strings that sort as (null ids first, id, hash) do."""
    out = np.zeros((len(ids), 17), np.uint8)
    out[:, 0] = np.asarray(ids.is_valid())
    for at, x in ((1, ids.fill_null(0)), (9, hashes)):
        flipped = x.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        out[:, at : at + 8] = flipped.astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.reshape(-1).view("S17")


_ORDER = ("known", "page_id", "h")


def _keys(pages: DataFrame) -> DataFrame:
    """(known, page_id, h, n, size, digest): the distinct pages by id and hash of url and payload, how many are alike and their bytes together."""
    long = F.when(F.length("payload") >= LEAST_REVISIT, F.unhex(F.sha2("payload", 256)))
    keys = pages.select(F.col("page_id").isNotNull().alias("known"), "page_id", "h", (F.length("payload") + HEADER_BYTES).cast("long").alias("size"), long.alias("digest"))
    return stored(keys.groupBy(*_ORDER, "digest").agg(F.count("*").alias("n"), F.sum("size").alias("size")))


def _cut(keys: DataFrame, shard_bytes: int) -> DataFrame:
    """Keys with the first and last shard that their pages go to, by running sums of bytes."""
    spark = keys.sparkSession
    placed = stored(keys.repartitionByRange(*_ORDER).withColumn("part", F.spark_partition_id()))
    sums, before = [], 0
    for r in placed.groupBy("part").agg(F.sum("size").alias("size")).orderBy("part").collect():  # a row per task
        sums.append((r.part, before))
        before += r.size
    offsets = spark.createDataFrame(sums, "part int, offset long")
    upto = F.sum("size").over(Window.partitionBy("part").orderBy(*_ORDER, "digest").rowsBetween(Window.unboundedPreceding, 0))
    found = placed.join(F.broadcast(offsets), "part").withColumn("upto", F.col("offset") + upto)
    # a page belongs where it ends, so none is split off for a header of its predecessor
    return stored(found.withColumn("first", F.expr(f"(upto - size) div {shard_bytes}L")).withColumn("last", F.expr(f"(upto - 1) div {shard_bytes}L")).withColumn("first", F.when(F.col("n") == 1, F.col("last")).otherwise(F.col("first"))))


def _revisits(keys: DataFrame) -> DataFrame:
    """(shard, page_id, h, digest, refers_to): what pages refer to the smallest page id of an equal payload of LEAST_REVISIT bytes or more."""
    repeated = stored(keys.where("digest is not null").groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.sum("n").alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n"))
    found = keys.join(repeated, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return found.select(F.explode(F.sequence("first", "last")).alias("shard"), "page_id", "h", "digest", "refers_to")


def write_warc(pages: DataFrame, uri: str, shard_bytes: int = SHARD_BYTES, file_bytes: int | None = None) -> None:
    """Writes (page_id long, url string, html string) to a new archive at ``uri``.

    A null html is an empty payload, a null url about:blank; a null page_id is
    left out of the headers and reads back as null. Rows that repeat a page_id
    are written each; among equal payloads all rows of the smallest id are
    responses. Any long is an id, and payloads may be of any length: a shard
    has no more than ``shard_bytes`` besides the page that fills it. Rows alike
    in all three columns that outgrow a shard are dealt to several in turn. An empty
    table gives an archive without files. Other columns are not read. ``pages``
    is read twice and must give the same rows.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", text_bytes(F.col("html")).alias("payload")).withColumn("h", F.xxhash64("url", "payload"))
    keys = _keys(rows)
    total = keys.agg(F.sum("size")).first()[0] or 0
    shard_bytes = max(shard_bytes, total // MOST_SHARDS)
    file_bytes = file_bytes or shard_bytes // FILE_SHARE
    keys = _cut(keys, shard_bytes)
    # the first key of each shard: MOST_SHARDS rows and some at most
    found = keys.select(F.explode(F.sequence("first", "last")).alias("shard"), F.struct(*_ORDER).alias("key")).groupBy("shard").agg(F.min("key").alias("key")).orderBy("shard").collect()
    bounds = _sort_keys(pa.array([r.key.page_id for r in found], pa.int64()), pa.array([r.key.h for r in found], pa.int64())) if found else np.zeros(0, "S17")
    shards = np.array([r.shard for r in found], np.int64)
    sent = spark.sparkContext.broadcast((bounds, shards))
    where, root = pafs.FileSystem.from_uri(uri)
    for folder in ("data", "_parts"):
        where.create_dir(f"{root}/{folder}", recursive=True)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the shard; pages whose key several shards begin with are dealt to those in turn."""
        bounds, shards = sent.value
        turn = 0
        for b in batches:
            own = _sort_keys(b.column("page_id"), b.column("h"))
            lo, hi = np.searchsorted(bounds, own, "left"), np.searchsorted(bounds, own, "right") - 1
            several = np.flatnonzero(hi > lo)
            at = hi.copy()
            at[several] = lo[several] + (turn + np.arange(len(several))) % (hi - lo + 1)[several]
            turn += len(several)
            yield pa.record_batch([*b.columns, pa.array(shards[at])], names=[*b.schema.names, "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, refers = None, None, {}
        try:
            for b in batches:
                for page, h, shard, page_kind, url, payload, digest, to in zip(*b.columns, strict=True):
                    if (key := (page.as_py(), h.as_py())) != at:
                        at, refers = key, {}
                    if not page_kind.as_py():
                        refers[digest.as_py()] = to.as_py()
                        continue
                    if out is None:
                        out = Roller(uri, shard.as_py(), TaskContext.get().taskAttemptId(), file_bytes)
                    raw = payload.as_py()
                    out.add(record(key[0], url.as_py(), raw, refers.get(hashlib.sha256(raw).digest()) if refers else None))
            if out is not None:
                out.close()
        except BaseException:
            if out is not None:
                out.abandon()
            raise
        if out is not None:
            name, records, size, digest = zip(*out.done, strict=True)
            yield pa.record_batch([pa.array(name), pa.array(records, pa.int64()), pa.array(size, pa.int64()), pa.array(digest)], names=["file", "records", "bytes", "sha256"])

    full = rows.select("page_id", "h", "url", "payload").mapInArrow(place, "page_id long, h long, url string, payload binary, shard long")
    full = full.select("page_id", "h", "shard", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("refers_to"))
    marks = _revisits(keys).select("page_id", "h", "shard", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "refers_to")
    n = int(shards[-1]) + 1 if len(shards) else 1
    # the revisits' marks come before the pages that they are of
    dealt = full.unionByName(marks).repartitionById(n, F.col("shard").cast("int")).sortWithinPartitions("page_id", "h", "kind", "url", "payload")
    dealt.mapInArrow(run, "file string, records long, bytes long, sha256 string").write.parquet(f"{uri}/manifest")
    where.delete_dir(f"{root}/_parts")


def records_in(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and blocks of a gzipped WARC stream, one record in memory at a time."""
    d, parts, data = zlib.decompressobj(31), [], stream.read(1 << 18)
    while data:
        parts.append(d.decompress(data))
        if d.eof:
            yield _parsed(b"".join(parts))
            parts, data, d = [], d.unused_data, zlib.decompressobj(31)
            if data:
                continue
        data = stream.read(1 << 18)
    if any(parts):
        raise ValueError("the last record is cut off")


def _parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    size = int(headers["content-length"])
    block = rest[:size]
    if version != "WARC/1.1" or rest[size:] != b"\r\n\r\n" or headers["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"broken record {headers.get('warc-record-id')}")
    return headers, block


def read_warc(spark: SparkSession, uri: str, payloads: bool = False) -> DataFrame:
    """The page records of an archive: ids, url, type, what is referred to, size and digest of the full payload.

    Block digests, payload digests and the manifest's file digests are checked.
    With ``payloads`` responses carry their html; revisits have null.
    """
    manifest = spark.read.schema("file string, records long, bytes long, sha256 string").parquet(f"{uri}/manifest")
    shape = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", html string" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = pafs.FileSystem.from_uri(uri)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * payloads]
        names = [x.split()[0] for x in shape.split(", ")]
        for b in batches:
            for name, digest in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held = []
                with where.open_input_stream(f"{root}/data/{name}", compression=None) as stream:
                    sums = _Summed(stream)
                    for headers, block in records_in(sums):
                        if headers["warc-type"] != "warcinfo":
                            held.append(_page(headers, block)[: len(names)])
                        if len(held) == 256:
                            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                            held = []
                if sums.hash.hexdigest() != digest:
                    raise ValueError(f"{name} differs from the manifest")
                if held:
                    yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    tasks = max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism))
    return manifest.select("file", "sha256").repartition(tasks).mapInArrow(run, shape)


class _Summed:
    def __init__(self, stream):
        self.stream, self.hash = stream, hashlib.sha256()

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.hash.update(data)
        return data


def _page(h: dict[str, str], block: bytes) -> tuple:
    payload, number = block.partition(b"\r\n\r\n")[2], lambda k: int(h[k]) if k in h else None
    digest = h["warc-payload-digest"].removeprefix("sha256:")
    if h["warc-type"] == "response":
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"broken payload of {h['warc-record-id']}")
        return number("x-page-id"), h["warc-target-uri"], len(payload), digest, "response", None, payload.decode()
    return number("x-page-id"), h["warc-target-uri"], number("x-payload-length"), digest, h["warc-type"], number("x-refers-to-page-id"), None


def op4_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = work_dir(spark)
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), uri)
    return read_warc(spark, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
f AS (SELECT t, min(page_id) AS first FROM p WHERE strlen(t) >= 100 GROUP BY t)
SELECT page_id, strlen(p.t)::BIGINT AS payload_bytes, sha256(p.t) AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.t = f.t
"""
