"""Reader (and writer, for fixtures) of the binary chunk and journal files."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterable, Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.model import NO_LABELS, with_time

# Fixed values of the format, little-endian throughout.
# Header of 32 bytes: magic, version u16, flags u16, entries u32, reserved u32, data size u64, compressed size u64.
# Entry: time i64, source u16 + bytes, labels u16 + bytes ("key=value,key=value"), message u32 + bytes.
MAGIC = b"AMTZ"
VERSION = 1
COMPRESSED, FINALIZED = 1, 2
#: Bytes of entries at which a chunk is full.
CHUNK_BYTES = 10 << 20
_HEADER = struct.Struct("<4sHHIIQQ")
_TIME, _SHORT, _LONG = struct.Struct("<q"), struct.Struct("<H"), struct.Struct("<I")

#: Bytes of a piece of a file: Spark sends 10,000 rows at once if they have less than 64 MB, and a worker may hold two such batches.
_PIECE = 1 << 8
#: Entries, and bytes of them, that a worker has as objects at once.
_ENTRIES, _BYTES = 4096, 4 << 20

Entry = tuple[int, bytes, list[tuple[str, str]], bytes]


class ChunkError(ValueError):
    """The bytes are no such file."""


def frames(data: bytes) -> Iterator[Entry]:
    """Entries one after another; raises at the first that is cut off."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ChunkError(f"an entry is cut off at byte {at}")
        at += n
        return data[at - n : at]

    while at < len(data):
        (time,) = _TIME.unpack(take(8))
        source = take(*_SHORT.unpack(take(2)))
        labels = take(*_SHORT.unpack(take(2))).decode("utf-8", "replace")
        message = take(*_LONG.unpack(take(4)))
        pairs = [(k, v) for x in labels.split(",") for k, eq, v in [x.partition("=")] if eq]
        yield time, source, pairs, message


def decode_chunk(data: bytes) -> Iterator[Entry]:
    """As many entries as the header counts. A payload that was not finalized is never compressed, whatever the flag says."""
    if len(data) < _HEADER.size:
        raise ChunkError("the header is cut off")
    magic, version, flags, count, _, size, _ = _HEADER.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ChunkError("wrong magic or version")
    payload = data[_HEADER.size :]
    if flags & COMPRESSED and flags & FINALIZED and size:
        payload = gzip.decompress(payload[:size])
    found = frames(payload)
    for _ in range(count):
        entry = next(found, None)
        if entry is None:
            raise ChunkError("fewer entries than the header counts")
        yield entry


def decode_journal(data: bytes) -> Iterator[Entry]:
    """Entries up to the first that doesn't decode."""
    try:
        yield from frames(data)
    except ChunkError:
        return


def encode_entry(time: int, source: bytes, labels: Iterable[tuple[str, str]], message: bytes) -> bytes:
    joined = ",".join(f"{k}={v}" for k, v in labels).encode()
    return b"".join((_TIME.pack(time), _SHORT.pack(len(source)), source, _SHORT.pack(len(joined)), joined, _LONG.pack(len(message)), message))


def encode_chunk(entries: Iterable[Entry], compressed: bool = False, finalized: bool = True) -> bytes:
    return _chunk([encode_entry(*e) for e in entries], compressed, finalized)


def _chunk(parts: list[bytes], compressed: bool, finalized: bool = True) -> bytes:
    payload = b"".join(parts)
    if compressed and finalized:
        payload = gzip.compress(payload)
    return _HEADER.pack(MAGIC, VERSION, COMPRESSED * compressed | FINALIZED * finalized, len(parts), 0, len(payload), 0) + payload


def decoded(files: DataFrame, journal: bool = False, ignore_corrupt: bool = True) -> DataFrame:
    """(path, at, ts_ns, source, message, labels) of every entry of (path, content), each file in one task.

    Of a broken chunk the entries before the break are kept; with
    ``ignore_corrupt`` off it fails the query.

    A worker holds some copies of the bytes of one file and a bounded number of
    entries, however many files a task has.
    """
    decode = decode_journal if journal else decode_chunk

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, data in _whole(batches):
            at = 0
            for held in _bounded(_readable(decode, data, ignore_corrupt)):
                text = lambda i: pa.array([x[i].decode("utf-8", "replace") for x in held], pa.string())  # noqa: E731, B023
                pairs = [pa.array([p[i] for x in held for p in x[2]], pa.string()) for i in (0, 1)]
                labels = pa.ListArray.from_arrays(pa.array(accumulate((len(x[2]) for x in held), initial=0), pa.int32()), pa.StructArray.from_arrays(pairs, names=["key", "value"]))
                yield pa.record_batch([pa.array([name] * len(held), pa.string()), pa.array(range(at, at + len(held)), pa.int64()), pa.array([x[0] for x in held], pa.int64()), text(1), text(3), labels], names=["path", "at", "ts_ns", "source", "message", "labels"])
                at += len(held)

    # No exchange follows, so the pieces of a file reach the task one after another. As a variable, what gives the content is evaluated once and not for every piece.
    pieces = F.expr(f"transform(array(content), c -> transform(sequence(0, greatest(octet_length(c) - 1, 0) div {_PIECE}), i -> substring(c, int(i * {_PIECE} + 1), {_PIECE})))[0]")
    rows = files.select("path", F.posexplode(pieces).alias("place", "piece")).select(F.when(F.col("place") == 0, F.col("path")).alias("path"), "place", "piece")
    return rows.mapInArrow(run, f"path string, at long, ts_ns long, source string, message string, labels {NO_LABELS}")


def _pairs(labels: pa.ListArray) -> Iterator[list[tuple[str, str]]]:
    """The labels of each entry; structs one by one would take most of a worker's time."""
    ends = labels.offsets.to_pylist()
    flat = labels.values.slice(ends[0], ends[-1] - ends[0])
    pairs = list(zip(flat.field("key").to_pylist(), flat.field("value").to_pylist(), strict=True))
    return (pairs[a - ends[0] : b - ends[0]] for a, b in pairwise(ends))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(path, content) of each file, from its pieces; the first one has the path."""
    path, held = None, []
    for b in batches:
        for name, place, piece in zip(*(b.column(c).to_pylist() for c in ("path", "place", "piece")), strict=True):
            if place == 0:
                if held:
                    yield path, b"".join(held)
                path, held = name, []
            held.append(piece)
    if held:
        yield path, b"".join(held)


def _bounded(entries: Iterator[Entry]) -> Iterator[list[Entry]]:
    """The entries in lists of at most so many, or of so many bytes."""
    held, size = [], 0
    for e in entries:
        held.append(e)
        size += len(e[1]) + len(e[3]) + sum(len(k) + len(v) for k, v in e[2])
        if len(held) == _ENTRIES or size >= _BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def read_chunks(spark: SparkSession, path: str, journal: bool = False, ignore_corrupt: bool = True) -> DataFrame:
    """Log entries of all chunk (or journal) files below ``path``, a folder or a glob, with the columns of the table.

    Files are small by format (10 MB), so a task decodes whole ones. seq orders
    files by name and entries by place.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # one row per file, in name order; of at most 512 ranges, so that a number of 42 bits leaves 20 for the place
    numbers = files.select("path").repartitionByRange(512, "path").sortWithinPartitions("path").withColumn("file", F.monotonically_increasing_id())
    rows = decoded(files, journal, ignore_corrupt).join(numbers, "path").withColumn("seq", F.shiftleft("file", 20) + F.col("at"))
    return with_time(rows.select("seq", "ts_ns", "source", "message", F.col("message").alias("raw_line"), "labels"))


def encoded(df: DataFrame, compressed: bool = True) -> DataFrame:
    """(path, content): chunks of (seq, ts_ns, source, message, labels), for fixtures; one is full at ``CHUNK_BYTES`` or ends with a batch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, parts, size = None, [], 0
            for at in range(0, b.num_rows, _ENTRIES):
                few = b.slice(at, _ENTRIES)
                for seq, t, s, labels, m in zip(*(few.column(c).to_pylist() for c in ("seq", "ts_ns", "source")), _pairs(few.column("labels")), few.column("message").to_pylist(), strict=True):
                    if not parts:
                        first = seq
                    parts.append(encode_entry(t, s.encode(), labels, m.encode()))
                    size += len(parts[-1])
                    if size >= CHUNK_BYTES:
                        yield chunk(first, parts)
                        parts, size = [], 0
            if parts:
                yield chunk(first, parts)

    def chunk(first: int, parts: list[bytes]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([f"chunk-{first:012d}"]), pa.array([_chunk(parts, compressed)], pa.binary())], names=["path", "content"])

    return df.select("seq", "ts_ns", "source", "message", "labels").mapInArrow(run, "path string, content binary")


def _readable(decode, data: bytes, ignore_corrupt: bool) -> Iterator[Entry]:
    try:
        yield from decode(data)
    except (ChunkError, OSError, EOFError):
        if not ignore_corrupt:
            raise
