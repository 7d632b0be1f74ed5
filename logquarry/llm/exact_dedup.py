"""Exact deduplication by Grace hashing.

Two levels. Each scan task first folds equal texts of its own rows in an
open-addressing table of bounded size (it hands the table on and begins anew
when full), so that a text with any number of copies leaves each task about
once. The folded groups are then dealt out by digest; each bucket is
partitioned recursively to spill files until its distinct texts fit one
open-addressing table, which compares whole contents. Rows find their group by
the id of their local group, so a text that a third of all rows share is never
a join key: its rows are spread over as many local groups as there were tasks.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import stored, text_bytes

LOCAL_BYTES = 48 << 20
BUCKET_BYTES = 96 << 20
FANOUT_BITS = 4
#: Bytes that an entry costs besides its content.
ENTRY_BYTES = 300


class ContentTable:
    """Open addressing with linear probing; equal means that the whole contents are equal."""

    def __init__(self):
        self.slots = [-1] * 1024
        self.entries: list[list] = []
        self.bytes = 0

    def _probe(self, digest: bytes, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[-8:], "little") & mask
        while (e := self.slots[at]) >= 0:
            if self.entries[e][0] == digest and self.entries[e][1] == content:
                break
            at = at + 1 & mask
        return at

    def find(self, digest: bytes, content: bytes) -> list | None:
        e = self.slots[self._probe(digest, content)]
        return self.entries[e] if e >= 0 else None

    def add(self, entry: list) -> None:
        """``entry`` begins with digest and content and must be new."""
        if 2 * len(self.entries) >= len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            for i, x in enumerate(self.entries):
                self.slots[self._probe(x[0], x[1])] = i
        self.slots[self._probe(entry[0], entry[1])] = len(self.entries)
        self.entries.append(entry)
        self.bytes += len(entry[1]) + ENTRY_BYTES


def _larger(a, b):
    return b if a is None else a if b is None else max(a, b)


def grace_groups(records: Iterable[list], memory: int = BUCKET_BYTES, level: int = 0) -> Iterator[list]:
    """Fold records [digest, content, keep, count, members] of equal content.

    When the distinct contents outgrow ``memory``, table and remaining records
    go to spill files by the next bits of the digest, and each file is folded
    in its turn. Copies never cause a spill: they add no content. Digests that
    agree in all bits end the recursion.
    """
    held, records = ContentTable(), iter(records)
    for r in records:
        if (e := held.find(r[0], r[1])) is None:
            held.add(r)
        else:
            e[2], e[3] = _larger(e[2], r[2]), e[3] + r[3]
            e[4] += r[4]
        if held.bytes > memory and (level + 1) * FANOUT_BITS <= 192 and len(held.entries) > 1:
            break
    else:
        yield from held.entries
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        names = [os.path.join(folder, str(i)) for i in range(1 << FANOUT_BITS)]
        files = [open(n, "wb") for n in names]  # noqa: SIM115
        shift = level * FANOUT_BITS

        def spill(r: list) -> None:
            bits = int.from_bytes(r[0][:24], "little") >> shift & (1 << FANOUT_BITS) - 1
            pickle.dump(r, files[bits], protocol=5)

        for r in held.entries:
            spill(r)
        del held
        for r in records:
            spill(r)
        for f in files:
            f.close()
        for n in names:
            yield from grace_groups(_read(n), memory, level + 1)
            os.remove(n)


def _read(name: str) -> Iterator[list]:
    with open(name, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _folded(batches: Iterator[pa.RecordBatch], memory: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (gid, row id, nulls) for members, (gid, null, digest, content, keep, n) for local groups."""
    schema = pa.schema([("gid", pa.int64()), ("id", id_type), ("digest", pa.binary()), ("content", pa.binary()), ("keep", id_type), ("n", pa.int64())])
    gid = TaskContext.get().partitionId() << 33
    held = ContentTable()

    def flush() -> Iterator[pa.RecordBatch]:
        for i in range(0, len(held.entries), 512):
            d, c, k, n, g = zip(*held.entries[i : i + 512], strict=True)
            yield pa.record_batch([pa.array(g, pa.int64()), pa.nulls(len(g), id_type), pa.array(d, pa.binary()), pa.array(c, pa.binary()), pa.array(k, id_type), pa.array(n, pa.int64())], schema=schema)

    for b in batches:
        gids = []
        for key, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            content = content.as_py()
            digest = hashlib.sha256(content).digest()
            if (e := held.find(digest, content)) is None:
                if held.bytes > memory:
                    yield from flush()
                    held = ContentTable()
                gid += 1
                held.add([digest, content, key, 1, gid])
                gids.append(gid)
            else:
                e[2], e[3] = _larger(e[2], key), e[3] + 1
                gids.append(e[4])
        blank = pa.nulls(b.num_rows, pa.binary())
        yield pa.record_batch([pa.array(gids, pa.int64()), b.column(0), blank, blank, pa.nulls(b.num_rows, id_type), pa.nulls(b.num_rows, pa.int64())], schema=schema)
    yield from flush()


def exact_groups(df: DataFrame, id_col: str, text_col: str, local_bytes: int = LOCAL_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when all their bytes are; null counts as empty, and empty
    texts are equal to each other; a text of any length is compared whole. An
    empty table has no rows. The row with the largest id stays. Rows
    that share both id and text are one row to this rule: all are marked kept,
    and each counts in group_size. A row with a null id is kept only when its
    whole group has null ids. Other columns of ``df`` are not looked at.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("id"), text_bytes(F.col(f"`{text_col}`")).alias("content"))
    shape = f"gid long, id {kind}, digest binary, content binary, keep {kind}, n long"

    def fold(batches):
        first = next(batches, None)
        if first is not None:
            yield from _folded((b for part in ([first], batches) for b in part), local_bytes, first.schema.field(0).type)

    def merge(batches):
        def records():
            for b in batches:
                for g, d, c, k, n in zip(*(b.column(i) for i in range(5)), strict=True):
                    yield [d.as_py(), c.as_py(), k.as_py(), n.as_py(), [g.as_py()]]

        out, key = [], None
        for d, _, k, n, members in grace_groups(records(), bucket_bytes):
            out += ((g, k, n, d.hex()) for g in members)
            if len(out) > 4096:
                yield resolved(out)
                out = []
        if out:
            yield resolved(out)

    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def resolved(out):
        g, k, n, d = zip(*out, strict=True)
        return pa.record_batch([pa.array(g, pa.int64()), pa.array(k, id_type), pa.array(n, pa.int64()), pa.array(d, pa.string())], names=["gid", "keep_id", "group_size", "text_sha256"])

    if kind not in ("bigint", "int", "string"):
        raise TypeError(f"ids of type {kind} have no defined order here")
    folded = stored(rows.mapInArrow(fold, shape))
    groups = folded.where("content is not null").select("gid", "digest", "content", "keep", "n")
    found = groups.repartition(F.substring("digest", 1, 8)).mapInArrow(merge, f"gid long, keep_id {kind}, group_size long, text_sha256 string")
    return (
        folded.where("content is null").select("gid", "id").join(found, "gid")
        .select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


def op9_grace_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""
