"""What the operators share: reading tables, the shared work folder, checked broadcasts."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.workfolder import work_folder

__all__ = ["CRC_SQL", "broadcast_if_small", "discard", "release", "scratch", "stored", "text_bytes", "work_dir"]


_scratch: ContextVar[str] = ContextVar("scratch", default="")


def work_dir(spark: SparkSession) -> str:
    """A new path in the shared folder, inside the scratch folder if there is one."""
    return f"{_scratch.get()}/{uuid.uuid4().hex}" if _scratch.get() else work_folder(spark)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """All tables that operators write inside go at the end; what is read later must be written elsewhere."""
    token = _scratch.set(work_folder(spark))
    try:
        yield
    finally:
        discard(spark, _scratch.get())
        _scratch.reset(token)


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder, or in a ``folder`` made there, and read again.

    It cuts the lineage in a way that a lost executor can't undo, and fixes
    rows whose values (generated ids) must not be computed twice.
    """
    spark = df.sparkSession
    path = f"{folder}/{uuid.uuid4().hex}" if folder else work_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a work folder whose tables nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Gives freed memory back to the system at the end of a task, as Spark keeps its Python workers for later stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
        trim(0)


def broadcast_if_small(df: DataFrame, rows: int, most: int = 1_000_000) -> DataFrame:
    """Hint a broadcast of a table of ``rows`` narrow rows only if they are few; else Spark shuffles both sides."""
    return F.broadcast(df) if rows <= most else df


def text_bytes(column) -> "F.Column":
    """The text in UTF-8, null as empty."""
    return F.coalesce(column, F.lit("")).cast("binary")


#: DuckDB's crc32 of a number's digits, bit by bit.
CRC_SQL = """xor(list_reduce([4294967295] || flatten(list_transform(string_split({}::VARCHAR, ''), lambda c: list_transform(range(0, 8), lambda k: (ascii(c) >> k) & 1))),
  lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"""
