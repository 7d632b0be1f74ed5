"""The stored table: Parquet, a folder per day and batch, sorted by time inside.

Every writer, batch or stream, adds entries through ``append``: a batch is a
folder of its own below each of its days, so a batch that is written again
after a failure takes the place of what its first attempt left, and nothing of
other batches is touched. Batch names begin with the time of arrival, so
(batch, seq) is the order of arrival.

Beside the entries, in folders that Spark's readers pass over, lie the
catalogue (_series: what label sets and how many entries each batch has) and,
if it was built, the keyword index (_terms).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logquarry.functions.text import bounded_tokens
from logquarry.model import ENTRIES, LABELS, first_label, stored_size
from logquarry.plans.catalog import postings

SERIES = T.StructType([T.StructField("source", T.StringType()), T.StructField("labels", LABELS), T.StructField("entries", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("min_ts", T.LongType()), T.StructField("max_ts", T.LongType()), T.StructField("day", T.DateType()), T.StructField("batch", T.StringType())])
#: Files that a keyword look-up names to the scan; if more may match, all are scanned.
NAMED_FILES = 20_000
#: The posting that every indexed file has: no token is empty.
INDEXED = ""


def schema(promote: Sequence[str] = ()) -> T.StructType:
    """Columns of the table; ``promote`` names labels that are columns too, null where a writer did not promote them."""
    out = T.StructType(list(ENTRIES.fields)).add("ts", T.TimestampType())
    for name in promote:
        out = out.add(name, T.StringType())
    return out.add("day", T.DateType()).add("batch", T.StringType())


def batch_name(arrived_us: int | None = None, writer: str | None = None) -> str:
    """Sorts by time of arrival; a ``writer`` that names its batches by the same time and name writes the same batch."""
    return f"{time.time_ns() // 1000 if arrived_us is None else arrived_us:020d}-{writer or uuid.uuid4().hex}"


def append(df: DataFrame, path: str, promote: Sequence[str] = (), files: int | None = None, batch: str | None = None) -> None:
    """Adds entries as one batch. With ``files`` they are range-partitioned by time first, which makes each file's time span narrow.

    Labels in ``promote`` are stored as columns too, where their statistics
    let filters skip row groups.
    """
    spark, batch = df.sparkSession, batch or batch_name()
    columns = [c for c in df.columns if c not in ("batch", *promote)]
    df = df.select(*columns, *(first_label(name).alias(name) for name in promote), F.lit(batch).alias("batch"))
    if files:
        df = df.repartitionByRange(files, "day", "ts_ns")
    df = df.sortWithinPartitions("day", "batch", "ts_ns", "seq")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
    # counted from what was written: the plan of df isn't run twice
    try:
        written = spark.read.schema(schema()).option("basePath", path).parquet(f"{path}/day=*/batch={batch}")
    except AnalysisException:  # no rows, no folder
        return
    _count(written).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{path}/_series")


def _count(entries: DataFrame) -> DataFrame:
    sums = (F.count("*").alias("entries"), F.sum(stored_size()).cast("long").alias("bytes"), F.min("ts_ns").alias("min_ts"), F.max("ts_ns").alias("max_ts"))
    return entries.groupBy("source", "labels", "day", "batch").agg(*sums).select(*SERIES.names)


def compact(spark: SparkSession, path: str, day: str, promote: Sequence[str] = (), files: int = 1) -> None:
    """Merges the batches of a day into one that keeps their order of arrival; the old ones go once it is written."""
    rows = open_table(spark, path, strict=True).where(F.col("day") == F.lit(day).cast("date"))
    old = [r.batch for r in rows.select("batch").distinct().orderBy("batch").toLocalIterator()]
    if len(old) < 2:
        return
    merged = rows.orderBy("batch", "seq").withColumn("seq", F.monotonically_increasing_id())
    append(merged, path, promote, files, f"{old[-1]}-merged")
    for batch in old:
        for folder in (path, f"{path}/_series"):
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/day={day}/batch={batch}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def open_table(spark: SparkSession, path: str, promote: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """The table; unless ``strict``, broken files are passed over and what can be read is."""
    return spark.read.schema(schema(promote)).option("ignoreCorruptFiles", str(not strict).lower()).parquet(path)


def open_series(spark: SparkSession, path: str) -> DataFrame:
    """(source, labels, entries, bytes, min_ts, max_ts, day, batch): a row per label set, day and batch, far fewer than entries."""
    return spark.read.schema(SERIES).parquet(f"{path}/_series")


def rebuild_series(spark: SparkSession, path: str) -> None:
    """The catalogue of a table anew, for one that was written without."""
    _count(open_table(spark, path)).write.mode("overwrite").partitionBy("day", "batch").parquet(f"{path}/_series")


def build_terms(spark: SparkSession, path: str, terms_path: str) -> int:
    """Adds the files that it lacks to the posting table (term, file), and says how many."""
    try:
        have = {r.file for r in spark.read.parquet(terms_path).where(F.col("term") == INDEXED).select("file").distinct().toLocalIterator()}
    except AnalysisException:
        have = set()
    table = open_table(spark, path)
    new = [f for f in table.inputFiles() if _inside(f) not in have]
    if new:
        found = _of_files(table, path, new).withColumn("file", F.substring_index("_metadata.file_path", "/", -3))
        every = postings(found, "file").unionByName(found.select(F.lit(INDEXED).alias("term"), "file").distinct())
        every.repartitionByRange("term").sortWithinPartitions("term").write.mode("append").parquet(terms_path)
    return len(new)


def _inside(file: str) -> str:
    """A file's path below the table's, day and batch included, which the index knows it by."""
    return "/".join(file.split("/")[-3:])


def _of_files(table: DataFrame, path: str, files: Sequence[str]) -> DataFrame:
    return table.sparkSession.read.schema(table.schema).option("basePath", path).option("ignoreCorruptFiles", "true").parquet(*files)


def open_for_keyword(spark: SparkSession, path: str, terms_path: str, keyword: str, promote: Sequence[str] = (), most: int = NAMED_FILES) -> DataFrame:
    """The table without files that can't hold the keyword.

    Only tokens that the keyword itself delimits on both sides are looked up,
    as the others may be parts of longer tokens: a file is never skipped that
    has a match, nor one that the index doesn't know yet. Names of files are
    what Spark's own listing has on the driver too; above ``most`` that may
    match the whole table is scanned.
    """
    wanted = sorted(set(bounded_tokens(keyword)))
    table = open_table(spark, path, promote)
    if not wanted:
        return table
    try:
        terms = spark.read.parquet(terms_path)
    except AnalysisException:
        return table
    of = terms.where(F.col("term").isin(wanted)).groupBy("file").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(wanted)).select("file")
    found = {r.file for r in of.limit(most + 1).collect()}
    known = {r.file for r in terms.where(F.col("term") == INDEXED).select("file").distinct().toLocalIterator()}
    files = [f for f in table.inputFiles() if _inside(f) in found or _inside(f) not in known]
    if len(found) > most or len(files) > most:
        return table
    return _of_files(table, path, files) if files else table.limit(0)
