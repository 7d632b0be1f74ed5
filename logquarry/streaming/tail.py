"""Streams: ingest from tailed files into the table, live tails, running metrics."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logquarry.operators.ingest import enriched, entries, label_table, parsed
from logquarry.plans.language import Query
from logquarry.plans.metrics import group_label
from logquarry.plans.predicates import selected
from logquarry.sources import table
from logquarry.sources.bytetail import ByteTail

#: A live-tail event above this many bytes is left out.
LARGEST_EVENT = 8192


def tailed(spark: SparkSession, paths: Sequence[str], jobs: Sequence[Mapping] = (), earliest: bool = False, positions: str = "", most_bytes: int = 0) -> DataFrame:
    """A stream of entries from files; seq is the offset of the line in its file. ``most_bytes`` bounds what a batch reads of each file."""
    spark.dataSource.register(ByteTail)
    options = {"paths": ",".join(paths), "startingOffset": "earliest" if earliest else "latest", "positions": positions, "maxBytesPerBatch": str(most_bytes)}
    lines = spark.readStream.format("bytetail").options(**options).load()
    return entries(enriched(parsed(lines), label_table(spark, jobs) if jobs else None), F.col("at"))


def ingest(stream: DataFrame, path: str, checkpoint: str, every: str = "1 second", available_now: bool = False, promote: Sequence[str] = ()) -> StreamingQuery:
    """Appends a stream of entries to the table, each entry exactly once across restarts.

    A batch that Spark runs again has the same rows, time and number, so the
    same name, and takes the place of the first attempt. seq becomes the place
    in the batch.
    """
    writer = f"{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}"

    def add(batch: DataFrame, number: int) -> None:
        if first := batch.head(1):
            rows = batch.drop("arrived").withColumn("seq", F.monotonically_increasing_id())
            table.append(rows, path, promote, batch=table.batch_name(first[0].arrived, f"{writer}-{number}"))

    timed = stream.withColumn("arrived", F.unix_micros(F.current_timestamp()))  # the batch's time, also when it is run again
    out = timed.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime=every)).start()


def subscribe(stream: DataFrame, notify: Callable[[DataFrame, int], None], query: Query | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Calls notify(batch, number) for every batch; unfiltered unless a query is given. A slow subscriber doesn't hold up ingestion."""
    stream = stream if query is None else selected(stream, query)
    writer = stream.writeStream.foreachBatch(notify)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def event_json(df: DataFrame) -> DataFrame:
    """One event text per entry: {"ts": ns, "src": source, "msg": message}; too long ones are left out."""
    out = df.select(F.concat(F.lit("data: "), F.to_json(F.struct(F.col("ts_ns").alias("ts"), F.col("source").alias("src"), F.col("message").alias("msg"))), F.lit("\n\n")).alias("event"))
    return out.where(F.octet_length("event") <= LARGEST_EVENT)


def frame_json(df: DataFrame) -> DataFrame:
    """One stream object per entry, with the source as its only label."""
    values = F.array(F.array(F.col("ts_ns").cast("string"), F.col("message")))
    one = F.struct(F.struct("source").alias("stream"), values.alias("values"))
    return df.select(F.to_json(F.struct(F.array(one).alias("streams"))).alias("frame"))


def running_metric(stream: DataFrame, query: Query, step: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """A metric over a stream in tumbling windows; a window is final when the watermark has passed it."""
    names = list(query.metric.by)
    rows = selected(stream, query).select("ts", *(group_label(n).alias(n) for n in names)).withWatermark("ts", late)
    counted = rows.groupBy(*names, F.window("ts", step).alias("w")).agg(F.count("*").alias("n"))
    value = F.col("n").cast("double")
    if query.metric.op == "rate":
        value = value / F.lit(float(query.metric.range_s)) if query.metric.range_s else F.lit(float("inf"))
    return counted.select(*names, (F.unix_micros("w.start") * 1000).alias("ts_ns"), value.alias("value"))
