"""From raw lines to log entries: JSON lift, time, labels, tenant."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.functions.times import line_time
from logquarry.model import NO_LABELS, label, no_labels, with_time

HTTP_SOURCE = "http"
PUSH_SOURCE = "loki-push"
DEFAULT_TENANT = "default"


def tenant_id(header: str | None) -> str:
    """The tenant of a request header; default if it is empty or has a character outside A-Z a-z 0-9 _ . -"""
    value = (header or "").strip(" \t")
    return value if re.fullmatch(r"[A-Za-z0-9_.-]+", value) else DEFAULT_TENANT


def split_lines(df: DataFrame, column: str, source: str = HTTP_SOURCE, keep: Sequence[str] = ()) -> DataFrame:
    """(source, line, at, ...) for every line that isn't empty; only a line feed ends a line."""
    lines = df.select(*keep, F.posexplode(F.split(column, "\n", -1)).alias("at", "line"))
    return lines.where(F.length("line") > 0).withColumn("source", F.lit(source))


def parsed(df: DataFrame, now_ns: Column | None = None) -> DataFrame:
    """Adds message, raw_line and ts_ns to (line, ...).

    A line that begins with { is read as JSON: its string message, else msg,
    is the message; its string timestamp, else ts, is the time. Whatever is
    missing or doesn't parse falls back to the line and the present.
    """
    now = F.unix_micros(F.current_timestamp()) * 1000 if now_ns is None else now_ns
    json = F.when(F.startswith(F.col("line"), F.lit("{")), F.col("line"))
    fields = F.from_json(json, "message string, msg string, timestamp string, ts string")
    quoted = lambda k: F.when(F.rlike(json, F.lit(f'"{k}"\\s*:\\s*"')), fields[k])
    message = F.coalesce(quoted("message"), quoted("msg"), F.col("line"))
    time = line_time(F.coalesce(quoted("timestamp"), quoted("ts")))
    return df.withColumn("message", message).withColumn("raw_line", F.col("line")).withColumn("ts_ns", F.coalesce(F.nullif(time, F.lit(0)), now))


def source_labels(jobs: Sequence[Mapping]) -> list[tuple[str, list[tuple[str, str]]]]:
    """(source, labels) for each path of scrape jobs {job, paths, labels}: job and filename come before the job's own."""
    return [(path, [("job", j.get("job", "default")), ("filename", path), *dict(j.get("labels", {})).items()]) for j in jobs for path in j.get("paths", ())]


def label_table(spark: SparkSession, jobs: Sequence[Mapping]) -> DataFrame:
    return spark.createDataFrame(source_labels(jobs), f"source string, source_labels {NO_LABELS}")


def enriched(df: DataFrame, table: DataFrame | None = None, tenant: str | None = None) -> DataFrame:
    """Adds labels: those of the source in ``table`` (a left join), and the tenant last.

    The table is a configuration: a row per scraped path. Spark broadcasts it
    when its size allows.
    """
    if table is None:
        df = df.withColumn("labels", no_labels())
    else:
        df = df.join(table, "source", "left").withColumn("labels", F.coalesce("source_labels", no_labels())).drop("source_labels")
    return df.withColumn("labels", F.concat("labels", F.array(label("tenant", tenant)))) if tenant else df


def entries(df: DataFrame, seq: Column) -> DataFrame:
    """The columns of the table, from parsed and enriched lines; ``seq`` is the order of arrival."""
    return with_time(df.withColumn("seq", seq).select("seq", "ts_ns", "source", "message", "raw_line", "labels"))


PUSH_SCHEMA = "streams array<struct<stream:string,values:array<array<string>>>>"


def pushed(df: DataFrame, body: str, keep: Sequence[str] = ()) -> DataFrame:
    """(stream, ts_text, line, source, at, at_value, ...) of push bodies {"streams": [{"stream": {...}, "values": [[ns, line], ...]}]}.

    The source is the first of the labels job and filename in the order of
    the object, else a fixed name. Empty lines go, members after the second
    are not read, and a body without streams has no rows.
    """
    stream = F.posexplode(F.from_json(body, PUSH_SCHEMA)["streams"]).alias("at", "s")
    rows = df.select(*keep, stream)
    rows = rows.select(*keep, "at", F.coalesce("s.stream", F.lit("{}")).alias("stream"), F.posexplode("s.values").alias("at_value", "v"))
    rows = rows.select(*keep, "at", "at_value", "stream", F.get("v", 0).alias("ts_text"), F.get("v", 1).alias("line")).where(F.length("line") > 0)
    keys = F.json_object_keys("stream")
    first = F.get(F.filter(keys, lambda k: k.isin("job", "filename")), 0)
    value = F.element_at(F.from_json("stream", "map<string,string>", {"mode": "PERMISSIVE"}), first)
    return rows.withColumn("source", F.coalesce(F.when(first.isNotNull(), value), F.lit(PUSH_SOURCE)))


def push_time(text: Column, now_ns: Column) -> Column:
    """Nanoseconds of a push value, the present if it is none. Offered for tables that want it: pushed entries are timed on arrival."""
    return F.coalesce(text.try_cast("long"), now_ns)
