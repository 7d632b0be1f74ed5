"""Streams and the catalogue of labels, values and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions.text import folded, tokens
from logquarry.model import arrival, label, stored_size

SEPARATOR = "\x1f"


def stream_labels() -> Column:
    """The source first, then the entry's other labels, sorted by key alone so that equal keys keep their order."""
    every = F.concat(F.array(label("source", F.col("source"))), F.filter("labels", lambda x: x["key"] != "source"))
    placed = F.transform(every, lambda x, i: F.struct(x["key"].alias("key"), i.alias("at"), x["value"].alias("value")))
    return F.transform(F.array_sort(placed), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))


def fingerprint(labels: Column) -> Column:
    return F.array_join(F.transform(labels, lambda x: F.concat(x["key"], F.lit("="), x["value"])), SEPARATOR)


def shown_source() -> Column:
    """What a viewer calls the origin of an entry: its filename, source or job, the first that is there."""
    named = lambda k: F.nullif(F.get(F.filter("labels", lambda x: x["key"] == k), 0)["value"], F.lit(""))
    return F.coalesce(named("filename"), F.nullif("source", F.lit("")), named("job"), F.lit(""))


def with_stream(df: DataFrame) -> DataFrame:
    df = df.withColumn("stream", stream_labels())
    return df.withColumn("stream_fp", fingerprint(F.col("stream")))


def streams(df: DataFrame) -> DataFrame:
    """One row per stream of a bounded query result: stream_fp, stream, values in order of time and arrival."""
    value = F.struct("ts_ns", *arrival(df), "message")
    return with_stream(df).groupBy("stream_fp").agg(F.first("stream").alias("stream"), F.sort_array(F.collect_list(value)).alias("values"))


def label_names(df: DataFrame) -> DataFrame:
    """Keys of all labels, and source."""
    names = df.select(F.explode("labels").alias("x")).select(F.col("x.key").alias("name")).distinct()
    return names.union(df.sparkSession.createDataFrame([("source",)], "name string")).distinct()


def label_values(df: DataFrame, name: str) -> DataFrame:
    values = df.select(F.explode("labels").alias("x")).where(F.col("x.key") == name).select(F.col("x.value").alias("value"))
    if name == "source":
        values = values.union(df.select("source"))
    return values.distinct()


def series(df: DataFrame, tenant: str | None = None) -> DataFrame:
    """Distinct label sets; those of a tenant carry its label, so untagged ones belong to none."""
    found = with_stream(df.select("source", "labels").distinct()).select("stream_fp", "stream").dropDuplicates(["stream_fp"])
    return found if tenant is None else found.where(F.exists("stream", lambda x: (x["key"] == "tenant") & (x["value"] == tenant)))


def totals(df: DataFrame) -> DataFrame:
    """Entries and their bytes in the chunk format, of entries or of the kept catalogue."""
    if {"entries", "bytes"} <= set(df.columns):
        return df.agg(F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return df.agg(F.count("*").alias("entries"), F.coalesce(F.sum(stored_size()), F.lit(0)).cast("long").alias("bytes"))


def days(df: DataFrame) -> DataFrame:
    return df.groupBy("day").agg(F.min("ts_ns").alias("min_ts"), F.max("ts_ns").alias("max_ts"), F.count("*").alias("entries"))


def postings(df: DataFrame, key: str) -> DataFrame:
    """Distinct (term, key) pairs of all messages."""
    return df.select(F.explode(tokens("message")).alias("term"), key).distinct()


def token_search(df: DataFrame, token: str) -> DataFrame:
    """Rows that hold exactly this token, in either case."""
    return df.where(F.array_contains(tokens("message"), folded(token)))
