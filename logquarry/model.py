"""The one logical table: log entries.

``ts_ns`` is the truth; ``ts`` (microseconds) and ``day`` repeat it coarsely,
so that bounds reach Parquet's statistics and the partition folders. Labels
are an ordered list in which a key may occur twice and the first one counts,
so they are an array of structs and not a map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))
ENTRIES = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("ts_ns", T.LongType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("message", T.StringType(), False),
        T.StructField("raw_line", T.StringType()),
        T.StructField("labels", LABELS, False),
    ]
)
NO_LABELS = "array<struct<key:string,value:string>>"


def label(key: str | Column, value: Column | str) -> Column:
    k, v = (x if isinstance(x, Column) else F.lit(x) for x in (key, value))
    return F.struct(k.alias("key"), v.alias("value"))


def no_labels() -> Column:
    return F.array().cast(NO_LABELS)


def with_time(df: DataFrame) -> DataFrame:
    """Adds the coarse copies of ts_ns."""
    ts = F.timestamp_micros(F.expr("ts_ns div 1000"))
    return df.withColumn("ts", ts).withColumn("day", F.to_date("ts"))


def first_label(name: str) -> Column:
    """The value of the first label of that key, else null."""
    return F.get(F.filter("labels", lambda x: x["key"] == name), 0)["value"]


def stored_size() -> Column:
    """Bytes of an entry in the chunk format: fixed fields, source, encoded labels, message."""
    joined = F.array_join(F.transform("labels", lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return F.octet_length("source") + F.octet_length(joined) + F.octet_length("message") + 16


def arrival(df: DataFrame) -> list[str]:
    """Columns that tell in which order entries arrived: the stored table's batches first."""
    return ["batch", "seq"] if "batch" in df.columns else ["seq"]
