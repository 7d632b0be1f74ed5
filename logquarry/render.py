"""Response texts from results of bounded size (a limit, a catalogue, a metric)."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.functions.times import iso_millis
from logquarry.plans.catalog import streams


def _json(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _pairs(labels) -> str:
    """An object in the given order; repeated keys stay."""
    return "{" + ",".join(f"{_json(x['key'])}:{_json(x['value'])}" for x in labels) + "}"


def number(value: float) -> str:
    """Plain decimal digits, no exponent, no trailing zeros."""
    if value in (float("inf"), float("-inf")) or value != value:
        return str(value)
    text = f"{Decimal(repr(float(value))):f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def streams_json(df: DataFrame) -> str:
    rows = streams(df).orderBy("stream_fp").collect()
    found = (f'{{"stream":{_pairs(r.stream)},"values":{_json([[str(v.ts_ns), v.message] for v in r["values"]])}}}' for r in rows)
    return '{"status":"success","data":{"resultType":"streams","result":[' + ",".join(found) + '],"stats":{"summary":{"bytesProcessed":0,"linesProcessed":0}}}}'


def matrix_json(df: DataFrame, by: Iterable[str]) -> str:
    names, series = list(by), {}
    for r in df.orderBy(*names, "ts_ns").collect():
        series.setdefault(tuple(r[n] for n in names), []).append(f'[{r["ts_ns"] / 1e9:.3f},"{number(r["value"])}"]')
    found = (f'{{"metric":{_json(dict(zip(names, key, strict=True)))},"values":[{",".join(v)}]}}' for key, v in series.items())
    return '{"status":"success","data":{"resultType":"matrix","result":[' + ",".join(found) + "]}}"


def list_json(values: Iterable) -> str:
    return _json({"status": "success", "data": list(values)})


def series_json(df: DataFrame) -> str:
    return '{"status":"success","data":[' + ",".join(_pairs(r.stream) for r in df.orderBy("stream_fp").collect()) + "]}"


def error_json(message: str, kind: str = "bad_request") -> str:
    return _json({"status": "error", "errorType": kind, "error": message})


def native_json(df: DataFrame) -> str:
    rows = df.select("ts_ns", "source", "message", "labels").collect()
    found = (f'{{"timestamp":{r.ts_ns},"source":{_json(r.source)},"message":{_json(r.message)},"labels":{_pairs(r.labels)}}}' for r in rows)
    return f'{{"count":{len(rows)},"results":[{",".join(found)}]}}'


def text_lines(df: DataFrame) -> DataFrame:
    """One text per entry, for a terminal."""
    return df.select("ts_ns", "seq", F.concat(F.lit("["), iso_millis(F.col("ts_ns")), F.lit("] "), F.col("source"), F.lit(": "), F.col("message")).alias("text"))


#: Name, help and type of each exported number.
EXPORTED = {
    "log_entries_total": ("Entries in the table.", "counter"),
    "log_bytes_total": ("Size of all entries in the chunk format, in bytes.", "counter"),
    "chunks_total": ("Parquet files of the table.", "counter"),
    "uptime_seconds": ("Seconds since this engine was made.", "gauge"),
    "active_connections": ("Streaming queries that run in the session.", "gauge"),
}


def exposition(values: Mapping[str, int], prefix: str = "logquarry_") -> str:
    """Prometheus text format."""
    out = []
    for name, (text, kind) in EXPORTED.items():
        full = prefix + name
        out += (f"# HELP {full} {text}", f"# TYPE {full} {kind}", f"{full} {values.get(name, 0)}")
    return "\n".join(out) + "\n"


def totals_json(values: Mapping[str, int]) -> str:
    keys = {"total_entries": "log_entries_total", "total_bytes": "log_bytes_total", "chunks": "chunks_total", "uptime_s": "uptime_seconds", "connections": "active_connections"}
    return _json({k: values.get(v, 0) for k, v in keys.items()})
