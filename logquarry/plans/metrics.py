"""Step metrics: counts per bucket aligned to the start of the range."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions.times import MAX_NS, SECOND
from logquarry.model import first_label
from logquarry.plans.language import Query
from logquarry.plans.predicates import selected

DEFAULT_STEP_S = 60


def group_label(name: str) -> Column:
    """What grouping sees: an absent label is empty, the tenant's too."""
    return F.col("source") if name in ("source", "filename") else F.coalesce(first_label(name), F.lit(""))


def metric(df: DataFrame, query: Query, from_ns: int | None = None, to_ns: int | None = None, step_s: int = DEFAULT_STEP_S, sliding: bool = False, regex: bool = False, promoted: frozenset[str] = frozenset()) -> DataFrame:
    """One row per group and bucket that has entries: the group's labels, ts_ns (the bucket's start), value.

    The range in brackets divides a rate and doesn't slide, unless ``sliding``:
    then a bucket counts the entries of that many seconds up to its end. Row
    limits do not apply. Only keys and buckets are shuffled, after a partial
    count in every task.
    """
    m = query.metric
    start, end = from_ns or 0, MAX_NS if to_ns is None else to_ns
    step = (step_s or DEFAULT_STEP_S) * SECOND
    names = list(dict.fromkeys(m.by))
    rows = selected(df, query, start, end, regex, promoted) if end > start else df.where(F.lit(False))
    total = max(1, -((start - end) // step))
    slides = sliding and m.range_s
    # windows begin and end on multiples of the grain, so they are sums of counts by grain
    grain = math.gcd(step, m.range_s * SECOND) if slides else step
    bucket = F.expr(f"(ts_ns - {start}L) div {grain}L")
    counted = rows.select(*(group_label(n).alias(n) for n in names), bucket.alias("bucket")).groupBy(*names, "bucket").agg(F.count("*").alias("n"))
    if slides:
        first = F.expr(f"bucket * {grain}L div {step}L")
        last = F.expr(f"(bucket * {grain}L + {m.range_s * SECOND}L) div {step}L - 1")
        last = F.least(last, F.lit(total - 1))
        counted = counted.withColumn("bucket", F.explode(F.when(last >= first, F.sequence(first, last)))).groupBy(*names, "bucket").agg(F.sum("n").alias("n"))
    counted = counted.where(F.col("bucket") < F.lit(total))
    value = F.col("n").cast("double")
    if m.op == "rate":
        value = value / F.lit(float(m.range_s)) if m.range_s else F.lit(float("inf"))
    return counted.select(*names, (F.lit(start) + F.col("bucket") * F.lit(step)).alias("ts_ns"), value.alias("value"))
