"""Predicates as Catalyst expressions, in the order time, labels, line."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions.text import contains_folded
from logquarry.model import arrival, first_label
from logquarry.plans.language import LineFilter, Matcher, Query

#: The tenant of entries without a tenant label.
DEFAULT_TENANT = "default"


def within(df: DataFrame, from_ns: int | None, to_ns: int | None) -> DataFrame:
    """Both bounds are inclusive; on a stored table the coarse columns carry them to the scan too."""
    coarse = {"ts", "day"} <= set(df.columns)
    micros = lambda ns: F.timestamp_micros(F.lit(ns))
    if from_ns is not None:
        if coarse:
            df = df.where((F.col("day") >= F.to_date(micros(from_ns // 1000))) & (F.col("ts") >= micros(from_ns // 1000)))
        df = df.where(F.col("ts_ns") >= F.lit(from_ns))
    if to_ns is not None:
        if coarse:
            df = df.where((F.col("day") <= F.to_date(micros(to_ns // 1000))) & (F.col("ts") <= micros(to_ns // 1000)))
        df = df.where(F.col("ts_ns") <= F.lit(to_ns))
    return df


def label_value(name: str, promoted: frozenset[str] = frozenset()) -> Column:
    """What a matcher sees: source and filename are the entry's source, an untagged entry has the default tenant.

    ``promoted`` names labels that the table also stores as columns; where a
    column is null, as in files of a writer that did not promote it, the label
    itself is looked up.
    """
    if name in ("source", "filename"):
        return F.col("source")
    value = F.coalesce(F.col(name), first_label(name)) if name in promoted else first_label(name)
    return F.coalesce(value, F.lit(DEFAULT_TENANT)) if name == "tenant" else value


def matches(m: Matcher, regex: bool = False, promoted: frozenset[str] = frozenset()) -> Column:
    """A missing label matches no positive matcher and every negative one. =~ is a substring in either case unless ``regex``."""
    value = label_value(m.name, promoted)
    if m.op in ("=", "!="):
        hit = value == F.lit(m.value)
    elif regex:
        hit = F.rlike(value, F.lit(f"^(?:{m.value})$"))
    else:
        hit = contains_folded(value, m.value)
    if m.op == "=" and m.name in promoted and m.name not in ("source", "filename"):
        # this half reaches the scan, where statistics skip row groups
        hit = ((F.col(m.name) == F.lit(m.value)) | F.col(m.name).isNull()) & hit
    # a null is no match to WHERE, and a bare comparison reaches the scan
    return hit if m.op[0] == "=" else F.coalesce(~hit, F.lit(True))


def passes(f: LineFilter, regex: bool = False) -> Column:
    """|~ is a substring in either case unless ``regex``."""
    if regex and f.op in ("|~", "!~"):
        hit = F.rlike(F.col("message"), F.lit(f.text))
    else:
        hit = contains_folded("message", f.text)
    return hit if f.op[0] == "|" else ~hit


def selected(df: DataFrame, query: Query, from_ns: int | None = None, to_ns: int | None = None, regex: bool = False, promoted: frozenset[str] = frozenset()) -> DataFrame:
    """Rows in the time range that fit all matchers and line filters."""
    df = within(df, from_ns, to_ns)
    tests = [matches(m, regex, promoted) for m in query.matchers] + [passes(f, regex) for f in query.filters]
    return df.where(reduce(and_, tests)) if tests else df


def ordered(df: DataFrame, limit: int = 0, direction: str = "forward") -> DataFrame:
    """The first ``limit`` rows by time and arrival (0: all), or the last ones first."""
    by = [F.col(c).desc() if direction == "backward" else F.col(c) for c in ("ts_ns", *arrival(df))]
    df = df.orderBy(*by)
    return df.limit(limit) if limit else df
