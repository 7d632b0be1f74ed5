"""The Python API: ingest, search, query, catalogue, tail."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logquarry import render
from logquarry.functions.text import contains_folded
from logquarry.functions.times import parse_datetime, parse_step, parse_timestamp
from logquarry.operators import ingest
from logquarry.plans import catalog
from logquarry.plans.language import Query, parse
from logquarry.plans.metrics import metric
from logquarry.plans.predicates import ordered, selected, within
from logquarry.sources import table
from logquarry.streaming import tail

DEFAULT_LIMIT = 1000
#: Bytes of a followed file that one batch reads.
MOST_BYTES = 1 << 30
Time = int | str | None


def _bound(value: Time, read: Callable[[str], int | None]) -> int | None:
    return read(value) if isinstance(value, str) else value


class LogEngine:
    """Queries over a table of log entries, at a path that is also written, or given as a DataFrame.

    Every read returns a DataFrame that hasn't run yet. ``promoted`` names
    labels that are stored as columns; writers and readers of one table may
    promote different ones. ``positions`` is a JSON file of read offsets that
    followed files start from, and ``strict`` fails on broken stored files
    instead of passing over them.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, entries: DataFrame | None = None, promoted: Sequence[str] = (), jobs: Sequence[Mapping] = (), positions: str = "", strict: bool = False):
        self.spark, self.path, self._entries = spark, path, entries
        self.promoted, self.jobs, self.positions, self.strict = frozenset(promoted), list(jobs), positions, strict
        self.started = time.time()

    @property
    def entries(self) -> DataFrame:
        return self._entries if self._entries is not None else table.open_table(self.spark, self.path, sorted(self.promoted), self.strict)

    @property
    def label_sets(self) -> DataFrame:
        """Entries, or of a stored table the kept catalogue, where label sets are concerned."""
        if self._entries is not None:
            return self._entries
        try:
            return table.open_series(self.spark, self.path)
        except AnalysisException:  # written without a catalogue
            return self.entries

    # Reading

    def query(self, keyword: str | None = None, start: Time = None, end: Time = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
        """Entries whose message holds the keyword in either case; times are dates or nanoseconds, both inclusive (a date is its midnight)."""
        rows = self.entries if keyword is None or self._entries is not None else table.open_for_keyword(self.spark, self.path, f"{self.path}/_terms", keyword, sorted(self.promoted))
        rows = within(rows, _bound(start, parse_datetime), _bound(end, parse_datetime))
        if keyword is not None:
            rows = rows.where(contains_folded("message", keyword))
        return ordered(rows, limit)

    def token_search(self, token: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
        return ordered(catalog.token_search(self.entries, token), limit)

    def logql(self, text: str, start: Time = None, end: Time = None, limit: int = DEFAULT_LIMIT, step: int | str = 60, tenant: str | None = ingest.DEFAULT_TENANT, direction: str = "forward", regex: bool = False, sliding: bool = False, strict: bool = False) -> DataFrame:
        """A range query of one tenant (None: of all): entries, or for a metric its samples.

        direction, regex, sliding and strict go beyond the plain semantics and
        are off unless asked for.
        """
        q = parse(text, strict)
        q = q if tenant is None else q.scoped(ingest.tenant_id(tenant))
        since, until = _bound(start, parse_timestamp), _bound(end, parse_timestamp)
        if q.metric:
            return metric(self.entries, q, since, until, parse_step(step) if isinstance(step, str) else step, sliding, regex, self.promoted)
        return ordered(selected(self.entries, q, since, until, regex, self.promoted), q.row_limit(limit), direction)

    #: An instant query is a range query without a window of its own.
    instant = logql

    def logql_json(self, text: str, **options) -> str:
        try:
            q: Query = parse(text, options.get("strict", False))
            found = self.logql(text, **options)
        except ValueError as e:
            return render.error_json(str(e))
        return render.matrix_json(found, dict.fromkeys(q.metric.by)) if q.metric else render.streams_json(found)

    def labels(self, tenant: str | None = None) -> DataFrame:
        return catalog.label_names(self._of(tenant)).orderBy("name")

    def label_values(self, name: str, tenant: str | None = None) -> DataFrame:
        return catalog.label_values(self._of(tenant), name).orderBy("value")

    def series(self, tenant: str | None = ingest.DEFAULT_TENANT) -> DataFrame:
        return catalog.series(self.label_sets, tenant).orderBy("stream_fp")

    def metrics(self) -> dict[str, int]:
        """Entries, bytes and files of the table, seconds since this engine began, streams that run."""
        t = catalog.totals(self.label_sets).first()
        files = len(self.entries.inputFiles()) if self._entries is None else 0
        return {"log_entries_total": t["entries"], "log_bytes_total": t["bytes"], "chunks_total": files, "uptime_seconds": int(time.time() - self.started), "active_connections": len(self.spark.streams.active)}

    def metrics_text(self) -> str:
        return render.exposition(self.metrics())

    def _of(self, tenant: str | None) -> DataFrame:
        return self.label_sets if tenant is None else selected(self.label_sets, Query().scoped(tenant))

    def compact(self, day: str, files: int = 1) -> None:
        """Merges the batches of a day into one of ``files`` files. Nothing may write to or read that day meanwhile."""
        table.compact(self.spark, self.path, day, sorted(self.promoted), files)

    def index_terms(self) -> int:
        """Brings the keyword index up to date; later queries skip files by it. Says how many files were new."""
        return table.build_terms(self.spark, self.path, f"{self.path}/_terms")

    # Writing

    def ingest_lines(self, text: DataFrame | str, column: str = "text", source: str = ingest.HTTP_SOURCE) -> DataFrame:
        """Appends the lines of a text, or of a column of texts, and returns them as read."""
        df = self.spark.createDataFrame([(text,)], f"{column} string") if isinstance(text, str) else text
        lines = ingest.split_lines(df, column, source)
        return self._append(ingest.enriched(ingest.parsed(lines), self._labels()))

    def push(self, body: DataFrame | str, column: str = "body", tenant: str | None = None) -> DataFrame:
        """Appends the lines of push bodies. As documented they get the time of arrival and, of labels, only the tenant's besides the source's own."""
        if isinstance(body, str):
            if not body:
                raise ValueError("empty request body")
            body = self.spark.createDataFrame([(body,)], f"{column} string")
        lines = ingest.parsed(ingest.pushed(body, column))
        return self._append(ingest.enriched(lines, self._labels(), ingest.tenant_id(tenant)))

    def _labels(self) -> DataFrame | None:
        return ingest.label_table(self.spark, self.jobs) if self.jobs else None

    def _append(self, rows: DataFrame) -> DataFrame:
        rows = ingest.entries(rows, F.monotonically_increasing_id())
        if self.path:
            table.append(rows, self.path, sorted(self.promoted))
        return rows

    # Streams

    def follow(self, paths: Sequence[str], checkpoint: str, earliest: bool = False, most_bytes: int = MOST_BYTES, **options) -> StreamingQuery:
        """Tails files into the table, which other writers may add to meanwhile.

        A backlog comes in batches of ``most_bytes`` of each file, but with
        ``available_now``, which asks for all that is there, in one.
        """
        stream = tail.tailed(self.spark, paths, self.jobs, earliest, self.positions, 0 if options.get("available_now") else most_bytes)
        return tail.ingest(stream, self.path, checkpoint, promote=sorted(self.promoted), **options)

    def tail(self, notify: Callable[[DataFrame, int], None], query: str | None = None, history: bool = False) -> StreamingQuery:
        """Calls ``notify`` with each batch of entries added to the table from now on, with ``history`` also those already there."""
        stream = self.spark.readStream.schema(self.entries.schema).parquet(self.path)
        if not history:
            now = datetime.now(timezone.utc)
            stream = stream.where(F.col("_metadata.file_modification_time") >= F.lit(now))
        return tail.subscribe(stream, notify, parse(query) if query else None)
