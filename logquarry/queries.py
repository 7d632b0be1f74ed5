"""Queries over the driver's tables with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry import render
from logquarry.config import parse_config
from logquarry.engine import LogEngine
from logquarry.functions.text import contains_folded, tokens
from logquarry.functions.times import SECOND, parse_relative, parse_timestamp
from logquarry.model import first_label, label, no_labels
from logquarry.operators import ingest
from logquarry.plans import catalog
from logquarry.plans.language import parse
from logquarry.plans.predicates import selected
from logquarry.sources import chunkfile, table
from logquarry.sources.bytetail import ByteTail
from logquarry.sources.mapping import EVENTS_SQL, event_entries
from logquarry.streaming import tail
from logquarry.workfolder import work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_MESSAGE = _FOLD.format("message")
#: 2024-01-10 and 2024-01-12, midnight.
FROM, TO = 1_704_844_800 * SECOND, 1_705_017_600 * SECOND
ROW = ["seq", "ts_ns", "source", "message"]
_ROW = ", ".join(ROW)
_FP = """concat_ws(chr(31), 'job=' || job, 'level=' || level, 'source=' || source, 'tenant=' || tenant)"""


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = run
    SQL[name] = f"WITH {EVENTS_SQL}{sql if sql.startswith(',') else ' ' + sql}" if " e" in sql else sql


def _engine(spark: SparkSession, d: str) -> LogEngine:
    return LogEngine(spark, entries=event_entries(spark, d))


def _logql(name: str, text: str, where: str, **options) -> None:
    """A selection of entries, all of them unless a limit is the matter."""
    options = {"limit": 0, "tenant": None} | options
    limit = f" ORDER BY ts_ns, seq LIMIT {options.pop('sql_limit')}" if "sql_limit" in options else ""
    _add(name, lambda s, d: _engine(s, d).logql(text, **options).select(*ROW), f"SELECT {_ROW} FROM e WHERE {where}{limit}")


def _metric(name: str, text: str, sql: str, **options) -> None:
    options = {"tenant": None, "start": FROM, "end": TO} | options
    _add(name, lambda s, d: _engine(s, d).logql(text, **options), sql)


# Time and keywords
_add("time_range_inclusive", lambda s, d: _engine(s, d).query(None, FROM, TO, 0).select(*ROW), f"SELECT {_ROW} FROM e WHERE ts_ns BETWEEN {FROM} AND {TO}")
_add("time_range_dates", lambda s, d: _engine(s, d).query("ERROR", "2024-01-10", "2024-01-12T00:00:00", 0).select(*ROW), f"SELECT {_ROW} FROM e WHERE ts_ns BETWEEN {FROM} AND {TO} AND contains({_MESSAGE}, 'error')")
_add("keyword_ci", lambda s, d: _engine(s, d).query("USER=8", limit=0).select(*ROW), f"SELECT {_ROW} FROM e WHERE contains({_MESSAGE}, 'user=8')")
_add("keyword_empty", lambda s, d: _engine(s, d).query("", limit=0).select(*ROW), f"SELECT {_ROW} FROM e")
_add("keyword_wildcard_literal", lambda s, d: s.read.parquet(f"{d}/documents.parquet").where(contains_folded("text", "%")).select("doc_id"), "SELECT doc_id FROM documents WHERE contains(text, '%')")
_add("keyword_docs_ascii_fold", lambda s, d: s.read.parquet(f"{d}/documents.parquet").where(contains_folded("text", "É")).select("doc_id"), f"SELECT doc_id FROM documents WHERE contains({_FOLD.format('text')}, 'É')")
_add("keyword_limit", lambda s, d: _engine(s, d).query("error", limit=100).select(*ROW), f"SELECT {_ROW} FROM e WHERE contains({_MESSAGE}, 'error') ORDER BY ts_ns, seq LIMIT 100")

# Label matchers
_logql("match_eq", '{job="error"}', "job = 'error'")
_logql("match_neq_missing", '{tenant_x!="a", tenant!="team-a"}', "coalesce(tenant, 'default') <> 'team-a'")
_logql("match_eq_missing", '{nope=""}', "false")
_logql("match_sub", '{level=~"RR"}', "contains(level, 'rr')")
_logql("match_nsub_missing", '{nope!~"x", level!~"NF"}', "NOT contains(level, 'nf')")
_logql("match_source", '{source="svc-3"}', "source = 'svc-3'")
_logql("match_filename", '{filename=~"SVC-4"}', "source = 'svc-4'")
_logql("match_all", "{}", "true")
_logql("match_conjunction", '{job="error", source!="svc-1", level=~"e"}', "job = 'error' AND source <> 'svc-1'")
_logql("tenant_default", "{}", "tenant IS NULL", tenant="default")
_logql("tenant_team_a", '{level="info"}', "tenant = 'team-a' AND level = 'info'", tenant="team-a")
_logql("match_regex_optin", '{job=~"err.*|view"}', "job IN ('error', 'view')", regex=True)

# Line filters and limits
_logql("line_contains", '{} |= "USER=14"', f"contains({_MESSAGE}, 'user=14')")
_logql("line_not_contains", '{job="view"} != "user=1"', f"job = 'view' AND NOT contains({_MESSAGE}, 'user=1')")
_logql("line_not_contains_empty", '{} != ""', "false")
_logql("line_regex_as_substring", '{} |~ "user=.*"', "contains(message, 'user=.*')")
_logql("line_regex_optin", '{} |~ "user=1[0-3] "', "regexp_matches(message, 'user=1[0-3] ')", regex=True)
_logql("line_chain", '{job="error"} |= "user=" != "user=1" !~ "user=2" |~ "K"', f"job = 'error' AND NOT contains({_MESSAGE}, 'user=1') AND NOT contains({_MESSAGE}, 'user=2') AND contains({_MESSAGE}, 'k')")
_logql("logql_limit", '{job="error"} |= "user=8" | limit 100', "job = 'error' AND contains(message, 'user=8') AND tenant IS NULL", limit=1000, sql_limit=100, tenant="default")
_logql("limit_min_merge", '{job="view"} | limit 50', "job = 'view'", limit=20, sql_limit=20)
_add("direction_backward", lambda s, d: _engine(s, d).logql('{job="view"}', limit=30, tenant=None, direction="backward").select(*ROW), f"SELECT {_ROW} FROM e WHERE job = 'view' ORDER BY ts_ns DESC, seq DESC LIMIT 30")

# Metrics
_BUCKET = f"{FROM} + ((ts_ns - {FROM}) // {{0}}) * {{0}} AS ts_ns"
_IN = f"ts_ns BETWEEN {FROM} AND {TO}"
_HOUR, _MINUTE = 3600 * SECOND, 60 * SECOND
_metric("count_over_time", 'count_over_time({job="error"}[5m])', f"SELECT {_BUCKET.format(_HOUR)}, count(*)::DOUBLE AS value FROM e WHERE {_IN} AND ts_ns < {TO} AND job = 'error' GROUP BY 1", step=3600)
_metric("rate_5m_step_60", 'rate({} |= "user=1" [5m])', f"SELECT {_BUCKET.format(_MINUTE)}, count(*) / 300.0::DOUBLE AS value FROM e WHERE {_IN} AND ts_ns < {TO} AND contains(message, 'user=1') GROUP BY 1")
_metric("sum_by_level", "sum by (level) (count_over_time({}[1m]))", f"SELECT level, {_BUCKET.format(_HOUR)}, count(*)::DOUBLE AS value FROM e WHERE {_IN} AND ts_ns < {TO} GROUP BY ALL", step=3600)
_metric("sum_by_tenant_missing", "sum by (tenant, filename) (rate({}[10m]))", f"SELECT coalesce(tenant, '') AS tenant, source AS filename, {_BUCKET.format(_HOUR)}, count(*) / 600.0::DOUBLE AS value FROM e WHERE {_IN} AND ts_ns < {TO} GROUP BY ALL", step="1h")
_metric("sum_no_grouping", 'sum(count_over_time({level="warn"}[1m]))', f"SELECT {_BUCKET.format(_HOUR)}, count(*)::DOUBLE AS value FROM e WHERE {_IN} AND ts_ns < {TO} AND level = 'warn' GROUP BY 1", step=3600)
#: The range is no multiple of the step: its end is in the last bucket.
_ODD = TO + 1800 * SECOND
_metric("metric_edge_to_multiple", "sum by (job) (count_over_time({}[1m]))", f"SELECT job, {_BUCKET.format(_HOUR)}, count(*)::DOUBLE AS value FROM e WHERE ts_ns BETWEEN {FROM} AND {_ODD} GROUP BY ALL", step=3600, end=_ODD)
_metric("metric_unbounded", "rate({}[1d])", f"SELECT (ts_ns // {24 * _HOUR}) * {24 * _HOUR} AS ts_ns, count(*) / 86400.0::DOUBLE AS value FROM e GROUP BY 1", start=None, end=None, step="1d")
_metric("metric_range_zero", "rate({}[0])", f"SELECT {_BUCKET.format(_HOUR)}, 'inf'::DOUBLE AS value FROM e WHERE {_IN} AND ts_ns < {TO} GROUP BY 1", step=3600)
_metric("metric_tenant", "sum by (job) (count_over_time({}[1m]))", f"SELECT job, {_BUCKET.format(_HOUR)}, count(*)::DOUBLE AS value FROM e WHERE {_IN} AND ts_ns < {TO} AND tenant = 'team-b' GROUP BY ALL", step=3600, tenant="team-b")
_metric(
    "metric_sliding_optin", 'count_over_time({job="error"}[2h])',
    f"SELECT {FROM} + b * {_HOUR} AS ts_ns, count(*)::DOUBLE AS value FROM e, range(0, 48) AS r(b) WHERE {_IN} AND job = 'error' AND ts_ns >= {FROM} + (b - 1) * {_HOUR} AND ts_ns < {FROM} + (b + 1) * {_HOUR} GROUP BY ALL",
    step=3600, sliding=True,
)

# Streams and catalogue
_add(
    "streams_grouped",
    lambda s, d: catalog.streams(_engine(s, d).logql('{job="error"} |= "user=1"', limit=0, tenant=None)).select("stream_fp", F.size("values").cast("long").alias("n"), F.array_join(F.transform("values", lambda v: v["message"]), "\n").alias("lines")),
    f"SELECT {_FP} AS stream_fp, count(*) AS n, string_agg(message, chr(10) ORDER BY ts_ns, seq) AS lines FROM e WHERE job = 'error' AND contains(message, 'user=1') GROUP BY 1",
)
_add("label_names", lambda s, d: _engine(s, d).labels(), "SELECT unnest(['job', 'level', 'source', 'tenant']) AS name")
_add("label_values", lambda s, d: _engine(s, d).label_values("job"), "SELECT DISTINCT job AS value FROM e")
_add("label_values_source", lambda s, d: _engine(s, d).label_values("source"), "SELECT DISTINCT source AS value FROM e")
_add("label_values_unknown", lambda s, d: _engine(s, d).label_values("nope"), "SELECT 'x' AS value WHERE false")
_add("series_all", lambda s, d: _engine(s, d).series(None).select("stream_fp"), f"SELECT DISTINCT {_FP} AS stream_fp FROM e")
_add("series_tenant", lambda s, d: _engine(s, d).series("team-b").select("stream_fp"), f"SELECT DISTINCT {_FP} AS stream_fp FROM e WHERE tenant = 'team-b'")
_add("series_default_tenant", lambda s, d: _engine(s, d).series("default").select("stream_fp"), "SELECT 'x' AS stream_fp WHERE false")
_SIZE = "16 + strlen(source) + strlen(message) + strlen(concat_ws(',', 'job=' || job, 'level=' || level, 'tenant=' || tenant))"
_add("ingest_totals", lambda s, d: catalog.totals(event_entries(s, d)), f"SELECT count(*) AS entries, sum({_SIZE})::BIGINT AS bytes FROM e")
_add("day_partition_counts", lambda s, d: catalog.days(event_entries(s, d)).withColumn("day", F.col("day").cast("string")), "SELECT day::VARCHAR AS day, min(ts_ns) AS min_ts, max(ts_ns) AS max_ts, count(*) AS entries FROM e GROUP BY 1")

# Tokens
_TOKENS = f"list_distinct(list_filter(regexp_split_to_array({_FOLD.format('{}')}, '[^0-9A-Za-z_\\-]+'), lambda x: strlen(x) BETWEEN 2 AND 128))"
_add("token_search", lambda s, d: catalog.token_search(event_entries(s, d), "ERROR").select(*ROW), f"SELECT {_ROW} FROM e WHERE list_contains({_TOKENS.format('message')}, 'error')")
_add("term_postings", lambda s, d: catalog.postings(event_entries(s, d), "day").groupBy("term").agg(F.count("*").alias("days")), f"SELECT term, count(*) AS days FROM (SELECT DISTINCT unnest({_TOKENS.format('message')}) AS term, day FROM e) GROUP BY 1")
_add("tokens_documents", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select(F.explode(tokens("text")).alias("term")).groupBy("term").agg(F.count("*").alias("documents")), f"SELECT term, count(*) AS documents FROM (SELECT unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY 1")

# Ingest
def _json_lines(s: SparkSession, d: str) -> DataFrame:
    """Events written as JSON lines of several shapes, and read back."""
    e = s.read.parquet(f"{d}/events.parquet")
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = (
        F.when(F.col("event_id") % 4 == 0, F.to_json(F.struct(F.col("event_type").alias("message"), time.alias("timestamp"))))
        .when(F.col("event_id") % 4 == 1, F.to_json(F.struct(F.col("event_type").alias("msg"), time.alias("ts"))))
        .when(F.col("event_id") % 4 == 2, F.to_json(F.struct(F.col("event_type").alias("other"), F.col("event_id").alias("ts"))))
        .otherwise(F.concat(F.lit(" plain "), "event_type"))
    )
    return ingest.parsed(e.select("event_id", line.alias("line")), F.lit(0).cast("long")).select("event_id", "message", "ts_ns")


_add(
    "json_line_lift", _json_lines,
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type WHEN 2 THEN '{"other":"' || event_type || '","ts":' || event_id || '}' ELSE ' plain ' || event_type END AS message,
    CASE WHEN event_id % 4 < 2 THEN epoch_ns(date_trunc('second', ts)) ELSE 0 END AS ts_ns FROM events""",
)

JOBS = [{"job": "api", "paths": ["svc-0", "svc-1"], "labels": {"env": "prod"}}, {"paths": ["svc-2"]}]


def _enriched(s: SparkSession, d: str) -> DataFrame:
    e = event_entries(s, d).drop("labels")
    return ingest.enriched(e, ingest.label_table(s, JOBS), "t1").select("seq", "source", catalog.fingerprint(F.col("labels")).alias("labels"))


_add(
    "enrich_left_join", _enriched,
    """SELECT seq, source, concat_ws(chr(31), CASE WHEN source IN ('svc-0', 'svc-1') THEN concat_ws(chr(31), 'job=api', 'filename=' || source, 'env=prod')
    WHEN source = 'svc-2' THEN concat_ws(chr(31), 'job=default', 'filename=' || source) END, 'tenant=t1') AS labels FROM e""",
)
_add(
    "ingest_lines_split", lambda s, d: ingest.split_lines(s.read.parquet(f"{d}/documents.parquet"), "text", keep=["doc_id"]).select("doc_id", F.col("at").cast("long").alias("place"), "source", "line"),
    "SELECT doc_id, place, 'http' AS source, line FROM (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS place, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> ''",
)


def _pushed(s: SparkSession, d: str) -> DataFrame:
    """Each conversation as a push body of one stream, and its lines."""
    c = s.read.parquet(f"{d}/conversations.parquet")
    values = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: F.array(x["turn"].cast("string"), x["text"]))
    stream = F.struct(F.lit("x").alias("a"), F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("job"))
    body = c.groupBy("conv_id").agg(values.alias("values")).select("conv_id", F.to_json(F.struct(F.array(F.struct(stream.alias("stream"), "values")).alias("streams"))).alias("body"))
    return ingest.pushed(body, "body", ["conv_id"]).select("conv_id", F.col("ts_text").cast("long").alias("turn"), "source", "line")


_add("push_explode", _pushed, "SELECT conv_id, turn, 'conv-' || conv_id AS source, text AS line FROM conversations WHERE text <> ''")
_add(
    "default_labels", lambda s, d: event_entries(s, d).select("seq", catalog.fingerprint(F.concat(no_labels(), F.array(label("a", F.col("source"))))).alias("labels")),
    "SELECT seq, 'a=' || source AS labels FROM e",
)
_add("shown_source", lambda s, d: event_entries(s, d).groupBy(catalog.shown_source().alias("shown")).agg(F.count("*").alias("n")), "SELECT source AS shown, count(*) AS n FROM e GROUP BY 1")


# Storage and streams
def _stored(s: SparkSession, d: str) -> str:
    path = work_folder(s)
    table.append(event_entries(s, d), path, ["job", "tenant"], files=8)
    return path


def _terms(s: SparkSession, d: str) -> DataFrame:
    e = LogEngine(s, _stored(s, d))
    e.index_terms()
    return e.query("error user=8 ", limit=0).select(*ROW)


def _streamed(s: SparkSession, d: str, run: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """The rows that a stream over the stored table gives once all of it is read."""
    path, out = _stored(s, d), work_folder(s)
    found = run(s.readStream.schema(table.schema()).parquet(path))
    # in complete mode each batch has the whole result, and the last one stands
    write = lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)
    found.writeStream.outputMode(mode).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(found.schema).parquet(out)


def _log_files(s: SparkSession, lines: DataFrame) -> list[str]:
    """Globs over text files of the lines in the shared folder, as a tail source opens them."""
    path = work_folder(s)
    lines.write.text(path)
    return [path.removeprefix("file://") + "/part-*"]


def _followed(s: SparkSession, d: str) -> DataFrame:
    """Events added to one table by batch, by a followed file and by a push: errors, views and the rest."""
    json = F.to_json(F.struct("message", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")))
    events = event_entries(s, d).select(first_label("job").alias("job"), "message", json.alias("line"))
    e = LogEngine(s, work_folder(s), promoted=["job", "tenant"])
    e.ingest_lines(events.where("job = 'error'"), "line")
    files = _log_files(s, events.where("job = 'view'").select("line"))
    e.follow(files, work_folder(s), earliest=True, available_now=True).awaitTermination()
    value = F.array(F.struct(F.struct(F.col("job").alias("job")).alias("stream"), F.array(F.array(F.lit("1"), "line")).alias("values")))
    e.push(events.where("job not in ('error', 'view')").select(F.to_json(F.struct(value.alias("streams"))).alias("body")), tenant="team-a")
    return e.query(limit=0).select("message", "ts_ns", F.coalesce(first_label("tenant"), F.lit("")).alias("tenant"))


def _tailed(s: SparkSession, d: str) -> DataFrame:
    """All lines of followed files, read in ranges of 100,000 bytes."""
    s.dataSource.register(ByteTail)
    files, out = _log_files(s, event_entries(s, d).select("message")), work_folder(s)
    lines = s.readStream.format("bytetail").options(paths=files[0], startingOffset="earliest", rangeBytes="100000").load()
    lines.writeStream.foreachBatch(lambda batch, _: batch.write.mode("append").parquet(out)).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(lines.schema).parquet(out).select("line")


def _subscribed(s: SparkSession, d: str) -> DataFrame:
    """What a subscriber with a query of its own is told of."""
    path, out = _stored(s, d), work_folder(s)
    stream = s.readStream.schema(table.schema()).parquet(path)
    q = tail.subscribe(stream, lambda batch, _: batch.select(*ROW).write.mode("append").parquet(out), parse('{job="purchase", level="warn"} != "user=1"'))
    q.processAllAvailable()
    q.stop()
    return s.read.parquet(out)


def _journals(s: SparkSession, d: str) -> DataFrame:
    """Entries of journals, which are frames without a header, each with a frame at its end that was cut off."""
    files = chunkfile.encoded(event_entries(s, d), compressed=False)
    cut = files.select("path", F.expr("concat(substring(content, 33), X'0102030405')").alias("content"))
    return chunkfile.decoded(cut, journal=True).select("ts_ns", "source", "message")


def _text(s: SparkSession, text: str) -> DataFrame:
    return s.createDataFrame([(text,)], "text string")


_add("stored_range_and_label", lambda s, d: LogEngine(s, _stored(s, d), promoted=["job", "tenant"]).logql('{job="error"}', start=FROM, end=TO, limit=0, tenant="team-a").select(*ROW), f"SELECT {_ROW} FROM e WHERE {_IN} AND job = 'error' AND tenant = 'team-a'")
_add("stored_keyword_index", _terms, f"SELECT {_ROW} FROM e WHERE contains({_MESSAGE}, 'error user=8 ')")
_add("chunk_files", lambda s, d: chunkfile.decoded(chunkfile.encoded(event_entries(s, d))).select("ts_ns", "source", "message", catalog.fingerprint(F.col("labels")).alias("labels")), "SELECT ts_ns, source, message, concat_ws(chr(31), 'job=' || job, 'level=' || level, 'tenant=' || tenant) AS labels FROM e")
_FRAME = """SELECT '{"streams":[{"stream":{"source":"' || source || '"},"values":[["' || ts_ns || '","' || replace(message, '"', chr(92) || '"') || '"]]}]}' AS frame FROM e WHERE job = 'error' AND contains(message, 'user=8')"""
_add("stream_tail", lambda s, d: _streamed(s, d, lambda x: tail.frame_json(selected(x, parse('{job="error"} |= "user=8"'))), "append"), _FRAME)
_add("stream_metric", lambda s, d: _streamed(s, d, lambda x: tail.running_metric(x, parse("sum by (level) (count_over_time({}[1h]))"), "1 hour"), "complete"), f"SELECT level, (ts_ns // {_HOUR}) * {_HOUR} AS ts_ns, count(*)::DOUBLE AS value FROM e GROUP BY ALL")
_ESCAPED = """replace(message, '"', chr(92) || '"')"""
_add("stream_events", lambda s, d: _streamed(s, d, lambda x: tail.event_json(x), "append"), f"""SELECT 'data: {{"ts":' || ts_ns || ',"src":"' || source || '","msg":"' || {_ESCAPED} || '"}}' || chr(10) || chr(10) AS event FROM e""")
_add("stream_subscriber", _subscribed, f"SELECT {_ROW} FROM e WHERE job = 'purchase' AND NOT contains({_MESSAGE}, 'user=1')")
_add("stored_after_follow", _followed, "SELECT message, ts_ns // 1000000000 * 1000000000 AS ts_ns, CASE WHEN job IN ('error', 'view') THEN '' ELSE 'team-a' END AS tenant FROM e")
_add("tail_lines", _tailed, "SELECT message AS line FROM e")
_add("journal_files", _journals, "SELECT ts_ns, source, message FROM e")
_add("stored_series", lambda s, d: LogEngine(s, _stored(s, d)).series(None).select("stream_fp"), f"SELECT DISTINCT {_FP} AS stream_fp FROM e")
_add("stored_label_values", lambda s, d: LogEngine(s, _stored(s, d)).label_values("job", "team-b"), "SELECT DISTINCT job AS value FROM e WHERE tenant = 'team-b'")
_add("stored_label_names", lambda s, d: LogEngine(s, _stored(s, d)).labels("team-a"), "SELECT unnest(['job', 'level', 'source', 'tenant']) AS name")
_add("stored_totals", lambda s, d: catalog.totals(LogEngine(s, _stored(s, d)).label_sets), f"SELECT count(*) AS entries, sum({_SIZE})::BIGINT AS bytes FROM e")
_add("stored_tenant_metric", lambda s, d: LogEngine(s, _stored(s, d), promoted=["job", "tenant"]).logql('sum by (level) (rate({job="view"}[10m]))', start=FROM, end=TO, step="1h", tenant="team-b"), f"SELECT level, {_BUCKET.format(_HOUR)}, count(*) / 600.0::DOUBLE AS value FROM e WHERE {_IN} AND ts_ns < {TO} AND job = 'view' AND tenant = 'team-b' GROUP BY ALL")

# Response texts: of a limited selection, of a metric, of the catalogue
_add("text_lines", lambda s, d: render.text_lines(_engine(s, d).query(limit=0)).select("text"), "SELECT '[' || strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z] ' || source || ': ' || message AS text FROM e")
_FIRST = "x AS (SELECT * FROM e WHERE job = 'error' AND tenant = 'team-a' ORDER BY ts_ns, seq LIMIT 60)"
_LABELS = """'{"job":"' || job || '","level":"' || level || '","source":"' || source || '","tenant":"' || tenant || '"}'"""
_add(
    "response_streams", lambda s, d: _text(s, _engine(s, d).logql_json('{job="error"} | limit 60', tenant="team-a")),
    f""", {_FIRST}, g AS (SELECT {_FP} AS fp, any_value({_LABELS}) AS labels, string_agg('["' || ts_ns || '","' || {_ESCAPED} || '"]', ',' ORDER BY ts_ns, seq) AS v FROM x GROUP BY 1)
    SELECT '{{"status":"success","data":{{"resultType":"streams","result":[' || string_agg('{{"stream":' || labels || ',"values":[' || v || ']}}', ',' ORDER BY fp) || '],"stats":{{"summary":{{"bytesProcessed":0,"linesProcessed":0}}}}}}}}' AS text FROM g""",
)
_add(
    "response_matrix", lambda s, d: _text(s, _engine(s, d).logql_json("sum by (level) (count_over_time({}[1m]))", start=FROM, end=TO, step=3600, tenant=None)),
    f""", b AS (SELECT level, {_BUCKET.format(_HOUR)}, count(*) AS n FROM e WHERE {_IN} AND ts_ns < {TO} GROUP BY ALL),
    g AS (SELECT level, string_agg('[' || (ts_ns // 1000000000) || '.000,"' || n || '"]', ',' ORDER BY ts_ns) AS v FROM b GROUP BY 1)
    SELECT '{{"status":"success","data":{{"resultType":"matrix","result":[' || string_agg('{{"metric":{{"level":"' || level || '"}},"values":[' || v || ']}}', ',' ORDER BY level) || ']}}}}' AS text FROM g""",
)
_add("response_label_values", lambda s, d: _text(s, render.list_json(r.value for r in _engine(s, d).label_values("job").collect())), """SELECT '{"status":"success","data":[' || string_agg('"' || job || '"', ',' ORDER BY job) || ']}' AS text FROM (SELECT DISTINCT job FROM e)""")
_add("response_series", lambda s, d: _text(s, render.series_json(_engine(s, d).series("team-b"))), f"""SELECT '{{"status":"success","data":[' || string_agg(labels, ',' ORDER BY fp) || ']}}' AS text FROM (SELECT DISTINCT {_FP} AS fp, {_LABELS} AS labels FROM e WHERE tenant = 'team-b')""")
_add(
    "response_native", lambda s, d: _text(s, render.native_json(_engine(s, d).logql('{job="error"}', limit=60, tenant="team-a"))),
    f""", {_FIRST} SELECT '{{"count":' || count(*) || ',"results":[' || string_agg('{{"timestamp":' || ts_ns || ',"source":"' || source || '","message":"' || {_ESCAPED} || '","labels":{{"job":"' || job || '","level":"' || level || '","tenant":"' || tenant || '"}}}}', ',' ORDER BY ts_ns, seq) || ']}}' AS text FROM x""",
)
_add("response_error", lambda s, d: _text(s, _engine(s, d).logql_json("rate({})")), """SELECT '{"status":"error","errorType":"bad_request","error":"rate needs a range such as [5m]"}' AS text""")
_HEADS = ["# HELP logquarry_{0} {1}\n# TYPE logquarry_{0} {2}\nlogquarry_{0} ".format(k, *v) for k, v in render.EXPORTED.items()]
_add(
    "response_exposition", lambda s, d: _text(s, render.exposition({f"log_{k}_total": v for k, v in catalog.totals(event_entries(s, d)).first().asDict().items()})),
    f"SELECT '{_HEADS[0]}' || count(*) || '\n{_HEADS[1]}' || sum({_SIZE})::BIGINT || '\n{_HEADS[2]}0\n{_HEADS[3]}0\n{_HEADS[4]}0\n' AS text FROM e",
)

# Request parameters and settings, which the driver reads
_NOW = 1_705_276_800 * SECOND
_TIMES = ["1700000000", "999999999999", "1000000000000", "1700000000000000000", "+5", "-5", "1700000000.5", "1e3", "abc", ""]
_RELATIVE = ["now", "now-15m", "now-2h", "now-1d", "now-30s", "now-5x", "1705276800123456789", "2024-01-15T00:00:00", "2024-01-15T00:00:00.250", "soon"]
_HEADERS = ["team-a", " team_b.1\t", "", "   ", "a b", "é", "x/y", "Default", "-"]
_CONFIG = '{"http_port": 1, "scrape_configs": [{"job": "web", "paths": ["/a.log", "/b.log"], "labels": {"env": "prod"}}, {"paths": ["/c.log"]}], "watch_files": ["/a.log", "/d.log"]}'


def _values(texts: list[str]) -> str:
    return "(VALUES " + ", ".join(f"('{t}')" for t in texts) + ") AS v(text)"


_add(
    "request_times", lambda s, d: s.createDataFrame([(t, parse_timestamp(t)) for t in _TIMES], "text string, ns long").fillna(-1),
    f"""SELECT text, coalesce(CASE WHEN regexp_full_match(text, '[+-]?[0-9]+') THEN TRY_CAST(text::HUGEINT * CASE WHEN text::BIGINT < 1000000000000 THEN 1000000000 ELSE 1 END AS BIGINT)
    ELSE (TRY_CAST(text AS DOUBLE) * 1000000000)::BIGINT END, -1) AS ns FROM {_values(_TIMES)}""",
)
_add(
    "request_relative_times", lambda s, d: s.createDataFrame([(t, parse_relative(t, _NOW)) for t in _RELATIVE], "text string, ns long").fillna(-1),
    f"""SELECT text, coalesce(CASE WHEN text = 'now' THEN {_NOW} WHEN regexp_full_match(text, 'now-[0-9]+[smhd]')
      THEN {_NOW} - regexp_extract(text, '[0-9]+')::BIGINT * CASE right(text, 1) WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 ELSE 86400 END * 1000000000
    WHEN regexp_full_match(text, '[0-9]+') THEN text::BIGINT ELSE epoch_ns(TRY_CAST(text AS TIMESTAMP)) END, -1) AS ns FROM {_values(_RELATIVE)}""",
)
_add(
    "request_tenants", lambda s, d: s.createDataFrame([(t, ingest.tenant_id(t)) for t in _HEADERS], "header string, tenant string"),
    f"SELECT text AS header, CASE WHEN regexp_full_match(trim(text, ' ' || chr(9)), '[A-Za-z0-9_.-]+') THEN trim(text, ' ' || chr(9)) ELSE 'default' END AS tenant FROM {_values(_HEADERS)}",
)
_add(
    "configured_sources", lambda s, d: ingest.label_table(s, parse_config(_CONFIG).jobs()).select("source", catalog.fingerprint(F.col("source_labels")).alias("labels")),
    f"""SELECT p AS source, concat_ws(chr(31), 'job=' || coalesce(json_extract_string(c, '$.job'), 'default'), 'filename=' || p, 'env=' || json_extract_string(c, '$.labels.env')) AS labels
    FROM (SELECT c, unnest(json_extract_string(c, '$.paths[*]')) AS p FROM (SELECT unnest(json_extract('{_CONFIG}'::JSON, '$.scrape_configs[*]')) AS c))
    UNION ALL SELECT '/d.log', concat_ws(chr(31), 'job=default', 'filename=/d.log')""",
)
