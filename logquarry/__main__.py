"""Command line: python -m logquarry query|logql|ingest|tail|labels|version ..."""

from __future__ import annotations

import argparse
import time

from logquarry.config import load_config

VERSION = "0.1.0"


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="logquarry")
    top.add_argument("--config", help="settings file")
    top.add_argument("--data", help="folder of the table, else data_dir of the settings")
    commands = top.add_subparsers(dest="command", required=True)
    q = commands.add_parser("query", help="entries that hold a keyword")
    q.add_argument("keyword")
    q.add_argument("--from", dest="start")
    q.add_argument("--to", dest="end")
    q.add_argument("--limit", type=int)
    q = commands.add_parser("logql", help="a query of the query language, answered as JSON")
    q.add_argument("text")
    for name in ("start", "end", "step", "tenant"):
        q.add_argument(f"--{name}")
    q = commands.add_parser("ingest", help="follow files into the table; without files those of the settings")
    q.add_argument("files", nargs="*")
    q.add_argument("--checkpoint", required=True)
    q.add_argument("--earliest", action="store_true", help="from the start of the files, not from their present end")
    commands.add_parser("tail", help="print entries as they arrive")
    commands.add_parser("labels", help="names of all labels")
    commands.add_parser("metrics", help="totals of the table")
    commands.add_parser("index", help="bring the keyword index up to date")
    commands.add_parser("version")
    return top.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    if a.command == "version":
        print(f"logquarry {VERSION}")
        return 0
    from pyspark.sql import SparkSession

    from logquarry import render
    from logquarry.engine import LogEngine

    settings = load_config(a.config)
    spark = SparkSession.builder.appName("logquarry").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    e = LogEngine(spark, a.data or settings.data_dir, jobs=settings.jobs(), positions=settings.positions_path)
    if a.command == "query":
        rows = render.text_lines(e.query(a.keyword, a.start, a.end, settings.default_query_limit if a.limit is None else a.limit)).collect()
        print(*(r.text for r in rows), f"found {len(rows)} results", sep="\n")
    elif a.command == "logql":
        print(e.logql_json(a.text, **{k: v for k in ("start", "end", "step", "tenant") if (v := getattr(a, k)) is not None}))
    elif a.command == "labels":
        print(render.list_json(r.name for r in e.labels().collect()))
    elif a.command == "metrics":
        print(e.metrics_text(), end="")
    elif a.command == "index":
        print(f"{e.index_terms()} files added")
    elif a.command == "ingest":
        files = a.files or [p for j in settings.jobs() for p in j["paths"]]
        stream = e.follow(files, a.checkpoint, a.earliest, every=f"{settings.flush_interval_ms} milliseconds")
        while stream.isActive:
            time.sleep(1)
            p = stream.lastProgress
            print(f"{p['numInputRows'] if p else 0} lines in the last batch")
    else:
        e.tail(lambda batch, _: print(*(r.text for r in render.text_lines(batch).orderBy("ts_ns", "seq").toLocalIterator()), sep="\n")).awaitTermination()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
