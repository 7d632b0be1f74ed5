import json
import time

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from logquarry.engine import LogEngine
from logquarry.model import ENTRIES, with_time
from logquarry.plans.language import parse
from logquarry.plans.metrics import metric
from logquarry.sources import table
from logquarry.streaming import tail


def until(q, done, seconds=60):
    end = time.time() + seconds
    while not done() and time.time() < end:
        if q.exception():
            raise q.exception()
        time.sleep(0.3)
    assert done()


def test_follow_appends_once_across_restarts(spark, tmp_path):
    log, store, state = tmp_path / "a.log", str(tmp_path / "t"), str(tmp_path / "state")
    log.write_text('one\n{"message":"two"}\nhal')
    e = LogEngine(spark, store, jobs=[{"job": "j", "paths": [str(log)]}])

    def count():
        try:
            return table.open_table(spark, store).count()
        except AnalysisException:  # nothing is committed yet
            return 0

    q = e.follow([str(log)], state, earliest=True)
    until(q, lambda: count() == 2)
    q.stop()
    with log.open("a") as f:
        f.write("f\nthree\n")
    q = e.follow([str(log)], state, earliest=True)
    until(q, lambda: count() == 4)
    q.stop()
    rows = e.query().collect()
    assert sorted(r.message for r in rows) == ["half", "one", "three", "two"]
    assert {tuple((x.key, x.value) for x in r.labels) for r in rows} == {(("job", "j"), ("filename", str(log)))}


def entries(spark, n=50):
    rows = [(i, i * 10**9, "s", f"line {i % 7} é", None, [{"key": "job", "value": "ab"[i % 2]}]) for i in range(n)]
    return with_time(spark.createDataFrame(rows, ENTRIES))


def test_subscribers_get_matching_batches_and_projections(spark, tmp_path):
    path = str(tmp_path / "in")
    entries(spark).write.parquet(path)
    stream = spark.readStream.schema(entries(spark).schema).parquet(path)
    got, frames = [], []

    def notify(df, _):
        got.extend(r.event for r in tail.event_json(df).collect())
        frames.extend(r.frame for r in tail.frame_json(df).collect())

    q = tail.subscribe(stream, notify, parse('{job="a"} |= "LINE 3"'))
    q.processAllAvailable()
    q.stop()
    want = [i for i in range(50) if i % 2 == 0 and i % 7 == 3]
    assert sorted(json.loads(x.removeprefix("data: "))["ts"] for x in got) == [i * 10**9 for i in want] and all(x.endswith("\n\n") for x in got)
    assert json.loads(frames[0])["streams"][0]["stream"] == {"source": "s"} and len(frames) == len(want)


def test_oversized_events_are_left_out(spark):
    df = with_time(spark.createDataFrame([(0, 1, "s", "x" * 9000, None, []), (1, 2, "s", "y", None, [])], ENTRIES))
    assert tail.event_json(df).count() == 1 and tail.frame_json(df).count() == 2


def test_running_metric_equals_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    entries(spark, 200).write.parquet(path)
    stream = spark.readStream.schema(entries(spark).schema).parquet(path)
    query = parse("sum by (job) (count_over_time({}[1m]))")
    q = tail.running_metric(stream, query).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.job, r.ts_ns, r.value) for r in spark.table("running").collect()}
    assert got == {(r.job, r.ts_ns, r.value) for r in metric(entries(spark, 200), query).collect()}


def test_a_tail_has_no_history_unless_asked(spark, tmp_path):
    e = LogEngine(spark, str(tmp_path / "t"))
    e.ingest_lines("old error\nold")
    time.sleep(1.1)
    new, every = [], []
    note = lambda to: lambda df, _: to.extend(r.message for r in df.collect())
    tails = [e.tail(note(new), '{} |= "ERROR"'), e.tail(note(every), history=True)]
    for q in tails:
        q.processAllAvailable()
    e.ingest_lines("new error\nnew")
    for q in tails:
        q.processAllAvailable()
        q.stop()
    assert new == ["new error"] and sorted(every) == ["new", "new error", "old", "old error"]


def test_batch_and_stream_share_a_table(spark, tmp_path):
    log, store = tmp_path / "a.log", str(tmp_path / "t")
    log.write_text("f1\nf2\nf3\n")
    e = LogEngine(spark, store, promoted=["job", "tenant"], jobs=[{"job": "web", "paths": [str(log)], "labels": {"tenant": "team-a"}}])
    e.ingest_lines("x\ny")
    e.follow([str(log)], str(tmp_path / "state"), earliest=True, available_now=True).awaitTermination()
    e.ingest_lines("z")
    e.push('{"streams":[{"stream":{"job":"p"},"values":[["1","hello"]]}]}', tenant="team-b")
    rows = e.query().collect()
    assert [r.message for r in rows] == ["x", "y", "f1", "f2", "f3", "z", "hello"]
    assert len({(r.batch, r.seq) for r in rows}) == 7
    for engine in (e, LogEngine(spark, store), LogEngine(spark, store, promoted=["job", "level"])):
        assert {r.message for r in engine.logql("{}", tenant="team-a").collect()} == {"f1", "f2", "f3"}
        assert {r.message for r in engine.logql("{}").collect()} == {"x", "y", "z"}
        assert engine.logql('{job="web"}', tenant=None).count() == 3 and engine.logql('{job!="web"}', tenant=None).count() == 4
        assert {r.tenant: r.value for r in engine.logql("sum by (tenant) (count_over_time({}[1d]))", tenant=None, step="1d", end=2**62).collect()} == {"": 3.0, "team-a": 3.0, "team-b": 1.0}
    assert e.metrics()["log_entries_total"] == 7 and e.metrics()["log_bytes_total"] == LogEngine(spark, entries=e.entries).metrics()["log_bytes_total"]
    for what in (lambda x: x.labels(), lambda x: x.label_values("job"), lambda x: x.series(None), lambda x: x.label_values("tenant", "team-a")):
        assert what(e).collect() == what(LogEngine(spark, entries=e.entries)).collect()
    assert [r.name for r in e.labels().collect()] == ["filename", "job", "source", "tenant"]


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    table.append(entries(spark, 3), path)
    for n in (5, 7):
        table.append(entries(spark, n), path, ["job"], batch=table.batch_name(17, "w-0"))
    assert table.open_table(spark, path).count() == 10
    assert table.open_series(spark, path).groupBy().sum("entries").first()[0] == 10


def test_a_range_of_zero_gives_an_infinite_rate(spark, tmp_path):
    entries(spark, 20).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(entries(spark).schema).parquet(str(tmp_path / "in"))
    q = tail.running_metric(stream, parse("rate({}[0])")).writeStream.outputMode("complete").format("memory").queryName("zero").start()
    q.processAllAvailable()
    q.stop()
    assert {r.value for r in spark.table("zero").collect()} == {float("inf")}


def test_positions_reach_followed_files(spark, tmp_path):
    log, positions = tmp_path / "a.log", tmp_path / "p.json"
    log.write_text("old\nnew\n")
    positions.write_text(json.dumps({str(log): 4}))
    e = LogEngine(spark, str(tmp_path / "t"), positions=str(positions))
    e.follow([str(log)], str(tmp_path / "state"), available_now=True).awaitTermination()
    assert [r.message for r in e.query().collect()] == ["new"]


def test_a_day_is_compacted_in_order_of_arrival(spark, tmp_path):
    e = LogEngine(spark, str(tmp_path / "t"), promoted=["job"])
    for i in range(4):
        table.append(entries(spark, 5).withColumn("seq", F.col("seq") + (9 - i)), e.path, ["job"])
    table.append(entries(spark, 1).withColumn("day", F.lit("1999-01-01").cast("date")), e.path)
    before = [(r.ts_ns, r.message, r.job) for r in e.query(limit=0).collect()]
    totals = e.metrics()
    e.compact("1970-01-01", files=2)
    assert [(r.ts_ns, r.message, r.job) for r in e.query(limit=0).collect()] == before
    assert len(e.entries.inputFiles()) == 3 < totals["chunks_total"]
    assert {k: v for k, v in e.metrics().items() if "log" in k} == {k: v for k, v in totals.items() if "log" in k}
    e.compact("1970-01-01")
    assert e.entries.where("day = '1970-01-01'").select("batch").distinct().count() == 1
