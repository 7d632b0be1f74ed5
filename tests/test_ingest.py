import json

import pytest
from pyspark.sql import functions as F

from logquarry.config import Config, Positions, load_config, parse_config
from logquarry.engine import LogEngine
from logquarry.operators import ingest

NOW = 42


def parsed(spark, lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "at long, line string")
    return [(r.message, r.ts_ns) for r in ingest.parsed(df, F.lit(NOW).cast("long")).orderBy("at").collect()]


def test_json_lift(spark):
    t = 1_705_314_645 * 10**9
    cases = {
        '{"message": "hello world", "level": "info"}': ("hello world", NOW),
        '{"msg":"b","ts":"2024-01-15T10:30:45Z"}': ("b", t),
        '{"message":"a","msg":"b","timestamp":"2024-01-15T10:30:45.9","ts":"1999-01-01"}': ("a", t),
        '{"ts":1705314645,"msg":5}': ('{"ts":1705314645,"msg":5}', NOW),
        '{"timestamp":"soon","message":"say \\"hi\\""}': ('say "hi"', NOW),
        ' {"message":"x"}': (' {"message":"x"}', NOW),
        "{broken": ("{broken", NOW),
        "plain": ("plain", NOW),
        '{"timestamp":"1970-01-01T00:00:00","message":"zero"}': ("zero", NOW),
    }
    assert parsed(spark, list(cases)) == list(cases.values())


def test_lines_keep_carriage_returns_and_drop_empty_ones(spark):
    df = spark.createDataFrame([("a\n\nb\r\n c \n",)], "text string")
    assert [(r["at"], r.line, r.source) for r in ingest.split_lines(df, "text").collect()] == [(0, "a", "http"), (2, "b\r", "http"), (3, " c ", "http")]


def test_push(spark):
    body = {"streams": [{"stream": {"a": "1", "filename": "f", "job": "j"}, "values": [["5", "one", {"x": "y"}], ["bad", "two"], ["6", ""], ["7"]]}, {"stream": {"z": "1"}, "values": [["8", 'q"3']]}, {"values": [["9", "four"]]}, {"stream": {"job": "only"}}]}
    df = spark.createDataFrame([(json.dumps(body),), ("{}",), ('{"streams":[]}',), ("no json",)], "body string")
    got = [(r.source, r.ts_text, r.line) for r in ingest.pushed(df, "body").collect()]
    assert got == [("f", "5", "one"), ("f", "bad", "two"), ("loki-push", "8", 'q"3'), ("loki-push", "9", "four")]
    times = ingest.pushed(df, "body").select(ingest.push_time(F.col("ts_text"), F.lit(NOW).cast("long"))).collect()
    assert [r[0] for r in times] == [5, NOW, 8, 9]


def test_labels_of_sources_replace_and_tenants_come_last(spark):
    jobs = [{"job": "varlogs", "paths": ["/a", "/b"], "labels": {"env": "prod", "job": "x"}}, {"paths": ["/c"]}]
    df = spark.createDataFrame([("/a",), ("/c",), ("/d",)], "source string")
    got = {r.source: [(x.key, x.value) for x in r.labels] for r in ingest.enriched(df, ingest.label_table(spark, jobs), "t").collect()}
    assert got == {"/a": [("job", "varlogs"), ("filename", "/a"), ("env", "prod"), ("job", "x"), ("tenant", "t")], "/c": [("job", "default"), ("filename", "/c"), ("tenant", "t")], "/d": [("tenant", "t")]}


@pytest.mark.parametrize(("header", "want"), [(None, "default"), ("", "default"), (" team-1.x_Y\t", "team-1.x_Y"), ("a b", "default"), ("é", "default"), ("x\n", "default")])
def test_tenant_ids(header, want):
    assert ingest.tenant_id(header) == want


def test_engine_appends_what_it_returns(spark, tmp_path):
    e = LogEngine(spark, str(tmp_path / "t"), jobs=[{"job": "web", "paths": ["http"]}])
    e.ingest_lines("one\n\ntwo ERROR")
    e.push('{"streams":[{"stream":{"job":"api"},"values":[["1","pushed line"]]}]}', tenant="team-x")
    assert {(r.source, r.message) for r in e.query().collect()} == {("http", "one"), ("http", "two ERROR"), ("api", "pushed line")}
    assert [r.message for r in e.logql("{}", tenant="team-x").collect()] == ["pushed line"]
    assert [r.message for r in e.logql('{job="web"} |= "error"').collect()] == ["two ERROR"]
    assert [r.name for r in e.labels().collect()] == ["filename", "job", "source", "tenant"]
    assert e.metrics()["log_entries_total"] == 3 and e.metrics()["chunks_total"] >= 2
    with pytest.raises(ValueError, match="empty"):
        e.push("")


def test_config(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert load_config() == Config() and Config().http_port == 3100 and Config().chunk_max_bytes == 10_485_760
    text = json.dumps({"http_port": 9, "data_dir": "/d", "batch_size": "x", "watch_files": ["/w", "/p"], "scrape_configs": [{"job": "varlogs", "paths": ["/p", "/q"], "labels": {"env": "prod", "svc": "api"}}, {"job": "audit", "paths": ["/r"]}]})
    (tmp_path / "logquarry.json").write_text(text)
    c = load_config()
    assert (c.http_port, c.data_dir, c.batch_size) == (9, "/d", 256) and c == parse_config(text)
    assert [j["paths"] for j in c.jobs()] == [("/p", "/q"), ("/r",), ["/w"]] and c.scrape_configs[0].labels == (("env", "prod"), ("svc", "api"))
    with pytest.raises(OSError):
        load_config("missing.json")


def test_positions(tmp_path):
    path = str(tmp_path / "x/p.json")
    p = Positions(path).load()
    assert p.offsets == {}
    p.offsets["./logs/a.log"] = 12345
    p.save()
    assert Positions(path).load().offsets == {"./logs/a.log": 12345}
    (tmp_path / "x/p.json").write_text("broken")
    assert Positions(path).load().offsets == {}
    Positions("").save()
