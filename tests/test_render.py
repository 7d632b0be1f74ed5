import json

from logquarry import render
from logquarry.engine import LogEngine
from logquarry.model import ENTRIES, with_time


def frame(spark):
    lab = lambda **k: [{"key": a, "value": b} for a, b in k.items()]
    rows = [(0, 1_705_276_800_123_000_000, "f", 'say "hi"\t\\', None, lab(job="a")), (1, 1_705_276_860_000_000_000, "f", "x\n\x01é", None, lab(job="a")), (2, 1_705_276_860_000_000_001, "g", "y", None, [])]
    return with_time(spark.createDataFrame(rows, ENTRIES))


def test_streams(spark):
    got = json.loads(render.streams_json(frame(spark)))
    assert got["data"]["result"] == [
        {"stream": {"job": "a", "source": "f"}, "values": [["1705276800123000000", 'say "hi"\t\\'], ["1705276860000000000", "x\n\x01é"]]},
        {"stream": {"source": "g"}, "values": [["1705276860000000001", "y"]]},
    ]
    assert got["data"]["stats"] == {"summary": {"bytesProcessed": 0, "linesProcessed": 0}} and got["status"] == "success"


def test_matrix_and_errors(spark):
    e = LogEngine(spark, entries=frame(spark))
    text = e.logql_json("sum by (job) (rate({}[2s]))", start=1_705_276_800_000_000_000, end=1_705_276_999_000_000_000, tenant=None)
    assert text == '{"status":"success","data":{"resultType":"matrix","result":[{"metric":{"job":""},"values":[[1705276860.000,"0.5"]]},{"metric":{"job":"a"},"values":[[1705276800.000,"0.5"],[1705276860.000,"0.5"]]}]}}'
    assert json.loads(e.logql_json("rate({})")) == {"status": "error", "errorType": "bad_request", "error": "rate needs a range such as [5m]"}
    assert json.loads(e.logql_json("{}", tenant=None))["data"]["resultType"] == "streams"


def test_numbers():
    assert [render.number(x) for x in (1.0, 1e7, 0.1, 1e-7, 1.5, 123456789.25, float("inf"))] == ["1", "10000000", "0.1", "0.0000001", "1.5", "123456789.25", "inf"]


def test_native_text_and_lists(spark):
    got = json.loads(render.native_json(frame(spark).orderBy("seq")))
    assert got["count"] == 3 and got["results"][0] == {"timestamp": 1705276800123000000, "source": "f", "message": 'say "hi"\t\\', "labels": {"job": "a"}}
    assert [r.text for r in render.text_lines(frame(spark)).orderBy("seq").collect()][2] == "[2024-01-15T00:01:00.000Z] g: y"
    assert render.list_json(["job", "source"]) == '{"status":"success","data":["job","source"]}'
    e = LogEngine(spark, entries=frame(spark))
    assert json.loads(render.series_json(e.series(None)))["data"] == [{"job": "a", "source": "f"}, {"source": "g"}]


def test_exposition():
    text = render.exposition({"log_entries_total": 1000, "log_bytes_total": 50_000, "chunks_total": 5, "uptime_seconds": 3600, "active_connections": 3})
    assert "logquarry_log_entries_total 1000\n" in text and text.count("# HELP ") == text.count("# TYPE ") == 5
    assert json.loads(render.totals_json({"log_entries_total": 2}))["total_entries"] == 2
