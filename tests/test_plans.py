import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logquarry.engine import LogEngine
from logquarry.model import ENTRIES, with_time
from logquarry.plans import catalog
from logquarry.plans.language import parse
from logquarry.plans.predicates import passes, selected
from logquarry.sources import table

S = 10**9


def entry(seq, ts, source="src", message="m", labels=()):
    return (seq, ts, source, message, message, [{"key": k, "value": v} for k, v in labels])


def frame(spark, rows):
    return with_time(spark.createDataFrame(rows, ENTRIES))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    words = ["ERROR", "error", "health", "Timeout", "ok", "%", "É", "é"]
    return [entry(i, i * 7 * S + i % 3, f"s{i % 3}", " ".join(r.choice(words) for _ in range(3)), [("job", r.choice("abc"))] + [("level", "x,y=1")] * (i % 2) + [("job", "second")] * (i % 5 == 0) + [("tenant", "t1")] * (i % 4 == 0)) for i in range(200)]


@pytest.fixture(scope="module")
def engine(spark, rows):
    return LogEngine(spark, entries=frame(spark, rows).cache())


def fold(s):
    return "".join(c.lower() if c.isascii() else c for c in s)


def model(row, matchers, filters):
    """What selection means, in plain Python."""
    labels = [("source", row[2]), ("filename", row[2])] + [(x["key"], x["value"]) for x in row[5]]
    if not any(k == "tenant" for k, _ in labels):
        labels.append(("tenant", "default"))
    for m in matchers:
        v = next((v for k, v in labels if k == m.name), None)
        hit = v is not None and (v == m.value if m.op in ("=", "!=") else fold(m.value) in fold(v))
        if hit != (m.op[0] == "="):
            return False
    return all((fold(f.text) in fold(row[3])) == (f.op[0] == "|") for f in filters)


NAMES = st.sampled_from(["job", "level", "tenant", "source", "filename", "nope"])
VALUES = st.sampled_from(["a", "A", "", "second", "x,y=1", "t1", "default", "s1", "S"])


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(NAMES, st.sampled_from(["=", "!=", "=~", "!~"]), VALUES), max_size=3), st.lists(st.tuples(st.sampled_from(["|=", "!=", "|~", "!~"]), st.sampled_from(["error", "ERR", "", "é", "%", "k t"])), max_size=3))
def test_selection_equals_the_model(engine, rows, matchers, filters):
    text = "{" + ",".join(f'{n}{op}"{v}"' for n, op, v in matchers) + "}" + "".join(f' {op} "{v}"' for op, v in filters)
    q = parse(text)
    got = [r.seq for r in engine.logql(text, limit=0, tenant=None).collect()]
    assert got == [r[0] for r in rows if model(r, q.matchers, q.filters)]


def test_a_filter_and_its_negation_split_the_rows(engine):
    df = engine.entries
    q = parse('{} |= "error"').filters[0], parse('{} != "error"').filters[0]
    assert df.where(passes(q[0])).count() + df.where(passes(q[1])).count() == df.count()


def test_bounds_limits_and_direction(engine):
    ts = [r.ts_ns for r in engine.query(limit=0).collect()]
    assert [r.ts_ns for r in engine.query(start=ts[3], end=ts[9], limit=0).collect()] == ts[3:10]
    assert engine.query().count() == 200 and engine.query(limit=7).count() == 7
    assert [r.ts_ns for r in engine.logql("{}", limit=5, tenant=None, direction="backward").collect()] == ts[:-6:-1]
    assert engine.logql("{} | limit 3", tenant=None).count() == 3


def test_bucket_counts_add_up(engine):
    for end, whole in ((1000 * S + 5, True), (600 * S, False)):
        samples = engine.logql("sum by (job) (count_over_time({}[1m]))", start=0, end=end, tenant=None).collect()
        inside = engine.query(start=1, end=end if whole else end - 1, limit=0).count() + engine.query(start=0, end=0, limit=0).count()
        assert sum(r.value for r in samples) == inside
        assert all(r.ts_ns % (60 * S) == 0 for r in samples)


def test_empty_ranges_and_groups(engine):
    assert engine.logql("rate({}[1m])", start=10, end=10, tenant=None).count() == 0
    assert {r.tenant for r in engine.logql("sum by (tenant) (rate({}[1m]))", tenant=None, end=10**15).collect()} == {"", "t1"}
    assert engine.logql("sum by (job, job) (rate({}[1m]))", tenant=None).columns == ["job", "ts_ns", "value"]


def test_streams_sort_by_key_alone(spark):
    df = frame(spark, [entry(1, 5, "f", "two", [("z", "1"), ("a", "2"), ("a", "1"), ("source", "own")]), entry(0, 5, "f", "one", [("a", "2"), ("z", "1"), ("a", "1")])])
    got = catalog.streams(df).collect()
    assert [r.stream_fp for r in got] == ["a=2\x1fa=1\x1fsource=f\x1fz=1"]
    assert [v.message for v in got[0]["values"]] == ["one", "two"]


def test_scan_gets_bounds_columns_and_promoted_labels(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    table.append(frame(spark, rows), path, ["job", "tenant"], files=3)
    e = LogEngine(spark, path, promoted=["job", "tenant"])
    df = e.logql('{job="a"}', start=100 * S, end=900 * S, limit=0).select("seq")
    assert sorted(r.seq for r in df.collect()) == sorted(r[0] for r in rows if 100 * S <= r[1] <= 900 * S and model(r, parse('{job="a",tenant="default"}').matchers, ()))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts_ns,100000000000)" in plan and "Or(EqualTo(job,a),IsNull(job))" in plan and "PartitionFilters: [isnotnull(day" in plan and "raw_line" not in plan
    assert "Exchange rangepartitioning" in plan and "Python" not in plan


def test_keyword_index_never_loses_a_match(spark, rows, tmp_path):
    path, terms = str(tmp_path / "t"), str(tmp_path / "terms")
    table.append(frame(spark, rows), path, files=6)
    table.append(frame(spark, [entry(900, 5 * S, message="disk nearly full now")]), path)
    table.build_terms(spark, path, terms)
    for k in ("disk nearly full", "isk nearly fu", "error", "x health y", "k t", ""):
        q = parse("{} |= \"" + k + '"')
        want = {r.seq for r in selected(table.open_table(spark, path), q).collect()}
        found = table.open_for_keyword(spark, path, terms, k)
        assert {r.seq for r in selected(found, q).collect()} == want
    few = table.open_for_keyword(spark, path, terms, "disk nearly full")
    assert len(few.inputFiles()) == 1 < len(table.open_table(spark, path).inputFiles())
    assert table.open_table(spark, path).where(F.col("day").isNull()).count() == 0
    assert table.open_for_keyword(spark, path, terms, "disk nearly full", most=0).count() == 201
    # files that came after the index was built are read as well, until it knows them
    table.append(frame(spark, [entry(901, 5 * S, message="disk nearly full again")]), path)
    assert len(table.open_for_keyword(spark, path, terms, "disk nearly full").inputFiles()) == 2
    assert table.build_terms(spark, path, terms) == 1 and table.build_terms(spark, path, terms) == 0
    assert len(table.open_for_keyword(spark, path, terms, " error ").inputFiles()) == 6


def test_engine_queries_use_the_index(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    for part in (rows[:100], rows[100:], [entry(900, 5 * S, message="disk nearly full now")]):
        table.append(frame(spark, part), path)
    e = LogEngine(spark, path)
    assert e.query("disk nearly full").count() == 1 and e.index_terms() == len(e.entries.inputFiles())
    found = e.query("disk nearly full", limit=0)
    assert len(found.inputFiles()) == 1 and [r.seq for r in found.collect()] == [900]
    assert e.query("ERROR", limit=0).count() == LogEngine(spark, entries=e.entries).query("ERROR", limit=0).count()


def test_broken_files_are_passed_over_unless_strict(spark, rows, tmp_path):
    path = tmp_path / "t"
    table.append(frame(spark, rows), str(path))
    table.append(frame(spark, rows[:5]), str(path), batch="9-broken")
    for f in path.glob("day=*/batch=9-broken/*.parquet"):
        f.write_bytes(b"no parquet")
    for f in path.glob("day=*/batch=9-broken/.*.crc"):
        f.unlink()
    assert LogEngine(spark, str(path)).query(limit=0).count() == 200
    with pytest.raises(Exception, match="FAILED_READ_FILE|not a Parquet"):
        LogEngine(spark, str(path), strict=True).query(limit=0).collect()
