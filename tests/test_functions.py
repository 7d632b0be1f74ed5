import pytest
from pyspark.sql import functions as F

from logquarry.functions import text, times

DAY = 86_400 * times.SECOND


@pytest.mark.parametrize(
    ("value", "want"),
    [("2024-01-15", 1_705_276_800 * times.SECOND), ("2024/01x15zzz", 1_705_276_800 * times.SECOND), ("2024-02-31", 1_709_337_600 * times.SECOND), ("1960-01-02", DAY), ("2024-13-01", None), ("2024-00-10", None), ("2024-01-32", None), ("2024-1-1", None), ("abcd-01-01", None), ("", None)],
)
def test_dates(value, want):
    assert times.parse_date(value) == want


def test_datetimes():
    base = times.parse_date("2024-01-16")
    assert times.parse_datetime("2024-01-16") == times.parse_datetime("2024-01-16T10:20") == base
    assert times.parse_datetime("2024-01-16T10:20:30.999Z") == base + 37_230 * times.SECOND
    assert times.parse_datetime("2024-01-16 1x:20:30") is None and times.parse_datetime("short") is None


def test_parameters():
    assert times.parse_timestamp("1700000000") == times.parse_timestamp("1700000000000000000") == 1_700_000_000 * times.SECOND
    assert times.parse_timestamp("1700000000000") == 1_700_000_000_000  # milliseconds are read as nanoseconds
    assert times.parse_timestamp("1.5") == 1_500_000_000 and times.parse_timestamp("x") is times.parse_timestamp("") is None
    assert times.parse_timestamp("999999999999") is None  # seconds beyond the range leave the bound open
    assert [times.parse_duration(x) for x in ("30s", "5m", "2h", "1d", "7", "1h30m", "5ms", "m", "")] == [30, 300, 7200, 86_400, 7, None, None, None, None]
    assert [times.parse_step(x) for x in ("5m", "15", "x")] == [300, 15, 60]


def test_relative_times():
    now = 10**18
    assert times.parse_relative("now", now) == now and times.parse_relative(" now-15m ", now) == now - 900 * times.SECOND
    assert times.parse_relative("123", now) == 123 and times.parse_relative("1970-01-02T00:00:00Z", now) == DAY
    assert times.parse_relative("", now) is times.parse_relative("soon", now) is None


@pytest.mark.parametrize(("hay", "needle", "want"), [("Hello World", "world", True), ("ERROR: connection refused", "error", True), ("Hello World", "xyz", False), ("test", "", True), ("100%", "0%", True), ("É", "é", False), ("a.c", "a?c", False)])
def test_contains(spark, hay, needle, want):
    assert spark.createDataFrame([(hay,)], "m string").select(text.contains_folded("m", needle)).first()[0] is want


def test_tokens(spark):
    df = spark.createDataFrame([("ERROR: db-1 timed_out, x (error) " + "y" * 129,)], "m string")
    assert df.select(text.tokens("m")).first()[0] == ["error", "db-1", "timed_out"]
    assert text.bounded_tokens("err: time out in") == ["time", "out"] and text.bounded_tokens("err") == []


def test_line_times(spark):
    values = ["2024-01-16T10:20:30Z", "2024-01-16", "2024-01-16T1x:00:00", "nope", None, "2024-02-31T00:00:00"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(times.line_time(F.col("v"))).collect()]
    base = times.parse_date("2024-01-16")
    assert got == [base + 37_230 * times.SECOND, base, None, None, None, None]


def test_iso(spark):
    assert spark.range(1).select(times.iso_millis(F.lit(1_705_276_800_123_456_789))).first()[0] == "2024-01-15T00:00:00.123Z"


def test_folded_search_takes_every_character_literally(spark):
    texts = ["a.B*c", "x\\Qy\\E z", "K and k and K", "tab\there\nline", "[set] (group) {3} ^$|?+#", "ſ s É é", "a b", ""]
    needles = ["A.b", "\\qY", "\\E", "K", "K", "T\tH", "E\nL", "[SET", "P) {", "^$|?+#", "S", "É", "é", "B", " ", "", "x#", "a-b", "&&"]
    fold = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = df.select("t", *(text.contains_folded("t", n).alias(str(i)) for i, n in enumerate(needles))).collect()
    assert [[r[str(i)] for i in range(len(needles))] for r in got] == [[fold(n) in fold(t) for n in needles] for t in texts]


def test_milliseconds_are_exact(spark):
    ns = [1_704_553_130_026_000_000, 1_704_553_130_025_999_999, 0, -1, -1_000_000]
    got = [r.t for r in spark.createDataFrame([(i, n) for i, n in enumerate(ns)], "i int, n long").orderBy("i").select(times.iso_millis(F.col("n")).alias("t")).collect()]
    assert got == ["2024-01-06T14:58:50.026Z", "2024-01-06T14:58:50.025Z", "1970-01-01T00:00:00.000Z", "1969-12-31T23:59:59.999Z", "1969-12-31T23:59:59.999Z"]
