import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logquarry.plans.language import LineFilter, Matcher, Metric, Query, QueryError, parse

A = Matcher("a", "=", "b")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{job="a", level!="debug"}', Query((Matcher("job", "=", "a"), Matcher("level", "!=", "debug")))),
        ('{x=~"p",y!~`q`}', Query((Matcher("x", "=~", "p"), Matcher("y", "!~", "q")))),
        ('{a="b"} |= "x" != "y" |~ "z.*" !~ "w" | limit 5', Query((A,), (LineFilter("|=", "x"), LineFilter("!=", "y"), LineFilter("|~", "z.*"), LineFilter("!~", "w")), 5)),
        ("{}", Query()),
        ("", Query()),
        ("error", Query()),
        ('{a="b"', Query((A,))),
        ('{a="b"} | json', Query((A,))),
        ('{a="b"} | level != "x"', Query((A,), (LineFilter("!=", "x"),))),
        ('|= "a\\"b"', Query((), (LineFilter("|=", 'a\\"b'),))),
        ("| limit 3 | limit 7", Query(limit=7)),
        ("| limit x", Query()),
        ('rate({a="b"} |= "e" [5m])', Query((A,), (LineFilter("|=", "e"),), metric=Metric("rate", 300))),
        ('rate({a="b"}[90])', Query((A,), metric=Metric("rate", 90))),
        ('count_over_time({a="b"}[5m] |= "x")', Query((A,), metric=Metric("count_over_time", 300))),
        ('sum by (l, m) (rate({a="b"}[1m]))', Query((A,), metric=Metric("rate", 60, ("l", "m")))),
        ('sum(rate({a="b"}[1m])) by (l)', Query((A,), metric=Metric("rate", 60))),
        ('sum(rate({a="b"}[1m])) > 5', Query((A,), metric=Metric("rate", 60))),
        ('sum by () (rate({a="b"}[1m]))', Query((A,), metric=Metric("rate", 60))),
        ('sum by (l) rate({a="b"}[1m])', Query()),
        ('topk(5, rate({l!="x"} |= "e" [5m]))', Query((), (LineFilter("!=", "x"), LineFilter("|=", "e")))),
        ('bytes_over_time({a="b"}[1m])', Query()),
    ],
)
def test_golden(text, want):
    assert parse(text) == want


@pytest.mark.parametrize("text", ["{job=a}", "{job='a'}", '{="a"}', '{a.b="c"}', '{a="b",\n c="d"}', '{a="b"} |= foo', '{a="b} |= "x"', 'rate({a="b"})', 'rate({a="b"}[5x])', 'rate({a="b"}[1h30m])', 'rate({a="b"} |= "x)" [5m])', 'sum({a="b"})', "rate({}[5m]", "sum by (a (rate({}[1m]"])
def test_refused(text):
    with pytest.raises(QueryError):
        parse(text)


@pytest.mark.parametrize("text", ["error", '{a="b"} | json', "topk(5, rate({}[5m]))", "sum(rate({}[1m])) by (l)"])
def test_strict_refuses_what_is_passed_over(text):
    with pytest.raises(QueryError):
        parse(text, strict=True)


def test_limits_and_tenants():
    assert [parse(f"| limit {n}").row_limit(a) for n, a in ((5, 1000), (0, 10), (50, 10), (5, 0))] == [5, 10, 10, 0]
    assert parse('{a="b"}').scoped("t").matchers == (A, Matcher("tenant", "=", "t"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='{}()[]|=!~",`\\ abrte5ms\n', max_size=40))
def test_never_breaks_otherwise(text):
    try:
        assert isinstance(parse(text), Query)
    except QueryError:
        pass


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["=", "!=", "=~", "!~"]), st.text(max_size=8)), max_size=4), st.lists(st.tuples(st.sampled_from(["|=", "!=", "|~", "!~"]), st.text(max_size=8)), max_size=4))
def test_printed_queries_come_back(matchers, filters):
    plain = lambda t: t.replace("\\", "/").replace('"', "'")
    text = "{" + ", ".join(f'm{i}{op}"{plain(v)}"' for i, (op, v) in enumerate(matchers)) + "} " + " ".join(f'{op} "{plain(v)}"' for op, v in filters)
    q = parse(text)
    assert [(m.op, m.value) for m in q.matchers] == [(op, plain(v)) for op, v in matchers]
    assert [(f.op, f.text) for f in q.filters] == [(op, plain(v)) for op, v in filters]
