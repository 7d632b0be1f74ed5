"""The query language: stream selectors, line filters and step metrics.

    {job="api", level!="debug"} |= "timeout" != "health" | limit 50
    sum by (level) (rate({job="api"} |= "timeout" [5m]))

The text becomes a frozen tree on the driver; plans are compiled from it. The
tolerant reading below is the documented one: unknown stages and stray
characters are passed over. ``strict`` refuses them instead.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from logquarry.functions.times import parse_duration


class QueryError(ValueError):
    """The text is no query."""


@dataclass(frozen=True)
class Matcher:
    name: str
    op: str  # = != =~ !~
    value: str


@dataclass(frozen=True)
class LineFilter:
    op: str  # |= != |~ !~
    text: str


@dataclass(frozen=True)
class Metric:
    op: str  # count_over_time, rate
    range_s: int
    by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Query:
    matchers: tuple[Matcher, ...] = ()
    filters: tuple[LineFilter, ...] = ()
    limit: int = 0
    metric: Metric | None = None
    #: Characters and stages that were passed over.
    ignored: tuple[str, ...] = field(default=(), compare=False)

    def scoped(self, tenant: str) -> Query:
        """The query of one tenant."""
        return Query((*self.matchers, Matcher("tenant", "=", tenant)), self.filters, self.limit, self.metric, self.ignored)

    def row_limit(self, asked: int) -> int:
        """The smaller of the two limits; an asked 0 (no limit) stays."""
        return self.limit if 0 < self.limit < asked else asked


METRICS = ("count_over_time", "rate")
#: Either quote; a backslash keeps the next character and stays in the value.
_QUOTED = r'(?:"(?P<d>(?:\\.|[^"\\])*)"|`(?P<b>(?:\\.|[^`\\])*)`)'
_MATCHER = re.compile(r"(?P<name>[A-Za-z0-9_]+) *(?P<op>=~|!~|!=|=) *" + _QUOTED, re.DOTALL)
_FILTER_OP = re.compile(r"(?P<op>\|=|!=|\|~|!~) *")
_FILTER_TEXT = re.compile(_QUOTED, re.DOTALL)
_LIMIT = re.compile(r"\| *limit *(?P<n>[0-9]*)")
_STAGE = re.compile(r"\| *.?", re.DOTALL)
_SUM = re.compile(r"sum[ \t]*(?:by[ \t]*(?:\((?P<by>[^)]*)\))?[ \t]*)?")
_CALL = re.compile(rf"(?P<op>{'|'.join(METRICS)})[ \t]*(?=\()")
_BLANK = " \t\r\n"


def parse(text: str, strict: bool = False) -> Query:
    """Raises QueryError for a text that is no query; with ``strict`` also for one of which parts would be passed over."""
    inner = text.strip(_BLANK)
    ignored: list[str] = []
    by: tuple[str, ...] = ()
    summed = False
    if (m := _SUM.match(inner)) and inner.startswith("(", m.end()):
        by = tuple(n for x in (m["by"] or "").split(",") if (n := x.strip(" \t")))
        body, rest = _parentheses(inner, m.end())
        inner, summed = body.strip(" \t"), True
        ignored += [rest] * bool(rest.strip(_BLANK))
    metric = None
    if m := _CALL.match(inner):
        body, rest = _parentheses(inner, m.end())
        ignored += [rest] * bool(rest.strip(_BLANK))
        selector, bracket, tail = body.rpartition("[")
        span, closed, after = tail.rpartition("]")
        seconds = parse_duration(span) if bracket and closed else None
        if seconds is None:
            raise QueryError(f"{m['op']} needs a range such as [5m]")
        ignored += [after] * bool(after.strip(_BLANK))
        metric, inner = Metric(m["op"], seconds, by), selector.strip(" \t")
    elif summed:
        raise QueryError("sum needs count_over_time or rate")
    matchers, at = _selector(inner)
    filters, limit = _stages(inner, at, ignored)
    if strict and ignored:
        raise QueryError(f"not understood: {' '.join(ignored)}")
    return Query(tuple(matchers), tuple(filters), limit, metric, tuple(ignored))


def _parentheses(text: str, at: int) -> tuple[str, str]:
    """What stands between the parenthesis at ``at`` and its partner, and after that; quotes don't shield parentheses."""
    depth = 0
    for m in re.compile("[()]").finditer(text, at):
        depth += 1 if m[0] == "(" else -1
        if depth == 0:
            return text[at + 1 : m.start()], text[m.end() :]
    raise QueryError("a parenthesis is left open")


def _selector(text: str) -> tuple[list[Matcher], int]:
    """The matchers and where the stages begin; a missing closing brace is forgiven."""
    text_end, found = len(text.rstrip(_BLANK)), []
    at = len(text) - len(text.lstrip(_BLANK))
    if not text.startswith("{", at):
        return found, at
    at += 1
    while True:
        at = re.compile(r"[ ,\t]*").match(text, at).end()
        if at >= text_end:
            return found, at
        if text[at] == "}":
            return found, at + 1
        m = _MATCHER.match(text, at)
        if not m:
            raise QueryError(f"no label matcher at {text[at : at + 20]!r}")
        found.append(Matcher(m["name"], m["op"], m["d"] if m["d"] is not None else m["b"]))
        at = m.end()


def _stages(text: str, at: int, ignored: list[str]) -> tuple[list[LineFilter], int]:
    filters, limit = [], 0
    while at < len(text):
        if m := _FILTER_OP.match(text, at):
            value = _FILTER_TEXT.match(text, m.end())
            if not value:
                raise QueryError(f"{m['op']} needs a quoted text")
            filters.append(LineFilter(m["op"], value["d"] if value["d"] is not None else value["b"]))
            at = value.end()
        elif m := _LIMIT.match(text, at):
            if m["n"]:
                limit = int(m["n"]) if int(m["n"]) < 2**64 else 0
            at = m.end()
        else:
            m = _STAGE.match(text, at)
            end = m.end() if m else at + 1
            ignored += [text[at:end]] * bool(text[at:end].strip(_BLANK))
            at = end
    return filters, limit
