"""Times as nanoseconds since the epoch, parsed on the driver, and their text form."""

from __future__ import annotations

import re
from datetime import date, datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 10**9
MAX_NS = 2**63 - 1
#: Whole numbers below this are seconds, others nanoseconds.
SECONDS_BELOW = 10**12
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400}
_EPOCH = date(1970, 1, 1).toordinal()
_DATE = re.compile(r"(\d{4}).(\d\d).(\d\d)", re.DOTALL)
_CLOCK = re.compile(r".(\d\d).(\d\d).(\d\d)", re.DOTALL)
_DURATION = re.compile(r"([0-9]+)([smhd]?)")


def parse_date(text: str) -> int | None:
    """Midnight of YYYY-MM-DD; separators are free, days to 31 roll over, years before 1970 count as 1970."""
    m = _DATE.match(text)
    if not m:
        return None
    year, month, day = map(int, m.groups())
    if not (1 <= month <= 12 and 1 <= day <= 31):
        return None
    # a year before the epoch keeps its own leap day
    skip = date(year, month, 1).toordinal() - date(year, 1, 1).toordinal() if year else (0, 31, 60, 91, 121, 152, 182, 213, 244, 274, 305, 335)[month - 1]
    start = date(max(year, 1970), 1, 1).toordinal() - _EPOCH
    return (start + skip + day - 1) * 86_400 * SECOND


def parse_datetime(text: str) -> int | None:
    """parse_date, and HH:MM:SS after one more character if all of it is there. What follows is not read."""
    day = parse_date(text)
    if day is None or len(text) < 19:
        return day
    m = _CLOCK.match(text, 10)
    if not m:
        return None
    h, minute, s = map(int, m.groups())
    return day + (h * 3600 + minute * 60 + s) * SECOND


def parse_timestamp(text: str) -> int | None:
    """A query parameter: whole seconds or nanoseconds, or fractional seconds; null leaves the bound open."""
    if re.fullmatch(r"[+-]?[0-9]+", text):
        n = int(text)
        n = n * SECOND if n < SECONDS_BELOW else n
    else:
        try:
            n = int(float(text) * SECOND)
        except (ValueError, OverflowError):
            return None
    return n if abs(n) <= MAX_NS else None


def parse_duration(text: str) -> int | None:
    """Seconds of 30s, 5m, 2h, 1d or a bare number; null for anything else."""
    m = _DURATION.fullmatch(text)
    return int(m[1]) * UNITS[m[2] or "s"] if m else None


def parse_step(text: str, default: int = 60) -> int:
    n = parse_duration(text)
    return default if n is None else n


def parse_relative(text: str, now_ns: int) -> int | None:
    """now, now-15m, nanoseconds in digits, or an ISO date and time; empty leaves the bound open."""
    text = text.strip()
    if text == "now":
        return now_ns
    if m := re.fullmatch(r"now-([0-9]+)([smhd])", text):
        return now_ns - int(m[1]) * UNITS[m[2]] * SECOND
    if text.isascii() and text.isdigit():
        return int(text)
    try:
        t = datetime.fromisoformat(text)
    except ValueError:
        return None
    t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    return round(t.timestamp() * 1000) * 10**6


def iso_millis(ts_ns: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS.mmmZ in a session whose time zone is UTC."""
    milli = F.lit(10**6).cast("long")
    # whole numbers throughout: a double has too few digits
    millis = F.call_function("div", ts_ns - F.pmod(ts_ns, milli), milli)
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def line_time(text: Column) -> Column:
    """Nanoseconds of the date and time at the start of a column, null where there is none (native parse_datetime for real dates)."""
    day = F.to_date(F.try_to_timestamp(F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 6, 2), F.substring(text, 9, 2)), F.lit("yyyy-MM-dd")))
    two = lambda at: F.substring(text, at, 2).try_cast("int")
    clock = two(12) * 3600 + two(15) * 60 + two(18)
    seconds = F.unix_date(day).cast("long") * 86_400 + F.when(F.length(text) < 19, F.lit(0)).otherwise(clock)
    return F.when(F.length(text) >= 10, seconds * SECOND)
