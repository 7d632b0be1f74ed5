"""Personal data by anchor expansion.

One Aho-Corasick pass per text finds anchors: at-signs, plus signs, pairs of
digits (side by side, or around a space, hyphen or dot), URL schemes and cues
of secrets, accounts and streets, in any case of ASCII letters. Parsers then
expand each anchor to the boundaries of the datum and validate it. A parser
never looks outside the run of characters that its kind allows, so the work
follows the text's length.

Kinds email, ip, card and phone are exactly the leftmost non-overlapping
matches of the patterns in the contract; url, secret, account and street are
added. A street is a house number, one to four capitalised words and a word
such as Street or Avenue, or a capitalised word in -strasse and a house number.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone", "url", "secret", "account", "street")
BASE = KINDS[:4]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_IS_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_GROUPED = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_URL = re.compile(r"[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]+")
_VALUE = re.compile(r"[ \t]*(?:=|:|is)[ \t]*[\"']?([^\s\"',;]{8,})")
_ACCESS = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")
_NUMBER = re.compile(r"[ \t]*(?:number|no\.?|nr\.?|#|:|=)*[ \t:#=]*([0-9](?:[ -]?[0-9]){5,33})", re.IGNORECASE)
_IBAN = re.compile(r"[ \t:]*([A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]){11,30})")

#: Anchors and the parser that each calls.
_SECRET_CUES = ("password", "passwd", "token", "secret", "api_key", "apikey")
_ACCOUNT_CUES = ("account", "acct", "iban", "passport", "ssn")
_STREET_CUES = (" street", " avenue", " road", " lane", " boulevard", " drive", " square")
_STREET_ENDS = ("strasse", "straße")
#: Characters before a street cue that can belong to the address.
_STREET_REACH = 64
_HOUSE = re.compile(r"(?<![0-9A-Za-z.,-])[0-9]{1,5}[A-Za-z]?(?: [A-Z][A-Za-z'.-]*){1,4}\Z")
_CAPITAL = re.compile(r"(?<!\w)[A-ZÄÖÜ][\w-]*\Z")
_BEHIND = re.compile(r" [0-9]{1,4}(?:[a-z](?!\w))?(?![0-9])")


def _anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for cue in ("http://", "https://", "ftp://"):
        a.add_word(cue, ("url", len(cue)))
    for cue in _SECRET_CUES:
        a.add_word(cue, ("secret", len(cue)))
    a.add_word("akia", ("access", 4))
    for cue in _ACCOUNT_CUES:
        a.add_word(cue, ("account", len(cue)))
    for cue in _STREET_CUES:
        a.add_word(cue, ("house", len(cue)))
    for cue in _STREET_ENDS:
        a.add_word(cue, ("street", len(cue)))
    a.add_word("@", ("email", 1))
    a.add_word("+", ("phone", 1))
    for x in "0123456789":
        for y in "0123456789":
            a.add_word(x + y, ("card", 2))
            a.add_word(f"{x} {y}", ("card", 3))
            a.add_word(f"{x}-{y}", ("card", 3))
            a.add_word(f"{x}.{y}", ("ip", 3))
    a.make_automaton()
    return a


_AUTOMATON: ahocorasick.Automaton | None = None


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _email(t: str, at: int, last: int) -> tuple[int, int, bool] | None:
    start = at
    while start > last and t[start - 1] in _IS_LOCAL:
        start -= 1
    m = _DOMAIN.match(t, at + 1) if start < at else None
    return m and (start, m.end(), True)


def _phone(t: str, at: int, last: int) -> tuple[int, int, bool] | None:
    m = _PHONE.match(t, at)
    return m and (at, m.end(), 8 <= sum(c in _DIGITS for c in m[0]) <= 15)


def _run_start(t: str, at: int, last: int) -> int:
    while at > last and t[at - 1] in _DIGITS:
        at -= 1
    return at


def _card(t: str, at: int, last: int) -> tuple[int, int, bool]:
    """``at`` is the first pair of a chain, as later ones lie inside the match."""
    m = _GROUPED.match(t, _run_start(t, at, last))
    d = m[0].replace(" ", "").replace("-", "")
    return m.start(), m.end(), 16 <= len(d) <= 19 and luhn(d)


def _valid_part(p: str) -> bool:
    p = p.lstrip("0")
    return len(p) <= 3 and int(p or "0") <= 255


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, end exclusive, by kind as listed in KINDS and then start."""
    global _AUTOMATON
    if _AUTOMATON is None:
        _AUTOMATON = _anchors()
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    past = dict.fromkeys(KINDS, 0)

    def keep(kind: str, got: tuple[int, int, bool] | None) -> None:
        """A match, valid or not, is passed over: there are no retries inside it."""
        if got:
            past[kind] = got[1]
            if got[2]:
                found[kind].append(got[:2])

    # bytes fold ASCII letters only, so offsets stay
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    for end, (kind, length) in _AUTOMATON.iter(low):
        at = end - length + 1
        if kind == "ip":
            if at >= past["ip"]:
                m = _DOTTED.match(text, _run_start(text, at, past["ip"]))
                parts, p = m[0].split("."), m.start()
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    e = p + sum(map(len, four)) + 3
                    if all(map(_valid_part, four)):
                        found["ip"].append((p, e))
                    p = e + 1
                past["ip"] = m.end()
        elif kind == "card":
            if at >= past["card"]:
                keep("card", _card(text, at, past["card"]))
        elif kind in ("email", "phone"):
            if at >= past[kind]:
                keep(kind, (_email if kind == "email" else _phone)(text, at, past[kind]))
        elif kind == "url":
            if at >= past["url"] and (m := _URL.match(text, end + 1)):
                e = m.end() - (len(m[0]) - len(m[0].rstrip(".,;:!?)]'")))
                keep("url", (at, e, e > end + 1))
        elif kind == "access":
            if at >= past["secret"] and (at == 0 or not text[at - 1].isalnum()) and (m := _ACCESS.match(text, at)):
                keep("secret", (at, m.end(), True))
        elif kind == "secret":
            if at >= past["secret"] and (m := _VALUE.match(text, end + 1)) and any(c in _DIGITS for c in m[1]):
                keep("secret", (m.start(1), m.end(1), True))
        elif kind == "house":
            if not text[end + 1 : end + 2].isalnum() and text[at + 1].isupper() and (m := _HOUSE.search(text, max(past["street"], at - _STREET_REACH), at)):
                keep("street", (m.start(), end + 1, True))
        elif kind == "street":
            if (m := _BEHIND.match(text, end + 1)) and (w := _CAPITAL.search(text, max(past["street"], at - _STREET_REACH), at + 1)):
                keep("street", (w.start(), m.end(), True))
        elif at >= past["account"]:
            cue = low[at : end + 1]
            if m := (_IBAN if cue == "iban" else _NUMBER).match(text, end + 1):
                keep("account", (m.start(1), m.end(1), cue != "iban" or iban(m[1])))
    return [(k, s, e) for k in KINDS for s, e in sorted(found[k])]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[tuple[str, int, int]], mark: Callable[[str], str] = lambda k: f"<{k}>") -> str:
    """The text with each span replaced by a mark; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += (text[at:s], mark(kind))
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_pii(df: DataFrame, id_col: str, text_col: str, redacted: bool = False) -> DataFrame:
    """Per row: id, spans (joined), counts of the base kinds, base_sha256 and, if asked for, the redacted text.

    Null counts as empty and has no spans. Whole texts are read, however long.
    Spans of one kind never overlap, those of two kinds may, and each is given.
    Rows that repeat an id stay apart, and an empty table has none. Columns
    other than the two named are not looked at.
    """
    names = [*(f"n_{k}" for k in BASE), "base_sha256", "spans", *["redacted"] * redacted]
    shape = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(n, T.LongType() if n[:2] == "n_" else T.StringType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(len(BASE) + 2 + redacted)]
            for text in b.column(1):
                text = text.as_py() or ""
                spans = find(text)
                base = [x for x in spans if x[0] in BASE]
                row = [sum(x[0] == k for x in base) for k in BASE]
                row += [hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)]
                for o, x in zip(out, row + [redact(text, spans)] * redacted, strict=True):
                    o.append(x)
            kinds = [pa.int64()] * len(BASE) + [pa.string()] * (2 + redacted)
            yield pa.record_batch([b.column(0), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], names=shape.names)

    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, shape)


def op6_pii_anchors(spark, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


def pii_base_counts(spark, sf_dir: str) -> DataFrame:
    """How many spans of the base kinds each document has."""
    return op6_pii_anchors(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in BASE))


_DIGITS_OF = "list_transform(regexp_extract_all({}, '[0-9]'), lambda c: c::INT)"
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS e, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS i,
  list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: {_DIGITS_OF.format("x")}) AS c, regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]') AS p FROM d)
SELECT doc_id, len(e) AS n_email,
  len(list_filter(i, lambda x: len(list_filter(string_split(x, '.'), lambda v: len(ltrim(v, '0')) > 3 OR TRY_CAST(v AS HUGEINT) > 255)) = 0)) AS n_ip,
  len(list_filter(c, lambda x: len(x) BETWEEN 16 AND 19 AND list_sum(list_transform(x, lambda v, k: CASE WHEN (len(x) - k) % 2 = 0 THEN v ELSE 2 * v // 10 + 2 * v % 10 END)) % 10 = 0)) AS n_card,
  len(list_filter(p, lambda x: len(regexp_extract_all(x, '[0-9]')) BETWEEN 8 AND 15)) AS n_phone
FROM m
"""
