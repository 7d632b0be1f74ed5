"""Text functions that treat ASCII letters, and no others, alike in both cases."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

_FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: Shortest and longest token, in characters.
TOKEN_LENGTH = (2, 128)


def folded(text: str) -> str:
    return text.translate(_FOLD)


def fold(column: Column | str) -> Column:
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def contains_folded(column: Column | str, needle: str) -> Column:
    """Literal substring in either case; an empty one is in every text.

    (?i) alone folds ASCII letters and no others, without a copy of the text.
    """
    if not any(c in string.ascii_letters for c in needle):
        return F.contains(column if isinstance(column, Column) else F.col(column), F.lit(needle))
    literal = "".join(f"\\{c}" if c.isascii() and not c.isalnum() else c for c in needle)
    return F.rlike(column, F.lit(f"(?i){literal}"))


def tokens(column: Column | str) -> Column:
    """Distinct tokens: runs of ASCII letters, digits, _ and -, in lower case."""
    low, high = TOKEN_LENGTH
    parts = F.filter(F.split(column, "[^0-9A-Za-z_\\-]+"), lambda x: F.length(x).between(low, high))
    return F.array_distinct(F.transform(parts, F.lower))  # of ASCII only


def bounded_tokens(needle: str) -> list[str]:
    """Tokens that every text with this substring has: runs with a delimiter on both sides inside it."""
    low, high = TOKEN_LENGTH
    out, run = [], None
    for c in folded(needle):
        if c.isascii() and (c.isalnum() or c in "_-"):
            if run is not None:
                run += c
        else:
            if run and low <= len(run) <= high:
                out.append(run)
            run = ""
    return out
