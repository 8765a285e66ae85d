"""Column helpers for text: Unicode white space, lines, substrings, let-bindings."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the code points that count as white space when text is stripped.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column | str) -> Column:
    """Both ends without Unicode white space; the built-in trim removes spaces only."""
    return F.btrim(col(c), F.lit(WHITE_SPACE))


def is_blank(c: Column | str) -> Column:
    """Null, empty or white space."""
    return F.coalesce(strip(c) == "", F.lit(True))


def raw_lines(c: Column | str) -> Column:
    """Lines between line feeds, empty and trailing ones too."""
    return F.split(col(c), "\n", -1)


def lines(c: Column | str) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(raw_lines(c), strip), lambda x: x != "")


def contains_any(c: Column | str, parts: Iterable[str]) -> Column:
    return reduce(or_, [F.contains(col(c), F.lit(p)) for p in parts])


def occurrences(c: Column | str, part: str) -> Column:
    """Number of non-overlapping occurrences of a literal."""
    return ((F.length(col(c)) - F.length(F.replace(col(c), F.lit(part), F.lit("")))) / len(part)).cast("int")


def alnum_count(c: Column | str) -> Column:
    """Letters and numbers, by Unicode category."""
    return F.length(F.regexp_replace(col(c), r"[^\p{L}\p{N}]", ""))


def unix_newlines(c: Column | str) -> Column:
    return F.replace(col(c), F.lit("\r\n"), F.lit("\n"))
