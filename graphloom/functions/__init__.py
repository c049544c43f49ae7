"""Column helpers with Python's semantics where Spark's differ."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import spec

#: What Python's str.strip() takes off.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
#: Classes and case of all Unicode, only \n ends a line: what Python's re means.
UNICODE = "(?Uud)"


def strip(c: Column | str) -> Column:
    """All white space at both ends, as Python sees it."""
    return F.trim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE))


def lines(c: Column | str) -> Column:
    """Split at newlines; a trailing newline gives a last empty line."""
    return F.split(c, "\n", -1)


def split_lines(c: Column | str) -> Column:
    """Lines as Python's str.splitlines() gives them: no empty last line after a final line end."""
    c = F.col(c) if isinstance(c, str) else c
    drop_last = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return let(F.split(c, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]", -1), drop_last)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value being worked out once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def count_matches(c: Column | str, patterns: list[str], flags: str = "(?im)") -> Column:
    """Matches of all patterns in one text."""
    total = F.lit(0)
    for p in patterns:
        total = total + F.regexp_count(c, F.lit(flags + p))
    return total


def holds(c: Column, words: list[str]) -> Column:
    """Whether some of the words is part of the text."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))


def base_file(path: Column | str) -> Column:
    """Lower-cased last part of a path."""
    return F.lower(F.regexp_extract(path, r"([^/]*)/*$", 1))


def suffix(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def language(path: Column | str) -> Column:
    """python, javascript, typescript or tsx by suffix; null for other files."""
    kinds = F.create_map(*(F.lit(x) for pair in spec.LANGUAGES.items() for x in pair))
    return F.element_at(kinds, F.nullif(suffix(path), F.lit("")))


def pct(c: Column) -> Column:
    """A share as whole per cent, halves to even."""
    return F.bround(c * 100, 0).cast("int")


def div(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)
