"""Text expressions: SQL-style trimming, fixed-width conversion, person-name formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnLike = Column | str


def _c(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: ColumnLike) -> Column:
    """LTRIM(RTRIM(x)): removes leading/trailing blanks (spaces only, like the SQL functions)."""
    return F.trim(_c(c))


def fixed_width(c: ColumnLike, n: int) -> Column:
    """CONVERT(NVARCHAR(n), x): text form, silently cut to n characters."""
    return F.substring(_c(c).cast(T.StringType()), 1, n)


def strip_or_empty(c: ColumnLike) -> Column:
    """ISNULL(LTRIM(RTRIM(x)), '')."""
    return F.coalesce(strip(c), F.lit(""))


def person_name_short(first: ColumnLike, last: ColumnLike) -> Column:
    """"First Last": both trimmed, one blank only when the last name is non-blank.

    String ``+`` semantics: a NULL first or last name makes the whole name NULL.
    """
    last_t = strip(last)
    return F.concat(strip(first), F.when(last_t == "", F.lit("")).otherwise(F.concat(F.lit(" "), last_t)))


def _part(c: ColumnLike, width: int) -> Column:
    return strip(F.coalesce(fixed_width(c, width), F.lit("")))


def person_name_full3(first: ColumnLike, middle: ColumnLike, last: ColumnLike, width: int = 100) -> Column:
    """"First Middle Last" with NULL parts as '' and always two separators
    (double blank for a blank middle name, trailing blank for a blank last name)."""
    return F.concat(_part(first, width), F.lit(" "), _part(middle, width), F.lit(" "), _part(last, width))


def person_name_full3_trimlast(first: ColumnLike, middle: ColumnLike, last: ColumnLike,
                               width: int = 100) -> Column:
    """As :func:`person_name_full3` but no trailing blank when the last name is blank."""
    last_p = _part(last, width)
    return F.concat(_part(first, width), F.lit(" "), _part(middle, width),
                    F.when(last_p == "", F.lit("")).otherwise(F.concat(F.lit(" "), last_p)))
