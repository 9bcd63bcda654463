"""Date expressions: day truncation, day/week differences, business-day lags, ISO week labels.

All of them are plain Catalyst expressions (codegen'd, no Python at run time).  Inputs may be DATE
or TIMESTAMP columns; day arithmetic always happens on the calendar date, as the report SQL does
(a day difference counts midnight crossings).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnLike = Column | str


def _c(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day(c: ColumnLike) -> Column:
    """Calendar date of a DATE/TIMESTAMP column (CONVERT(date, x))."""
    return _c(c).cast(T.DateType())


#: Month names as SQL Server's us_english knows them: the full name or its first three letters.
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Two-digit years up to this one belong to the 2000s.
_YEAR_CUTOFF = 49
_TIME = r"(?:[01]?[0-9]|2[0-3]):[0-5]?[0-9](?::[0-5]?[0-9](?:[.:][0-9]{1,9})?)?\s*(?:[ap]m)?|(?:0?[1-9]|1[0-2])\s*[ap]m"
_ZONE = r"(?:\s*(?:z|[+-](?:0[0-9]|1[0-4]):[0-5][0-9]))?"
#: pattern of the date part -> the groups that hold year, month, day ("" where the form has none: the first)
_FORMS: tuple[tuple[str, tuple[int, int, int]], ...] = (
    (r"([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})", (1, 2, 3)),
    (r"([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4}|[0-9]{2})", (3, 1, 2)),
    (r"([0-9]{4})([0-9]{2})([0-9]{2})", (1, 2, 3)),
    (r"([0-9]{2})([0-9]{2})([0-9]{2})", (1, 2, 3)),
    (r"([0-9]{4})", (1, 0, 0)),
    (r"([a-z]{3,9})\s*([0-9]{1,2})(?:\s*,\s*|\s+)([0-9]{4}|[0-9]{2})", (3, 1, 2)),
    (r"([0-9]{1,2})[\s-]*([a-z]{3,9})[\s,-]*([0-9]{4}|[0-9]{2})", (3, 2, 1)),
    (r"([0-9]{4})\s*([a-z]{3,9})\s*([0-9]{1,2})", (1, 2, 3)),
    (r"([0-9]{4})\s+([0-9]{1,2})\s*([a-z]{3,9})", (1, 3, 2)),
    (r"([a-z]{3,9})[\s,]*([0-9]{4})", (2, 1, 0)),
    (r"([0-9]{4})\s*([a-z]{3,9})", (1, 2, 0)),
)


def text_date(c: ColumnLike) -> Column:
    """The date a text spells, in any form SQL Server reads without a style under us_english (month before day).

    Numbers with ``-``, ``/`` or ``.`` between them, year first or last; eight or six digits, year first; a year
    alone; month names before or after the day; two-digit years from 1950 to 2049; each with or without a time of
    day.  One pattern of all forms chooses the form, so each text is read once and one way only.  Impossible dates and any other text
    give NULL, as do empty and blank texts."""
    text = F.lower(F.trim(_c(c).cast(T.StringType())))
    timed = text.contains(":") | text.endswith("m")
    dated = F.when(~timed, text).otherwise(F.regexp_replace(text, r"^(.*[0-9a-z])(?:\s+|(?<=[0-9])t)(?:" + _TIME + ")" + _ZONE + "$", "$1"))
    # the parts are read several times: as a lambda's argument they are computed once and stay a small plan
    parts = F.split(F.regexp_replace(dated, _ANY_FORM, _PARTS), "#")
    return F.element_at(F.transform(F.array(parts), _of_parts), 1)


def _any_form() -> tuple[str, str]:
    """One pattern of all forms, the first that fits, and what puts "year#month#day" in a text's place ("##" where none
    fits, "" for a part the form has not).  A line end after the date is read over, as "$" does."""
    forms, parts, groups = [], ([], [], []), 0
    for pattern, numbers in _FORMS:
        forms.append(pattern)
        for part, n in zip(parts, numbers, strict=True):
            if n:
                part.append(f"${groups + n}")
        groups += max(numbers)
    return rf"(?s)^(?:(?:{'|'.join(forms)})(?:\r\n|[\n\r\u0085\u2028\u2029])?|.*)\z", "#".join("".join(x) for x in parts)


_ANY_FORM, _PARTS = _any_form()


def _of_parts(parts: Column) -> Column:
    year, month, day_ = (F.element_at(parts, n) for n in (1, 2, 3))
    year = F.when(F.length(year) == 2, F.concat(F.when(year <= f"{_YEAR_CUTOFF:02d}", "20").otherwise("19"), year)).when(
        ~year.isin("", "0000"), year)
    names = F.create_map(*[F.lit(x) for n, m in enumerate(_MONTHS, 1) for k in dict.fromkeys((m, m[:3])) for x in (k, str(n))])
    month = F.when(month == "", "1").when(month < "a", month).otherwise(F.try_element_at(names, month))
    # no form, no such month or no such day: the cast gives NULL
    return F.concat(year, F.lit("-"), month, F.lit("-"), F.when(day_ == "", "1").otherwise(day_)).try_cast(T.DateType())


def try_date(c: ColumnLike, dtype: T.DataType | None = None) -> Column:
    """TRY_CONVERT(date, x): temporal values pass through, text is parsed (``text_date``), bad text gives NULL."""
    c = _c(c)
    if dtype is not None and not isinstance(dtype, T.StringType):
        return c.cast(T.DateType())
    return text_date(c)


def in_window(c: ColumnLike, start: date, end: date, closed: bool = False) -> Column:
    """``start <= c < end`` (or ``<= end`` when closed), with literal bounds.

    For TIMESTAMP columns the bounds are midnight timestamps, which is exactly
    ``CONVERT(date, c) >= start AND CONVERT(date, c) < end`` but keeps the raw column on the left
    so the predicate reaches the parquet scan.  (A closed end on a timestamp keeps T-SQL's meaning:
    a time of day on the end date falls outside.)
    """
    c, lo, hi = _c(c), F.lit(start), F.lit(end)
    return (c >= lo) & ((c <= hi) if closed else (c < hi))


def days_between(start: ColumnLike, end: ColumnLike) -> Column:
    """DATEDIFF(DAY, start, end): number of midnights crossed."""
    return F.datediff(day(end), day(start))


def _week_index(d: Column) -> Column:
    # 1970-01-01 is a Thursday; +4 moves Sunday to a multiple of 7, so the index increments on
    # every Saturday -> Sunday crossing.
    return F.floor((F.unix_date(d) + F.lit(4)) / F.lit(7))


def week_crossings(start: ColumnLike, end: ColumnLike) -> Column:
    """DATEDIFF(WEEK, start, end): Saturday->Sunday boundaries crossed (independent of DATEFIRST)."""
    return _week_index(day(end)) - _week_index(day(start))


def _is_dow(c: ColumnLike, *dows: int) -> Column:
    """dayofweek: 1 = Sunday ... 7 = Saturday."""
    return F.dayofweek(day(c)).isin(*dows)


def business_days_exclusive(start: ColumnLike, end: ColumnLike) -> Column:
    """Weekday lag that does not count the start day.

    days - 2 * week crossings - [start is Sat or Sun] - [end is Sat].  Same weekday gives 0; weekend
    starts can go negative (Sat->Sat -2, Sat->Sun -2, Sat->Mon -1, Sun->Sun -1), which reports flag
    as a data issue.  NULL when either side is NULL.
    """
    return (
        days_between(start, end)
        - week_crossings(start, end) * 2
        - F.when(_is_dow(start, 1, 7), 1).otherwise(0)
        - F.when(_is_dow(end, 7), 1).otherwise(0)
    ).cast(T.IntegerType())


def business_days_inclusive(start: ColumnLike, end: ColumnLike) -> Column:
    """Count of weekdays in [start, end] (both ends counted).

    days + 1 - 2 * week crossings - [start is Sun] - [end is Sat]; NULL when either side is NULL.
    """
    return (
        days_between(start, end) + 1
        - week_crossings(start, end) * 2
        - F.when(_is_dow(start, 1), 1).otherwise(0)
        - F.when(_is_dow(end, 7), 1).otherwise(0)
    ).cast(T.IntegerType())


def week_label(c: ColumnLike) -> tuple[Column, Column]:
    """(calendar year, ISO-8601 week).  The pair is kept as the reports define it even where the
    two disagree (2025-12-29 -> year 2025, ISO week 1)."""
    return F.year(day(c)), F.weekofyear(day(c))


def week_start(c: ColumnLike) -> Column:
    """Monday on or before the date (DATEADD(DAY, -(DATEDIFF(DAY, 0, d) % 7), d))."""
    return F.date_trunc("week", day(c)).cast(T.DateType())


def month_start(c: ColumnLike) -> Column:
    """First day of the month (DATEADD(MONTH, DATEDIFF(MONTH, 0, d), 0))."""
    return F.trunc(day(c), "month")


def year_start(c: ColumnLike) -> Column:
    """DATEFROMPARTS(YEAR(d), 1, 1)."""
    return F.trunc(day(c), "year")


def months_added(c: ColumnLike, n: int) -> Column:
    """DATEADD(MONTH, n, d): clamps to the last day of the target month."""
    return F.add_months(day(c), n)


def coalesce_in_window(first: ColumnLike, second: ColumnLike, start: date, end: date, closed: bool = False) -> Column:
    """``COALESCE(first, second)`` in the window, written so the scan can use it.

    ``(first in window) OR (first IS NULL AND second in window)`` is the same predicate, but made of
    plain column comparisons, which parquet pushdown (row-group min/max skipping) accepts; a
    comparison on the COALESCE expression itself is not pushed."""
    a, b = _c(first), _c(second)
    return in_window(a, start, end, closed) | (a.isNull() & in_window(b, start, end, closed))
