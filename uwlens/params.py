"""Report parameters and the date windows every report filters on.

Every window the reports use is a pair of *driver-side literals* computed from one explicit as-of
date, never a cross join to a one-row relation and never the wall clock inside a plan.  Literal
bounds keep runs repeatable and let Catalyst push the comparison into the parquet scan.
"""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date, timedelta


def _as_date(d: date | str) -> date:
    return d if isinstance(d, date) else date.fromisoformat(d)


def monday_of(d: date) -> date:
    """Monday on or before ``d`` (the week starts Monday)."""
    return d - timedelta(days=d.weekday())


def add_months(d: date, n: int) -> date:
    """Calendar month arithmetic that clamps to the last day of the target month."""
    m = d.month - 1 + n
    y, m = d.year + m // 12, m % 12 + 1
    return date(y, m, min(d.day, calendar.monthrange(y, m)[1]))


@dataclass(frozen=True)
class Window:
    """A date window; ``closed`` means the end bound is inclusive."""

    start: date
    end: date
    closed: bool = False


def last_two_full_weeks(as_of: date) -> Window:
    """[Monday of (as_of - 14 days), Monday of as_of): the two full Mon-Sun weeks before as_of's."""
    return Window(monday_of(as_of - timedelta(days=14)), monday_of(as_of))


def year_to_date(as_of: date) -> Window:
    """[January 1 of as_of's year, as_of + 1 day)."""
    return Window(date(as_of.year, 1, 1), as_of + timedelta(days=1))


def rolling_months(as_of: date, months: int = 3) -> Window:
    """[as_of - n months (clamped to month end), as_of + 1 day)."""
    return Window(add_months(as_of, -months), as_of + timedelta(days=1))


def prev_month_to_date(as_of: date) -> Window:
    """[first day of the previous month, as_of + 1 day)."""
    return Window(add_months(date(as_of.year, as_of.month, 1), -1), as_of + timedelta(days=1))


def closed_range(start: date | str, end: date | str) -> Window:
    return Window(_as_date(start), _as_date(end), closed=True)


def year_cohorts(first_year: int, last_year: int) -> Window:
    """[first_year-01-01, (last_year+1)-01-01)."""
    return Window(date(first_year, 1, 1), date(last_year + 1, 1, 1))


@dataclass(frozen=True)
class ReportParams:
    """Everything a report run depends on besides the tables.

    ``quarter_start``/``quarter_end`` is the closed proposed-effective window of the quotes-due
    report; when not given it is the calendar quarter containing ``as_of``.
    ``cohort_first_year``/``cohort_last_year`` bound the retention cohorts.  ``week_span`` stands for the
    two full weeks where a run covers those of several as-of dates (``plans.backfill``).
    """

    as_of: date
    quarter_start: date | None = None
    quarter_end: date | None = None
    cohort_first_year: int = 2020
    cohort_last_year: int = 2026
    week_span: Window | None = None

    def __post_init__(self) -> None:
        if (self.quarter_start is None) != (self.quarter_end is None):
            raise ValueError("quarter_start and quarter_end go together")
        if self.quarter_start and self.quarter_end and self.quarter_start > self.quarter_end:
            raise ValueError("quarter_start is after quarter_end")
        if self.cohort_first_year > self.cohort_last_year:
            raise ValueError("cohort_first_year is after cohort_last_year")

    @staticmethod
    def of(as_of: date | str, **kw) -> "ReportParams":
        kw = {k: (_as_date(v) if k.startswith("quarter_") and v is not None else v) for k, v in kw.items()}
        return ReportParams(as_of=_as_date(as_of), **kw)

    @property
    def weeks(self) -> Window:
        return self.week_span or last_two_full_weeks(self.as_of)

    @property
    def ytd(self) -> Window:
        return year_to_date(self.as_of)

    @property
    def rolling3(self) -> Window:
        return rolling_months(self.as_of, 3)

    @property
    def prev_month(self) -> Window:
        return prev_month_to_date(self.as_of)

    @property
    def quarter(self) -> Window:
        if self.quarter_start and self.quarter_end:
            return closed_range(self.quarter_start, self.quarter_end)
        q0 = (self.as_of.month - 1) // 3 * 3 + 1
        start = date(self.as_of.year, q0, 1)
        return closed_range(start, add_months(start, 3) - timedelta(days=1))

    @property
    def cohorts(self) -> Window:
        return year_cohorts(self.cohort_first_year, self.cohort_last_year)
