from datetime import date

from uwlens.params import ReportParams, add_months, monday_of, prev_month_to_date, rolling_months


def test_monday_and_two_full_weeks():
    p = ReportParams.of("2001-06-15")  # a Friday
    assert p.weeks.start == date(2001, 5, 28) and p.weeks.end == date(2001, 6, 11)
    assert monday_of(date(2001, 6, 11)) == date(2001, 6, 11)
    assert monday_of(date(2001, 6, 17)) == date(2001, 6, 11)  # Sunday belongs to the week before


def test_month_arithmetic_clamps():
    assert add_months(date(2026, 5, 31), -3) == date(2026, 2, 28)
    assert add_months(date(2024, 5, 31), -3) == date(2024, 2, 29)
    assert rolling_months(date(2001, 6, 15)).start == date(2001, 3, 15)
    assert prev_month_to_date(date(2001, 1, 20)).start == date(2000, 12, 1)


def test_ytd_quarter_and_cohorts():
    p = ReportParams.of("2001-06-15", cohort_first_year=1995, cohort_last_year=2001)
    assert (p.ytd.start, p.ytd.end) == (date(2001, 1, 1), date(2001, 6, 16))
    assert (p.quarter.start, p.quarter.end, p.quarter.closed) == (date(2001, 4, 1), date(2001, 6, 30), True)
    assert (p.cohorts.start, p.cohorts.end) == (date(1995, 1, 1), date(2002, 1, 1))
    q = ReportParams.of("2026-05-02", quarter_start="2026-04-01", quarter_end="2026-06-30")
    assert q.quarter.end == date(2026, 6, 30)


def test_invalid_parameters_are_rejected():
    import pytest
    with pytest.raises(ValueError):
        ReportParams.of("2001-06-15", quarter_start="2001-06-30", quarter_end="2001-04-01")
    with pytest.raises(ValueError):
        ReportParams.of("2001-06-15", quarter_start="2001-04-01")
    with pytest.raises(ValueError):
        ReportParams.of("2001-06-15", cohort_first_year=2002, cohort_last_year=2001)
