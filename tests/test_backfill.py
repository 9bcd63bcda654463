"""Many as-of dates in one run equal single runs, from as many scans as one run makes."""

from collections import Counter
from dataclasses import replace
from datetime import date, timedelta

import pytest

from uwlens.plans import REPORTS, kpi
from uwlens.plans.backfill import WEEKLY, weekly_backfill
from uwlens.sources.fixtures import derive_tables, materialize

SF = "/root/testdata/sf0.01"
#: neighbouring weeks, two dates of one week, a gap, a Sunday and a Monday
DATES = [date(2001, 6, 15), date(2001, 6, 8), date(2001, 6, 4), date(2001, 6, 10), date(2000, 2, 29), date(1999, 12, 31)]


def fixture_params():
    import __spark_entry__ as E
    return E.fixture_params()


@pytest.mark.parametrize("name", ["rpt_kpi1_submission_to_quote", "rpt_kpi4_policy_sent"])
def test_backfill_equals_single_runs(spark, name):
    t, p = derive_tables(spark, SF), fixture_params()
    got = Counter(tuple(r) for r in weekly_backfill(t, p, name, [*DATES, DATES[0]]).collect())
    want = Counter((a, *r) for a in DATES for r in REPORTS[name](t, replace(p, as_of=a)).collect())
    assert got == want and len({a for a, *_ in want}) == len(DATES)


def test_driver_date_columns_exist_and_dates_are_needed(spark):
    from uwlens.plans.display import DISPLAY_NAMES
    for name, (_, day) in WEEKLY.items():
        assert day in [c for c, _ in DISPLAY_NAMES[name]]
    with pytest.raises(ValueError):
        weekly_backfill(derive_tables(spark, SF), fixture_params(), "rpt_kpi2_binder", [])


def test_a_year_of_weeks_reads_tables_as_often_as_one_run(spark, tmp_path, capsys, monkeypatch):
    from uwlens.operators import asof, latest
    t, p = materialize(spark, "/root/testdata/sf0.001", str(tmp_path / "tables")), fixture_params()
    real = kpi.materialized

    def scans(run):
        parts = []

        def recorded(df):
            capsys.readouterr()
            df.explain("formatted")
            parts.append(capsys.readouterr().out)
            return real(df)

        with monkeypatch.context() as m:
            for module in (kpi, asof, latest):
                m.setattr(module, "materialized", recorded)
            m.setattr(kpi, "materialized_together", lambda *frames: [recorded(f) for f in frames])
            df = run()
            capsys.readouterr()
            df.explain("formatted")
            parts.append(capsys.readouterr().out)
        lines = [line for part in parts for line in part.splitlines() if line.startswith("Location") and "/tables/" in line]
        return Counter(line.rpartition("/tables/")[2] for line in lines), "\n".join(parts)

    year = [p.as_of - timedelta(weeks=n) for n in range(52)]
    single, _ = scans(lambda: REPORTS["rpt_kpi1_submission_to_quote"](t, p))
    many, plans = scans(lambda: weekly_backfill(t, p, "rpt_kpi1_submission_to_quote", year))
    assert many == single and "CartesianProduct" not in plans and "BroadcastNestedLoopJoin" not in plans
