"""The five KPIs for many as-of dates in one run.

A KPI's rows do not depend on the as-of date but through the window of its driver date: the two full weeks
before the as-of date's week.  A back-fill therefore runs the KPI once over the span of all windows, each table
read as often as in a single run, and then assigns every row to its as-of dates by arithmetic.  A driver date in
the week of Monday ``m`` lies in the windows of as-of dates in the weeks of ``m + 7`` and ``m + 14``; the dates
asked for are looked up by their Monday in a literal map.  No row meets the list of dates by a join.

A row comes once for each as-of date whose window holds it, at most twice as many as rows unless several dates of
one week are asked for.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates as D
from ..params import ReportParams, Window, monday_of
from ..sources.catalog import Tables
from .kpi import kpi1_submission_to_quote, kpi2_binder, kpi3_endorsement, kpi4_policy_sent, kpi5_renewal_lead

#: report -> (function, its column with the day of the driver date)
WEEKLY = {
    "rpt_kpi1_submission_to_quote": (kpi1_submission_to_quote, "quote_sent_dt"),
    "rpt_kpi2_binder": (kpi2_binder, "binder_sent_dt"),
    "rpt_kpi3_endorsement": (kpi3_endorsement, "endorsement_sent_dt"),
    "rpt_kpi4_policy_sent": (kpi4_policy_sent, "policy_sent_dt"),
    "rpt_kpi5_renewal_lead": (kpi5_renewal_lead, "renewal_quote_sent_dt"),
}


def weekly_backfill(t: Tables, p: ReportParams, report: str, as_ofs: Iterable[date]) -> DataFrame:
    """The rows of ``report`` for each of ``as_ofs``, with the date as the first column ``as_of``."""
    run, day = WEEKLY[report]
    by_monday: dict[date, list[date]] = defaultdict(list)
    for a in sorted(set(as_ofs)):
        by_monday[monday_of(a)].append(a)
    if not by_monday:
        raise ValueError("a back-fill needs as-of dates")
    windows = [replace(p, as_of=a[0]).weeks for a in by_monday.values()]
    span = Window(min(w.start for w in windows), max(w.end for w in windows))
    rows = run(t, replace(p, week_span=span))
    asked = F.create_map(*[x for m, a in by_monday.items() for x in (F.lit(m), F.array(*[F.lit(d) for d in a]))])
    own = D.week_start(day)
    none = F.array().cast(T.ArrayType(T.DateType()))
    dates = F.concat(*[F.coalesce(F.try_element_at(asked, F.date_add(own, n)), none) for n in (7, 14)])
    return rows.select(F.explode(dates).alias("as_of"), *rows.columns)
