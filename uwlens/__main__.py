"""Command line: run reports for one as-of date and publish them.

    python -m uwlens (--tables /data/extract | --snapshots /data/published | --catalog-db uw) --as-of 2026-05-01 --out /data/reports [--report NAME ...]
        [--quarter 2026-04-01 2026-06-30] [--cohorts 2020 2026] [--display-names]

Each report is written to ``<out>/<report>/as_of=<date>/`` (dynamic partition overwrite, so a
re-run replaces only that date).  On a cluster submit it with ``spark-submit -m uwlens``-style
packaging; ``spark.checkpoint.dir`` must name a shared folder there.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .params import ReportParams
from .plans import REPORTS
from .plans.display import with_display_names
from .session import configured
from .sources import load_catalog_tables, load_tables, write_report


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="uwlens")
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--tables", help="folder holding one parquet table per operational table")
    src.add_argument("--snapshots", help="folder under which the tables of the as-of date were published")
    src.add_argument("--catalog-db", help="catalog database holding the tables (e.g. saved bucketed)")
    ap.add_argument("--as-of", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--report", action="append", choices=sorted(REPORTS))
    ap.add_argument("--quarter", nargs=2, metavar=("START", "END"))
    ap.add_argument("--cohorts", nargs=2, type=int, metavar=("FIRST", "LAST"))
    ap.add_argument("--display-names", action="store_true")
    a = ap.parse_args(argv)
    kw = {}
    if a.quarter:
        kw.update(quarter_start=a.quarter[0], quarter_end=a.quarter[1])
    if a.cohorts:
        kw.update(cohort_first_year=a.cohorts[0], cohort_last_year=a.cohorts[1])
    params = ReportParams.of(a.as_of, **kw)
    spark = configured(SparkSession.builder.appName("uwlens")).getOrCreate()
    if a.catalog_db:
        tables = load_catalog_tables(spark, a.catalog_db)
    else:
        tables = load_tables(spark, a.snapshots or a.tables, as_of=params.as_of if a.snapshots else None)
    for name in a.report or sorted(REPORTS):
        df = REPORTS[name](tables, params)
        if a.display_names:
            df = with_display_names(df, name)
        write_report(df, f"{a.out}/{name}", params.as_of)


if __name__ == "__main__":
    main()
