"""Benchmark the twelve reports.

Protocol: the operational tables are derived once from the raw test tables at ``$BENCH_SF_DIR``
(default /root/testdata/sf0.1) and written to a scratch folder under the checkpoint folder
(reported separately as ``fixture_build``), exactly as reports would read real extracts.  Each report then runs once as
warm-up and ``$BENCH_RUNS`` (default 3) timed times on ``local[$BENCH_CPUS]``; a run executes the
full plan into Spark's ``noop`` sink.  The median per report is recorded; ``value`` is the sum of
the medians.  By default the tables are saved in the co-located layout recommended for scale
(bucketed on their join keys, read through the catalog: ``uwlens.sources.layout``);
``BENCH_LAYOUT=parquet`` uses plain parquet folders instead.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from uwlens.operators.lineage import checkpoint_dir  # noqa: E402
from uwlens.params import ReportParams  # noqa: E402
from uwlens.plans import REPORTS  # noqa: E402
from uwlens.session import build_session  # noqa: E402
from uwlens.sources.fixtures import (FIXTURE_AS_OF, FIXTURE_COHORT_YEARS, FIXTURE_QUARTER,  # noqa: E402
                                     derive_tables, materialize)
from uwlens.sources.layout import load_catalog_tables, save_bucketed  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [a for a in sys.argv[1:] if a in REPORTS] or list(REPORTS)
    partitions = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(2 * cpus)))
    spark = build_session(f"local[{cpus}]", app="uwlens-bench", shuffle_partitions=partitions,
                          extra={"spark.driver.memory": "16g"})
    # derived tables go to the session's shared checkpoint folder (a scratch folder only locally)
    scratch = f"{checkpoint_dir(spark.range(1))}/bench-tables-{os.getpid()}"
    layout = os.environ.get("BENCH_LAYOUT", "bucketed")
    t0 = time.perf_counter()
    if layout == "bucketed":  # co-located layout read through the catalog (sources/layout.py)
        save_bucketed(derive_tables(spark, sf_dir), "uwlens_bench", scratch, int(os.environ.get("BENCH_BUCKETS", str(partitions))))
        tables = load_catalog_tables(spark, "uwlens_bench")
    else:
        tables = materialize(spark, sf_dir, scratch)
    fixture_s = time.perf_counter() - t0
    p = ReportParams.of(FIXTURE_AS_OF, quarter_start=FIXTURE_QUARTER[0], quarter_end=FIXTURE_QUARTER[1],
                        cohort_first_year=FIXTURE_COHORT_YEARS[0], cohort_last_year=FIXTURE_COHORT_YEARS[1])
    results: dict[str, float] = {}
    for name in only:
        times = []
        for i in range(runs + 1):
            s = time.perf_counter()
            REPORTS[name](tables, p).write.format("noop").mode("overwrite").save()
            if i:
                times.append(time.perf_counter() - s)
        results[name] = round(statistics.median(times), 3)
    print(json.dumps({
        "metric": "sum_of_median_report_seconds", "value": round(sum(results.values()), 3), "unit": "sec",
        "queries": results, "sf": Path(sf_dir).name.replace("sf", ""), "cpus": cpus, "runs": runs, "shuffle_partitions": partitions,
        "fixture_build_sec": round(fixture_s, 3), "layout": layout,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
