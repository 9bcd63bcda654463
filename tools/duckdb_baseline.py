"""Single-node proxy baseline: DuckDB runs each report's oracle SQL over the same derived tables.

engine at the same scale", this materialises the 20 derived tables in an in-process DuckDB
database once, then times each report body (median of N runs, all threads).
Usage: python tools/duckdb_baseline.py [sf_dir] [runs]
"""

from __future__ import annotations

import json
import statistics
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import duckdb  # noqa: E402

import oracle_sql as O  # noqa: E402
from uwlens.sources.fixtures import FIXTURE_SQL  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    runs = int(sys.argv[2]) if len(sys.argv) > 2 else 3
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "part", "orders", "lineitem"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    t0 = time.perf_counter()
    for name, sql in FIXTURE_SQL.items():
        con.execute(f"CREATE TABLE {name} AS {sql}")
    build = time.perf_counter() - t0
    O._with = lambda tables, body: f"WITH {body}"  # tables exist already: keep only the report body
    out = {}
    for name, fn in O.REPORT_SQL.items():
        sql = fn()
        times = []
        for i in range(runs + 1):
            s = time.perf_counter()
            con.execute(sql).fetchall()
            if i:
                times.append(time.perf_counter() - s)
        out[name] = round(statistics.median(times), 3)
    print(json.dumps({"engine": f"duckdb {duckdb.__version__}", "sf": Path(sf).name, "value": round(sum(out.values()), 3),
                      "queries": out, "fixture_build_sec": round(build, 3)}))


if __name__ == "__main__":
    main()
