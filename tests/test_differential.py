"""Every registered query against its DuckDB oracle on the smallest test tables."""

import math
from pathlib import Path

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def _norm(v):
    if v is None:
        return "\0"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def _names():
    import __spark_entry__ as E
    return sorted(E.oracle_sql())


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    sdf = E.queries()[name](spark, SF)
    res = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(ocols)
    assert _rows([tuple(r) for r in sdf.collect()], sdf.columns) == _rows(res.fetchall(), ocols)


def test_every_report_and_inventory_query_has_an_oracle():
    """Of the training-data queries only those that SQL can express have one; the others have tests of their own."""
    import __spark_entry__ as E
    mine = {n for n in E.queries() if n != "pipeline" and not n.startswith("op")}
    assert mine <= set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert len(df.collect()) > 0 and "mvs_overall" in df.columns
