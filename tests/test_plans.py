"""Plan properties the design relies on (checked on parquet copies of the sf0.001 and sf0.01 tables)."""

import re
import tempfile

import pytest

from uwlens.plans import REPORTS


@pytest.fixture(scope="module")
def parquet_tables(spark):
    from uwlens.sources.fixtures import materialize
    root = tempfile.mkdtemp(prefix="uwlens-plans-", dir="/tmp")
    return materialize(spark, "/root/testdata/sf0.001", root)


def _plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_no_cross_joins_and_no_python(spark, parquet_tables, capsys, name):
    from __spark_entry__ import fixture_params
    plan = _plan(REPORTS[name](parquet_tables, fixture_params()), capsys)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, (name, bad)


def test_scorecard_has_no_expand(spark, parquet_tables, capsys):
    from __spark_entry__ import fixture_params
    plan = _plan(REPORTS["rpt_agency_scorecard"](parquet_tables, fixture_params()), capsys)
    assert "Expand" not in plan


def test_window_bounds_reach_the_parquet_scan(spark, parquet_tables, capsys, monkeypatch):
    from __spark_entry__ import fixture_params
    from uwlens.plans import reports
    monkeypatch.setattr(reports, "materialized", lambda df: df)  # else the bounds are below a checkpoint
    plan = _plan(REPORTS["rpt_heatmap_detail"](parquet_tables, fixture_params()), capsys)
    scans = [line for line in plan.splitlines() if line.startswith("PushedFilters")]
    assert any("GreaterThanOrEqual(created_dt,2001-01-01)" in s and "LessThan(created_dt,2001-06-16)" in s for s in scans)
    plan = _plan(REPORTS["rpt_quotes_due"](parquet_tables, fixture_params()), capsys)
    assert "LessThanOrEqual(proposed_eff_date,2001-06-30)" in plan


@pytest.mark.parametrize("name,module", [("rpt_agency_scorecard", "scorecard"), ("rpt_quotes_due", "reports")])
def test_options_are_scanned_once(spark, parquet_tables, capsys, monkeypatch, name, module):
    """Over the materialised parts and the final plan together."""
    import importlib

    from __spark_entry__ import fixture_params
    owner, parts = importlib.import_module(f"uwlens.plans.{module}"), []
    real = owner.materialized

    def recorded(df):
        parts.append(_plan(df, capsys))
        return real(df)

    from uwlens.operators import latest
    monkeypatch.setattr(owner, "materialized", recorded)
    monkeypatch.setattr(latest, "materialized", recorded)
    parts.append(_plan(REPORTS[name](parquet_tables, fixture_params()), capsys))
    located = [line for plan in parts for line in plan.splitlines() if line.startswith("Location") and "bms_options_mst" in line]
    assert len(located) == 1


@pytest.mark.parametrize("name", [n for n in sorted(REPORTS) if n.startswith("rpt_kpi")])
def test_kpi_candidates_push_the_window_into_their_scans(spark, parquet_tables, capsys, monkeypatch, name):
    from __spark_entry__ import fixture_params
    from uwlens.plans import kpi
    parts, real = [], kpi.materialized

    def recorded(df):
        parts.append(_plan(df, capsys))
        return real(df)

    monkeypatch.setattr(kpi, "materialized", recorded)
    monkeypatch.setattr(kpi, "materialized_together", lambda *frames: [recorded(f) for f in frames])
    REPORTS[name](parquet_tables, fixture_params())
    pushed = [line for line in parts[0].splitlines() if line.startswith("PushedFilters")]
    assert any("GreaterThanOrEqual(created_dt" in line and "LessThan(created_dt" in line for line in pushed)


# ---- materialised key sets have true sizes, so large tables meet small ones without a shuffle ----------------

LARGE = ("dms_document_detail_mst", "bms_tracers", "bms_options_mst", "bms_quote_mst", "dms_file_mst")


@pytest.fixture(scope="module")
def wide_tables(spark):
    """Tables whose files are all larger than the broadcast threshold the tests set."""
    from uwlens.sources.fixtures import materialize
    return materialize(spark, "/root/testdata/sf0.01", tempfile.mkdtemp(prefix="uwlens-plans-", dir="/tmp"))


def _above_scans(plan: str, table: str) -> list[list[str]]:
    """For each scan of ``table``, the operators between it and the first join above."""
    lines = [line for line in plan.splitlines() if re.search(r"[+:]- |^\S", line)]
    depth = lambda line: len(re.match(r"[\s:+-]*", line)[0])
    out = []
    for i, line in enumerate(lines):
        if "FileScan" not in line or f"/{table}]" not in line:
            continue
        at, above = depth(line), []
        for up in reversed(lines[:i]):
            if depth(up) < at:
                at = depth(up)
                above.append(re.sub(r"^[\s:+-]*(\*\(\d+\) )?", "", up))
                if "Join" in above[-1]:
                    break
        out.append(above)
    return out


def _all_plans(spark, monkeypatch, capsys, name, tables) -> str:
    """The plans of a report's materialised parts and its own."""
    from __spark_entry__ import fixture_params
    from uwlens.operators import asof, latest, lineage
    from uwlens.plans import kpi
    parts, real = [], lineage.materialized

    def recorded(df):
        capsys.readouterr()
        df.explain()
        parts.append(capsys.readouterr().out)
        return real(df)

    for module in (kpi, latest, asof):
        monkeypatch.setattr(module, "materialized", recorded)
    monkeypatch.setattr(kpi, "materialized_together", lambda *frames: [recorded(f) for f in frames])
    capsys.readouterr()
    REPORTS[name](tables, fixture_params()).explain()
    return "\n".join([*parts, capsys.readouterr().out])


@pytest.mark.parametrize("name", [n for n in sorted(REPORTS) if n.startswith("rpt_kpi")])
def test_small_candidate_sets_leave_large_tables_unshuffled(spark, wide_tables, capsys, monkeypatch, name):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.maxMetadataStringLength")}
    try:
        spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60000")  # the tables' files have 100 kB and more
        small = _all_plans(spark, monkeypatch, capsys, name, wide_tables)
        joined = {t: [above for above in _above_scans(small, t) if above and "LeftSemi" in above[-1]] for t in LARGE}
        assert joined["dms_document_detail_mst"] and joined["bms_options_mst"]
        for t, paths in joined.items():
            for above in paths:
                assert "BroadcastHashJoin" in above[-1] and not any("Exchange" in x for x in above), (name, t, above)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a set beyond the bound: joined by shuffle
        large = _all_plans(spark, monkeypatch, capsys, name, wide_tables)
        assert not re.search(r"BroadcastHashJoin.*LeftSemi", large) and re.search(r"SortMergeJoin.*LeftSemi", large)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_materialised_frames_have_true_sizes_and_go_with_the_session(spark, wide_tables):
    from uwlens.operators.lineage import bytes_of, materialized
    big = wide_tables.bms_options_mst.join(wide_tables.bms_quote_mst.select("quote_id"), "quote_id")
    few = materialized(big.where("quote_id < 200").select("quote_id").distinct())
    assert few.count() == big.where("quote_id < 200").select("quote_id").distinct().count() > 0
    assert 0 < bytes_of(few) < 20_000 and all("uwlens-stage-" in f for f in few.inputFiles())
    assert few.columns == ["quote_id"] and bytes_of(materialized(few.where("quote_id is null"))) < 5_000


def test_scorecard_reads_quotes_once_and_stacks_its_measures(spark, parquet_tables, capsys, monkeypatch):
    from __spark_entry__ import fixture_params
    from uwlens.operators import latest
    from uwlens.plans import scorecard
    parts, real = [], latest.materialized

    def recorded(df):
        parts.append(_plan(df, capsys))
        return real(df)

    for module in (latest, scorecard):
        monkeypatch.setattr(module, "materialized", recorded)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        last = _plan(REPORTS["rpt_agency_scorecard"](parquet_tables, fixture_params()), capsys)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert last.count("Arguments: hashpartitioning") <= 6
    for table in ("bms_quote_mst", "bms_options_mst", "bms_quote_closed", "bms_submission_mst"):
        located = [line for plan in (*parts, last) for line in plan.splitlines() if line.startswith("Location") and table in line]
        assert len(located) == 1, (table, located)
