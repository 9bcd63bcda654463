"""Bucketed layout: same results, and per-quote work without a shuffle."""

import tempfile

import pytest

from uwlens.operators.latest import option_effective_date
from uwlens.plans import REPORTS
from uwlens.sources.fixtures import derive_tables
from uwlens.sources.layout import load_catalog_tables, save_bucketed


@pytest.fixture(scope="module")
def bucketed(spark):
    root = tempfile.mkdtemp(prefix="uwlens-bucketed-", dir="/tmp")
    save_bucketed(derive_tables(spark, "/root/testdata/sf0.01"), "uwlens_test_db", root, 4)
    return load_catalog_tables(spark, "uwlens_test_db")


def test_latest_option_on_bucketed_options_has_no_exchange(spark, bucketed, capsys):
    capsys.readouterr()
    option_effective_date(bucketed.bms_options_mst).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan, plan


@pytest.mark.parametrize("name", ["rpt_kpi3_endorsement", "rpt_agency_scorecard", "rpt_heatmap_detail"])
def test_bucketed_results_equal_plain(spark, bucketed, name):
    from __spark_entry__ import fixture_params
    plain = REPORTS[name](derive_tables(spark, "/root/testdata/sf0.01"), fixture_params()).collect()
    got = REPORTS[name](bucketed, fixture_params()).collect()
    assert sorted(map(repr, plain)) == sorted(map(repr, got)) and len(got) > 0


def test_cli_reads_catalog_tables(spark, bucketed, tmp_path):
    from uwlens.__main__ import main
    main(["--catalog-db", "uwlens_test_db", "--as-of", "2001-06-15", "--out", str(tmp_path / "out"),
          "--report", "rpt_quote_followup"])
    back = spark.read.parquet(str(tmp_path / "out" / "rpt_quote_followup"))
    assert back.count() > 0 and back.select("as_of").distinct().count() == 1
