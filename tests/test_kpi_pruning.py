"""Cutting the tables to the window's candidate submissions must not change any KPI row."""

import pytest

from uwlens.params import ReportParams
from uwlens.plans import REPORTS, kpi
from uwlens.sources.fixtures import FIXTURE_AS_OF, derive_tables

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", [k for k in REPORTS if k.startswith("rpt_kpi")])
def test_pruned_equals_plain(spark, monkeypatch, name):
    t = derive_tables(spark, SF)
    pruned = REPORTS[name](t, ReportParams.of(FIXTURE_AS_OF)).collect()
    monkeypatch.setattr(kpi, "_scoped", lambda tables, *a, **k: tables)
    plain = REPORTS[name](t, ReportParams.of(FIXTURE_AS_OF)).collect()
    assert len(plain) > 0
    assert sorted(map(repr, plain)) == sorted(map(repr, pruned))
