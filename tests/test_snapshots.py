"""Snapshots: a reader sees a whole published set of files or none."""

from datetime import date

import pytest

from uwlens.sources import SnapshotError, load_tables, publish, publish_tables, snapshot
from uwlens.sources import snapshots as S

DAY = date(2024, 5, 1)


def frames(spark, n, tables=("a", "b")):
    return {t: spark.range(n).selectExpr("id", f"'{t}{n}' AS text").repartition(3) for t in tables}


def counts(spark, root):
    return {t: (df.count(), {r.text for r in df.select("text").distinct().collect()}) for t, df in snapshot(spark, root, DAY).items()}


def test_published_tables_come_back(spark, tmp_path):
    root = str(tmp_path / "snap")
    with pytest.raises(SnapshotError, match="no snapshot"):
        snapshot(spark, root, DAY)
    publish(frames(spark, 50), root, DAY)
    assert counts(spark, root) == {"a": (50, {"a50"}), "b": (50, {"b50"})}
    publish(frames(spark, 0), root, date(2024, 5, 2))
    assert all(df.count() == 0 for df in snapshot(spark, root, date(2024, 5, 2)).values())
    assert counts(spark, root)["a"][0] == 50  # another date's snapshot is its own


@pytest.mark.parametrize("dies_in", ["table", "manifest"])
def test_a_run_killed_while_it_publishes_changes_nothing(spark, tmp_path, monkeypatch, dies_in):
    root = str(tmp_path / "snap")
    publish(frames(spark, 20), root, DAY)
    before = snapshot(spark, root, DAY)

    def die(*a, **k):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        if dies_in == "manifest":  # all tables are written, the manifest is not
            m.setattr(S, "_write_text", die)
        else:  # the first table is written, the second is not
            m.setattr(S, "schema_hash", die)
        with pytest.raises(KeyboardInterrupt):
            publish(frames(spark, 99), root, DAY)
    assert counts(spark, root) == {"a": (20, {"a20"}), "b": (20, {"b20"})}
    publish(frames(spark, 7), root, DAY)  # a later run replaces the set as a whole
    assert counts(spark, root) == {"a": (7, {"a7"}), "b": (7, {"b7"})}
    assert before["a"].count() == 20  # who read the old manifest still has its files


def test_changed_or_lost_files_are_noticed(spark, tmp_path):
    root = tmp_path / "snap"
    manifest = publish(frames(spark, 30), str(root), DAY)
    entry = manifest["tables"]["b"]
    assert len(entry["files"]) >= 2 and all(size > 0 for size in entry["files"].values())
    folder = root / entry["folder"]
    (folder / "part-99999-late.parquet").write_bytes(b"not of the snapshot")  # a stray file is not read
    assert counts(spark, str(root))["b"] == (30, {"b30"})
    first = folder / sorted(entry["files"])[0]
    first.write_bytes(first.read_bytes() + b"x")
    with pytest.raises(SnapshotError, match="b: 1 of"):
        snapshot(spark, str(root), DAY)


def test_operational_tables_through_load_tables(spark, tmp_path):
    from uwlens.__main__ import main
    from uwlens.sources.fixtures import FIXTURE_AS_OF, derive_tables
    as_of, root = date.fromisoformat(FIXTURE_AS_OF), str(tmp_path / "snap")
    t = derive_tables(spark, "/root/testdata/sf0.001")
    publish_tables(t, root, as_of)
    back = load_tables(spark, root, as_of=as_of)
    assert back.bms_quote_mst.columns == t.bms_quote_mst.columns and back.bms_options_mst.count() == t.bms_options_mst.count()
    with pytest.raises(SnapshotError):
        load_tables(spark, root, as_of=date(2030, 1, 1))
    main(["--snapshots", root, "--as-of", FIXTURE_AS_OF, "--out", str(tmp_path / "out"), "--report", "rpt_submission_lookup"])
    assert spark.read.parquet(str(tmp_path / "out" / "rpt_submission_lookup")).count() > 0


def test_case_and_trailing_blanks_do_not_matter_when_the_parameter_is_on(spark, tmp_path, capsys):
    from dataclasses import replace

    from pyspark.sql import functions as F

    from __spark_entry__ import fixture_params
    from uwlens.functions import labels as L
    from uwlens.plans import REPORTS
    from uwlens.sources.fixtures import derive_tables
    from uwlens.sources.normalize import COMPARED
    t = derive_tables(spark, "/root/testdata/sf0.01")
    odd = {}
    for (table, column) in COMPARED:
        df = odd.get(table, getattr(t, table))
        c = F.col(column)
        by = F.pmod(F.xxhash64(*df.columns), F.lit(4))
        codes = column.startswith("submission")  # join keys differ in blanks only
        other = F.when(by == 0, c if codes else F.upper(c)).when(by == 1, F.concat(c, F.lit("  "))).when(by == 2, c if codes else F.lower(c))
        odd[table] = df.withColumn(column, other.otherwise(c))
    odd, root = replace(t, **odd), str(tmp_path / "odd")
    publish_tables(odd, root, DAY, ignore_case=True)
    back = load_tables(spark, root, as_of=DAY)
    sent = back.bms_tracers.where(L.tracer_is_quote_sent("tracer_desc"))
    assert sent.count() == t.bms_tracers.where(L.tracer_is_quote_sent("tracer_desc")).count() > 0
    assert odd.bms_tracers.where(L.tracer_is_quote_sent("tracer_desc")).count() < sent.count()
    capsys.readouterr()
    sent.explain("formatted")
    assert "PushedFilters: [In(tracer_desc, [Quote Sent,Renewal Quote Sent])]" in capsys.readouterr().out
    for name in ("rpt_kpi5_renewal_lead", "rpt_kpi3_endorsement", "rpt_agency_retention"):
        want = sorted(map(repr, REPORTS[name](t, fixture_params()).collect()))
        assert sorted(map(repr, REPORTS[name](back, fixture_params()).collect())) == want and want
