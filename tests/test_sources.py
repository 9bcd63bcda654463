import pytest

from uwlens.sources.catalog import SchemaError, check_schema


def test_schema_check_projects_and_validates(spark):
    df = spark.createDataFrame([(1, "A", "x", 1, 9)], "agency_id long, agency_code string, agency_name string, flg_active int, extra int")
    out = check_schema(df, "adm_co_agencies")
    assert out.columns == ["agency_id", "agency_code", "agency_name", "flg_active"]
    with pytest.raises(SchemaError):
        check_schema(df.drop("agency_name"), "adm_co_agencies")
    with pytest.raises(SchemaError):
        check_schema(spark.createDataFrame([("1", "A", "x", 1)], "agency_id string, agency_code string, agency_name string, flg_active int"),
                     "adm_co_agencies")


def test_display_names_cover_every_report_column(spark):
    from __spark_entry__ import fixture_params
    from uwlens.plans import REPORTS
    from uwlens.plans.display import DISPLAY_NAMES, with_display_names
    from uwlens.sources.fixtures import derive_tables

    t = derive_tables(spark, "/root/testdata/sf0.001")
    for name, fn in REPORTS.items():
        df = fn(t, fixture_params())
        assert [c for c, _ in DISPLAY_NAMES[name]] == df.columns, name
    out = with_display_names(REPORTS["rpt_agency_retention"](t, fixture_params()), "rpt_agency_retention")
    assert out.columns[-1] == "Renewal Retention %"


def test_cli_writes_partitioned_reports(spark, tmp_path):
    from uwlens.__main__ import main
    from uwlens.sources.fixtures import TABLE_NAMES, derive_tables

    t = derive_tables(spark, "/root/testdata/sf0.001")
    for n in TABLE_NAMES:
        getattr(t, n).write.parquet(str(tmp_path / "tables" / n))
    main(["--tables", str(tmp_path / "tables"), "--as-of", "2001-06-15", "--out", str(tmp_path / "out"),
          "--report", "rpt_agency_retention", "--cohorts", "1995", "2001", "--display-names"])
    back = spark.read.parquet(str(tmp_path / "out" / "rpt_agency_retention"))
    assert back.count() > 0 and "as_of" in back.columns and "Agency Code" in back.columns


def test_write_report_replaces_only_its_as_of_partition(spark, tmp_path):
    from datetime import date
    from uwlens.sources.sinks import write_report
    out = str(tmp_path / "rep")
    write_report(spark.createDataFrame([(1,), (2,)], "x int"), out, date(2024, 1, 1))
    write_report(spark.createDataFrame([(3,)], "x int"), out, date(2024, 2, 1))
    write_report(spark.createDataFrame([(9,)], "x int"), out, date(2024, 1, 1))   # re-run of January
    got = sorted((str(r.as_of), r.x) for r in spark.read.parquet(out).collect())
    assert got == [("2024-01-01", 9), ("2024-02-01", 3)]
