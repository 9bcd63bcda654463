"""The command line's windows and day counts do not follow the session's or cluster's default zone."""

import tempfile

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"  # the smallest tables whose report has rows


def test_zoned_timestamps_give_the_same_rows_in_any_default_zone(spark):
    from uwlens.__main__ import main
    from uwlens.sources.catalog import TABLE_NAMES
    from uwlens.sources.fixtures import FIXTURE_AS_OF, derive_tables

    root = tempfile.mkdtemp(prefix="uwlens-zone-", dir="/tmp")
    tables = derive_tables(spark, SF)
    for name in TABLE_NAMES:
        df = getattr(tables, name)
        if name == "bms_submission_mst":  # half past midnight UTC: still the day before in New York
            df = df.withColumn("created_dt", F.to_timestamp(F.col("created_dt").cast("date")) + F.expr("INTERVAL 30 MINUTES"))
        df.write.parquet(f"{root}/{name}")

    rows = {}
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            out = f"{root}/out-{zone.replace('/', '-')}"
            main(["--tables", root, "--as-of", str(FIXTURE_AS_OF), "--out", out, "--report", "rpt_kpi1_submission_to_quote"])
            rows[zone] = sorted(map(str, spark.read.parquet(f"{out}/rpt_kpi1_submission_to_quote").collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert rows["UTC"] and rows["UTC"] == rows["America/New_York"]
