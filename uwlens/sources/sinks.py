"""Result-set sink: one flat table per report run, partitioned by the run's as-of date."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str, as_of: date, fmt: str = "parquet") -> None:
    """Append-or-replace the ``as_of`` partition of a report table.

    Dynamic partition overwrite replaces only this run's partition, so a re-run for the same
    as-of date is idempotent and earlier snapshots stay untouched.  Output is staged and moved when the job
    commits; on stores without an atomic rename a run that fails while it commits can leave part of the
    partition, and the next run replaces it.
    """
    (
        df.withColumn("as_of", F.lit(as_of))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("as_of")
        .format(fmt)
        .save(path)
    )
