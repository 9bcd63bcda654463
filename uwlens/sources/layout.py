"""Co-located storage layout: the large tables bucketed on the keys the reports join and group on.

At scale the dominant work is per-quote (latest option, tracer extremes, closures, insured rows)
and per-file (documents).  Written with ``bucketBy`` on those keys and read back through the
catalog, Spark plans the per-key aggregations and the quote <-> option / tracer / insured joins
without a shuffle (both sides share the hash partitioning), and sorts within buckets make the
sort-merge joins streaming.  Code tables are saved unbucketed (they are broadcast).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .catalog import TABLE_NAMES, Tables
from .normalize import normalized

# table -> bucket columns (all quote-grained tables share quote_id, document tables file_id)
BUCKETING: dict[str, tuple[str, ...]] = {
    "bms_submission_mst": ("submission_id",),
    "bms_quote_mst": ("quote_id",),
    "bms_options_mst": ("quote_id",),
    "bms_quote_insured_mst": ("quote_id",),
    "bms_tracers": ("quote_id",),
    "bms_quote_closed": ("quote_id",),
    "bms_email_confirmation_details": ("quote_id",),
    "bms_template_memos": ("quote_id",),
    "dms_file_mst": ("file_id",),
    "dms_document_detail_mst": ("file_id",),
}


def save_bucketed(tables: Tables, database: str, root: str, num_buckets: int, ignore_case: bool = False) -> None:
    """Save every table as an external catalog table under ``root`` (large ones bucketed).

    ``num_buckets`` should put a few hundred MB in a bucket file at the target size and be the
    same for every bucketed table, so joins between them need no shuffle.  ``ignore_case`` stores compared
    texts in the reports' spelling (``normalize``)."""
    if ignore_case:
        tables = normalized(tables)
    spark = tables.bms_quote_mst.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{root}'")
    for name in TABLE_NAMES:
        keys = BUCKETING.get(name)
        df = getattr(tables, name)
        if keys:  # dealt by bucket first: one writing task, and so one sorted file, per bucket
            df = df.repartition(num_buckets, *keys)
        w = df.write.mode("overwrite").format("parquet").option("path", f"{root}/{name}")
        if keys:
            w = w.bucketBy(num_buckets, *keys).sortBy(*keys)
        w.saveAsTable(f"{database}.{name}")


def load_catalog_tables(spark: SparkSession, database: str) -> Tables:
    """The operational tables from catalog ``database`` (bucketing metadata included)."""
    return Tables(**{n: spark.table(f"{database}.{n}") for n in TABLE_NAMES})
