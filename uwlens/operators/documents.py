"""Document and tracer facts: earliest (or latest) event per key, one pass per report.

A report that needs several document classes computes them all in *one* aggregation over the
document table (``min(when(class_i, created_dt))`` per class).  Documents are reduced per file
*before* they meet the file table, so the join that attaches a submission number sees one row per
file instead of one per document; both aggregations are partial (map-side), so a file or a
submission holding a large share of all documents does not concentrate work in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import live, not_purged


def _live_files(files: DataFrame) -> DataFrame:
    return files.where(live("flg_active", "purge_status")).select("file_id", "submission_number")


def first_documents(files: DataFrame, docs: DataFrame, classes: dict[str, Column]) -> DataFrame:
    """(submission_number, <class>...) = MIN(created_dt) of live documents of each class.

    ``classes`` maps an output name to a boolean expression over ``document_name``.
    """
    any_class = None
    for c in classes.values():
        any_class = c if any_class is None else (any_class | c)
    per_file = (
        docs.where(not_purged("purge_status") & any_class)
        .groupBy("file_id")
        .agg(*[F.min(F.when(c, F.col("created_dt"))).alias(n) for n, c in classes.items()])
    )
    return (
        per_file.join(_live_files(files), "file_id")
        .groupBy("submission_number")
        .agg(*[F.min(n).alias(n) for n in classes])
    )


def document_events(files: DataFrame, docs: DataFrame, cls: Column) -> DataFrame:
    """(submission_number, created_dt) of live documents of one class, de-duplicated per file
    before the file join (consumers take minima, so remaining duplicates across files of one
    submission are harmless; the as-of operator de-duplicates its own input)."""
    per_file = docs.where(not_purged("purge_status") & cls).select("file_id", "created_dt").distinct()
    return per_file.join(_live_files(files), "file_id").select("submission_number", "created_dt")


def tracer_extremes(tracers: DataFrame, prefilter: Column | None, mins: dict[str, Column] | None = None,
                    maxs: dict[str, Column] | None = None) -> DataFrame:
    """(quote_id, ...) MIN/MAX of ``created_dt`` over tracers of each class, one aggregation."""
    src = tracers if prefilter is None else tracers.where(prefilter)
    aggs = [F.min(F.when(c, F.col("created_dt"))).alias(n) for n, c in (mins or {}).items()]
    aggs += [F.max(F.when(c, F.col("created_dt"))).alias(n) for n, c in (maxs or {}).items()]
    return src.groupBy("quote_id").agg(*aggs)
