"""Comparison without case and trailing blanks, settled when tables are stored.

The source compares text without regard to case or trailing blanks; Spark compares bytes.  ``normalized`` rewrites
the columns that reports compare with fixed texts: trailing blanks go, and wherever a fixed text, or a literal part
of a LIKE pattern, occurs in another case it is put into the spelling the reports use.  Every comparison of the
reports then gives what the source's would, without a change to a plan, and the filters stay plain comparisons of a
stored column: published (``publish_tables(..., ignore_case=True)``) or saved bucketed, they are pushed into the
Parquet scans.  Codes that tables are joined by lose trailing blanks on both sides.

The spelling that a report shows of such a column is the fixed one.  Other text of these columns stays as it was.
"""

from __future__ import annotations

import re
from dataclasses import fields
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from .catalog import Tables

#: (table, column) -> the texts and LIKE patterns that reports compare it with
COMPARED: dict[tuple[str, str], tuple[str, ...]] = {
    ("bms_tracers", "tracer_desc"): (V.TRACER_QUOTE_PREFIX, *V.TRACER_QUOTE_SENT, V.TRACER_ENDORSEMENT_ANY,
                                     *V.TRACER_ENDORSEMENT_START, *V.TRACER_ENDORSEMENT_FINALIZED),
    ("adm_bm_tracer_sub_types", "tracer_type_code"): (V.TRACER_SUBTYPE_QUOTE,),
    ("adm_bm_lkp_transaction_types", "lkp_desc"): (*V.TT_HEATMAP, V.TT_CANCEL_PREFIX, V.TT_NOTICE_PREFIX),
    ("adm_co_lkp_email_process_parameters", "lkp_code"): V.EMAIL_QUOTE_OR_RENEWAL,
    ("adm_bm_statuses", "status_code"): V.OPEN_QUOTE_STATUSES,
    ("adm_bm_statuses", "main_status_text"): (V.STATUS_NB_QUOTE_OFFERED_TEXT,),
    ("adm_co_agencies", "agency_code"): (*V.RETENTION_EXCLUDED_AGENCY_CODES, V.AGENCY_CODE_PREFIX, *(r[0] for r in V.AGENCY_ROLLUP)),
    ("dms_document_detail_mst", "document_name"): (),  # its patterns are compared in upper case already
    ("bms_submission_mst", "submission_code"): (),
    ("dms_file_mst", "submission_number"): (),
}


def literal_parts(patterns: tuple[str, ...]) -> list[str]:
    """The texts between the wildcards of the patterns, the short ones first (longer ones may hold them)."""
    parts = {part.strip() for p in patterns for part in p.split("%")} - {""}
    return sorted(parts, key=lambda x: (len(x), x))


def fixed_spelling(c: Column, patterns: tuple[str, ...]) -> Column:
    """``c`` without trailing blanks and with the patterns' literal parts in the patterns' case."""
    return reduce(lambda text, part: F.regexp_replace(text, f"(?i){re.escape(part)}", part), literal_parts(patterns), F.rtrim(c))


def normalized(tables: Tables) -> Tables:
    """The tables with every compared column in its fixed spelling."""
    out = {f.name: getattr(tables, f.name) for f in fields(Tables)}
    for (table, column), patterns in COMPARED.items():
        out[table] = out[table].withColumn(column, fixed_spelling(F.col(column), patterns))
    return Tables(**out)
