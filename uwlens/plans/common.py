"""Building blocks shared by several reports: live rows, lookups, agency resolution, sorting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import filters as FL
from ..operators.lookup import first_row_per_key
from ..sources.catalog import Tables


def live_submissions(t: Tables) -> DataFrame:
    s = t.bms_submission_mst
    return s.where(FL.live(s.flg_active, s.purge_status))


def live_quotes(t: Tables) -> DataFrame:
    q = t.bms_quote_mst
    return q.where(FL.live(q.flg_active, q.purge_status))


def types_where(t: Tables, pred: Column | None = None) -> DataFrame:
    tt = t.adm_bm_lkp_transaction_types
    return tt if pred is None else tt.where(pred)


def users(t: Tables) -> DataFrame:
    return t.adm_co_users


def agencies(t: Tables, pred: Column | None = None) -> DataFrame:
    ag = t.adm_co_agencies
    return ag if pred is None else ag.where(pred)


def quotes_with_type(t: Tables, descs: tuple[str, ...] | None = None) -> DataFrame:
    """Live quotes with their transaction type text ``lkp_desc``.

    With ``descs`` the type must be one of them (the left join to the type table is inner in effect
    because the report filters on its column); without, unknown types keep a NULL ``lkp_desc``.
    """
    q = live_quotes(t)
    if descs is None:
        tt = types_where(t).select(F.col("lkp_id"), "lkp_desc")
        return q.join(tt, q.lkp_transaction_type_id == tt.lkp_id, "left").drop("lkp_id")
    tt = types_where(t, F.col("lkp_desc").isin(*descs)).select("lkp_id", "lkp_desc")
    return q.join(tt, q.lkp_transaction_type_id == tt.lkp_id, "inner").drop("lkp_id")


def resolved_agency_id(quote_producer: Column, submission_producer: Column) -> Column:
    """COALESCE(quote producer, submission producer)."""
    return F.coalesce(quote_producer, submission_producer)


def agency_scalar_lookup(t: Tables) -> DataFrame:
    """(agency_id, agency_code, agency_name) with one row per id, values trimmed: the scalar
    ``SELECT TOP 1 LTRIM(RTRIM(col)) FROM agencies WHERE agency_id = x`` lookups."""
    ag = t.adm_co_agencies.select("agency_id", F.trim("agency_code").alias("agency_code"),
                                  F.trim("agency_name").alias("agency_name"))
    return first_row_per_key(ag, "agency_id", ["agency_code", "agency_name"])


def sort_for_output(df: DataFrame, keys: list[Column], tiebreak: list[str]) -> DataFrame:
    """Report order plus unique tie-break columns.

    The tie-break makes the output order deterministic and lets the range partitioner of the
    global sort split rows that share the leading keys (one hot key would otherwise land in one
    sort partition)."""
    return df.orderBy(*keys, *[F.col(c).asc() for c in tiebreak])
