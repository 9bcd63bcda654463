"""Domain labels: policy status, SLA bands, document and tracer classes, transaction-type tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V

ColumnLike = Column | str


def _c(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def policy_status(bind_dt: ColumnLike, finalize_dt: ColumnLike) -> Column:
    b, f = _c(bind_dt), _c(finalize_dt)
    return (
        F.when(b.isNull(), V.POLICY_NOT_BOUND)
        .when(b.isNotNull() & f.isNull(), V.POLICY_BOUND_NOT_FINALIZED)
        .when(b.isNotNull() & f.isNotNull(), V.POLICY_FINALIZED)
        .otherwise(V.POLICY_UNKNOWN)
    )


def sla_band_max(lag: ColumnLike, green_max: int) -> Column:
    """NULL -> NULL, < 0 -> Data Issue, <= green_max -> Green, else Red."""
    x = _c(lag)
    return (F.when(x.isNull(), F.lit(None).cast("string")).when(x < 0, V.BAND_DATA_ISSUE)
            .when(x <= green_max, V.BAND_GREEN).otherwise(V.BAND_RED))


def sla_band_calendar(lag: ColumnLike, green_max: int) -> Column:
    """As :func:`sla_band_max` without the NULL branch: an unknown lag is Red."""
    x = _c(lag)
    return F.when(x < 0, V.BAND_DATA_ISSUE).when(x <= green_max, V.BAND_GREEN).otherwise(V.BAND_RED)


def sla_band_min(lead: ColumnLike, green_min: int) -> Column:
    """NULL -> NULL, < 0 -> Data Issue, >= green_min -> Green, else Red."""
    x = _c(lead)
    return (F.when(x.isNull(), F.lit(None).cast("string")).when(x < 0, V.BAND_DATA_ISSUE)
            .when(x >= green_min, V.BAND_GREEN).otherwise(V.BAND_RED))


def like_any(c: ColumnLike, patterns) -> Column:
    c = _c(c)
    return reduce(lambda a, b: a | b, [c.like(p) for p in patterns])


def like_all(c: ColumnLike, patterns) -> Column:
    c = _c(c)
    return reduce(lambda a, b: a & b, [c.like(p) for p in patterns])


# --- document classes (each a boolean column over ``document_name``) ---------------------------

def _up(name: ColumnLike) -> Column:
    return F.upper(_c(name))


def _up_trim(name: ColumnLike) -> Column:
    return F.upper(F.trim(_c(name)))


def doc_is_quote_to_agent(name: ColumnLike) -> Column:
    """KPI 1: trimmed, upper-cased name *contains* QUOTE TO AG."""
    return like_any(_up_trim(name), V.DOC_QUOTE_TO_AGENT_CONTAINS)


def doc_is_quote_to_agent_prefix(name: ColumnLike) -> Column:
    """KPI 5: trimmed, upper-cased name *starts with* QUOTE TO AG."""
    return like_any(_up_trim(name), V.DOC_QUOTE_TO_AGENT_PREFIX)


def doc_is_renewal_invoice(name: ColumnLike) -> Column:
    return _up_trim(name).like(V.DOC_RENEWAL_INVOICE_PREFIX)


def doc_is_bind_request(name: ColumnLike) -> Column:
    return like_any(_up(name), V.DOC_BIND_REQUEST)


def doc_is_binder_sent(name: ColumnLike) -> Column:
    """Untrimmed prefix test: a leading blank defeats it, as in the report definition."""
    return like_any(_up(name), V.DOC_BINDER_SENT)


def doc_is_endorsement_sent(name: ColumnLike) -> Column:
    return like_all(_up(name), V.DOC_ENDORSEMENT_SENT_ALL)


def doc_is_policy_sent(name: ColumnLike) -> Column:
    return like_all(_up(name), V.DOC_POLICY_SENT_ALL)


# --- tracer classes over ``tracer_desc`` ---------------------------------------------------------

def tracer_is_quote(desc: ColumnLike) -> Column:
    return _c(desc).like(V.TRACER_QUOTE_PREFIX)


def tracer_is_quote_sent(desc: ColumnLike) -> Column:
    return _c(desc).isin(*V.TRACER_QUOTE_SENT)


def tracer_is_endorsement(desc: ColumnLike) -> Column:
    return _c(desc).like(V.TRACER_ENDORSEMENT_ANY)


def tracer_is_endorsement_start(desc: ColumnLike) -> Column:
    return like_any(desc, V.TRACER_ENDORSEMENT_START)


def tracer_is_endorsement_finalized(desc: ColumnLike) -> Column:
    return like_any(desc, V.TRACER_ENDORSEMENT_FINALIZED)


# --- transaction-type tests over ``lkp_desc`` -----------------------------------------------------

def tt_heatmap(desc: ColumnLike) -> Column:
    """In the heat-map list or a Cancel* type, and not a Notice of Cancellation*."""
    d = _c(desc)
    return (d.isin(*V.TT_HEATMAP) | d.like(V.TT_CANCEL_PREFIX)) & (d.isNull() | ~d.like(V.TT_NOTICE_PREFIX))


def tt_forecast(desc: ColumnLike) -> Column:
    """Unknown type, or neither an endorsement nor any cancellation."""
    d = _c(desc)
    return d.isNull() | (~d.isin(*V.TT_FORECAST_EXCLUDED) & ~d.like(V.TT_CANCEL_PREFIX))
