"""Underwriting turnaround KPIs #1-#5 over the last two full Monday-Sunday weeks.

Every KPI has the same shape: a quote spine, a handful of per-key facts (latest option, earliest
document or tracer of some class), one driver date that must fall in the window, and a lag with a
green/red band.

Candidate pruning: the driver date is always one of the facts' event dates (a MIN or a COALESCE of
them), so a submission can only pass the window if at least one of its events lies in the window.
Each report first takes the keys of those events from window-filtered scans (predicates the parquet
reader can push down), then the *candidate* submissions with their quotes and files, and runs the exact
report logic on these rows - every per-key aggregate for a candidate still sees all of the key's rows,
so results are identical.  All of these sets are materialised: their true sizes are known, so documents,
tracers and options meet them as a broadcast right above the scan and are never shuffled whole; sets
beyond the broadcast threshold are joined by shuffle.  Each large table is read once for its events in
the window and once for its candidates' rows.  Facts are aggregated per key *before* they meet the spine;
the latest option is computed only for quotes that survived the window.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import fixed_values as V
from ..functions import labels as L
from ..functions import text as X
from ..operators.asof import first_at_or_after
from ..operators.documents import document_events, first_documents, tracer_extremes
from ..operators.latest import option_effective_date, preferred_quote
from ..operators.lineage import materialized, materialized_together
from ..params import ReportParams
from ..sources.catalog import Tables
from .common import live_submissions, quotes_with_type, sort_for_output, users

_Q_COLS = ["quote_id", "submission_id", "quote_code", "policy_number", "bind_dt", "trans_finalize_dt",
           "quote_dt", "created_dt"]


def _doc_files(t: Tables, cls, w) -> DataFrame:
    """Files with a document of class ``cls`` created in the window."""
    return t.dms_document_detail_mst.where(cls & D.in_window("created_dt", w.start, w.end)).select("file_id").distinct()


def _tracer_quotes(t: Tables, tracer_pred, w) -> DataFrame:
    """Quotes with a tracer matching ``tracer_pred`` created in the window."""
    return t.bms_tracers.where(tracer_pred & D.in_window("created_dt", w.start, w.end)).select("quote_id").distinct()


def _scoped(t: Tables, files: DataFrame | None = None, quotes: DataFrame | None = None, quote_pred=None) -> Tables:
    """``t`` restricted to the rows of candidate submissions (all of their rows, nothing else).

    Candidates have one of the ``files``, one of the ``quotes`` or a quote that satisfies ``quote_pred``."""
    given = {k: f for k, f in (("file", files), ("quote", quotes)) if f is not None}
    given = dict(zip(given, materialized_together(*given.values()), strict=True))
    by: list[tuple[str, DataFrame]] = []
    if "file" in given:
        codes = t.dms_file_mst.join(given["file"], "file_id", "left_semi")
        by.append(("submission_code", codes.select(F.col("submission_number").alias("submission_code"))))
    hit = []
    if quote_pred is not None:
        hit.append(t.bms_quote_mst.where(quote_pred).select("submission_id"))
    if "quote" in given:
        hit.append(t.bms_quote_mst.join(given["quote"], "quote_id", "left_semi").select("submission_id"))
    if hit:
        by.append(("submission_id", hit[0] if len(hit) == 1 else hit[0].unionByName(hit[1])))
    keys = materialized_together(*[k.distinct() for _, k in by])
    sb = t.bms_submission_mst
    if len(keys) == 1:
        sb = sb.join(keys[0], by[0][0], "left_semi")
    else:  # one pass over the submissions for both kinds of keys
        for (name, _), k in zip(by, keys, strict=True):
            sb = sb.join(k.withColumn(f"_by_{name}", F.lit(True)), name, "left")
        sb = sb.where(F.col("_by_submission_code").isNotNull() | F.col("_by_submission_id").isNotNull())
    sb = materialized(sb.select(*t.bms_submission_mst.columns))
    q, f = materialized_together(
        t.bms_quote_mst.join(sb.select("submission_id"), "submission_id", "left_semi"),
        t.dms_file_mst.join(sb.select(F.col("submission_code").alias("submission_number")), "submission_number", "left_semi"))
    return replace(
        t, bms_submission_mst=sb, bms_quote_mst=q, dms_file_mst=f,
        dms_document_detail_mst=t.dms_document_detail_mst.join(f.select("file_id"), "file_id", "left_semi"),
        bms_tracers=t.bms_tracers.join(q.select("quote_id"), "quote_id", "left_semi"),
        bms_options_mst=t.bms_options_mst.join(q.select("quote_id"), "quote_id", "left_semi"))


def _spine(t: Tables, descs: tuple[str, ...]) -> DataFrame:
    """Live quotes of the given types joined to their live submission (code, received date,
    account executive).  The underwriter join is added after the window filter."""
    q = quotes_with_type(t, descs).select(*_Q_COLS, "lkp_desc")
    sb = live_submissions(t).select(
        "submission_id", "submission_code", F.col("created_dt").alias("sb_created_dt"), "user_id_accexecutive")
    return q.join(sb, "submission_id")


def _finish(df: DataFrame, t: Tables) -> DataFrame:
    """Attach the underwriter (inner: unknown users drop the row) and the option effective date.

    ``df`` is already cut to the two-week window, so it is small: it is materialised once (both the join
    chain and the option pruning read it) and the latest-option aggregation only sees options of
    quotes that passed the window - a broadcast semi-join instead of a shuffle of every option."""
    uw = users(t).select("user_id", "first_name", "last_name")
    df = materialized(df.join(uw, df.user_id_accexecutive == uw.user_id))
    return (df.join(option_effective_date(t.bms_options_mst.join(df.select("quote_id"), "quote_id", "left_semi")),
                    "quote_id", "left")
            .withColumn("underwriter", X.person_name_short("first_name", "last_name")))


def _week_cols(ts: str) -> list:
    y, w = D.week_label(ts)
    return [y.alias("week_year"), w.alias("week_of_year")]


def kpi1_submission_to_quote(t: Tables, p: ReportParams) -> DataFrame:
    """Business days from submission received to first quote sent (New Business only)."""
    w = p.weeks
    # candidates: a quote document, or a 'Quote%' tracer (any sub-type: a superset), in the window
    t = _scoped(t, _doc_files(t, L.doc_is_quote_to_agent("document_name"), w),
                _tracer_quotes(t, L.tracer_is_quote("tracer_desc"), w))
    sb = live_submissions(t).select("submission_id", "submission_code",
                                    F.col("created_dt").alias("sb_created_dt"), "user_id_accexecutive")
    nb = quotes_with_type(t, (V.TT_NEW_BUSINESS,))
    pq = preferred_quote(nb, ["quote_id", "quote_code", "policy_number", "bind_dt", "trans_finalize_dt"])
    docs = first_documents(t.dms_file_mst, t.dms_document_detail_mst,
                           {"quote_doc_dt": L.doc_is_quote_to_agent("document_name")})
    sspns = (t.adm_bm_tracer_sub_types.where(F.col("tracer_type_code") == V.TRACER_SUBTYPE_QUOTE)
                  .select("tracer_sub_type_id"))
    trc = tracer_extremes(t.bms_tracers.join(sspns, "tracer_sub_type_id"), L.tracer_is_quote("tracer_desc"),
                          mins={"quote_tracer_dt": F.lit(True)})
    df = (sb.join(pq, "submission_id")
          .join(docs, sb.submission_code == docs.submission_number, "left")
          .join(trc, "quote_id", "left")
          .withColumn("sent", F.coalesce("quote_doc_dt", "quote_tracer_dt"))
          .where(F.col("sent").isNotNull() & D.in_window("sent", w.start, w.end)))
    df = _finish(df, t).withColumn("lag", D.business_days_exclusive("sb_created_dt", "sent"))
    out = sort_for_output(df, [F.col("underwriter"), D.day("sent"), F.col("eff_date"), D.day("sb_created_dt")],
                          ["quote_id"])
    return out.select(
        *_week_cols("sent"), "underwriter",
        F.lit(V.KPI1_TRANSACTION_LABEL).alias("transaction_type"),
        F.col("submission_code").alias("submission_number"), F.col("quote_code").alias("quote_number"),
        "policy_number", L.policy_status("bind_dt", "trans_finalize_dt").alias("policy_status"),
        F.col("eff_date").alias("policy_effective_dt"), D.day("sb_created_dt").alias("submission_received_dt"),
        D.day("sent").alias("quote_sent_dt"), F.col("lag").alias("kpi1_business_days"),
        L.sla_band_max("lag", V.KPI1_GREEN_MAX_BUSINESS_DAYS).alias("kpi1_status"))


def kpi2_binder(t: Tables, p: ReportParams) -> DataFrame:
    """Business days (inclusive) from binder request to the first binder sent at or after it."""
    w = p.weeks
    t = _scoped(t, _doc_files(t, L.doc_is_binder_sent("document_name"), w))
    req = first_documents(t.dms_file_mst, t.dms_document_detail_mst,
                          {"req_dt": L.doc_is_bind_request("document_name")})
    binders = document_events(t.dms_file_mst, t.dms_document_detail_mst, L.doc_is_binder_sent("document_name"))
    # One request date per submission, so every binder document meets exactly one anchor.
    sent = first_at_or_after(req, binders, "submission_number", "req_dt", "created_dt", "sent_dt",
                             unique_anchor=True)
    sent = sent.where(F.col("sent_dt").isNotNull() & D.in_window("sent_dt", w.start, w.end))
    # the sent date depends on the submission only: cut submissions to the window first, then
    # attach their quotes (the small side leads both joins)
    sb = live_submissions(t).select("submission_id", "submission_code", F.col("created_dt").alias("sb_created_dt"),
                                    "user_id_accexecutive")
    sb = sent.join(sb, sent.submission_number == sb.submission_code)
    q = quotes_with_type(t, V.TT_NB_AND_RENEWAL).select(*_Q_COLS, "lkp_desc")
    df = sb.join(q, "submission_id")
    df = _finish(df, t).withColumn("lag", D.business_days_inclusive("req_dt", "sent_dt"))
    status = (F.when(F.col("req_dt").isNull(), V.NO_BINDER_REQUEST)
              .when(F.col("sent_dt").isNull(), V.NO_BINDER_SENT)
              .otherwise(L.sla_band_max("lag", V.KPI2_GREEN_MAX_BUSINESS_DAYS)))
    out = sort_for_output(df, [F.col("underwriter"), D.day("sent_dt"), F.col("eff_date")], ["quote_id"])
    return out.select(
        *_week_cols("sent_dt"), "underwriter", F.col("lkp_desc").alias("transaction_type"),
        F.col("submission_code").alias("submission_number"), F.col("quote_code").alias("quote_number"),
        "policy_number", L.policy_status("bind_dt", "trans_finalize_dt").alias("policy_status"),
        F.col("eff_date").alias("policy_effective_dt"), F.col("req_dt").alias("binder_requested_dttime"),
        F.col("sent_dt").alias("binder_sent_dttime"), D.day("sent_dt").alias("binder_sent_dt"),
        F.col("lag").alias("kpi2_business_days"), status.alias("kpi2_status"))


def kpi3_endorsement(t: Tables, p: ReportParams) -> DataFrame:
    """Business days (inclusive) from the latest endorsement request to the endorsement sent:
    the first endorsement document at or after the request, else the latest finalized tracer."""
    w = p.weeks
    t = _scoped(t, _doc_files(t, L.doc_is_endorsement_sent("document_name"), w),
                _tracer_quotes(t, L.tracer_is_endorsement("tracer_desc")
                               & L.tracer_is_endorsement_finalized("tracer_desc"), w))
    span = tracer_extremes(t.bms_tracers, L.tracer_is_endorsement("tracer_desc"), maxs={
        "req_dt": L.tracer_is_endorsement_start("tracer_desc"),
        "fin_dt": L.tracer_is_endorsement_finalized("tracer_desc")})
    sp = _spine(t, V.TT_ENDORSEMENTS).join(span, "quote_id", "left")
    endt = document_events(t.dms_file_mst, t.dms_document_detail_mst, L.doc_is_endorsement_sent("document_name"))
    endt = endt.withColumnRenamed("submission_number", "submission_code")
    # Many quotes (anchors) per submission: the bucketed sweep, never docs x quotes pairs.
    df = first_at_or_after(sp, endt, "submission_code", "req_dt", "created_dt", "doc_sent_dt")
    df = (df.withColumn("sent", F.coalesce("doc_sent_dt", "fin_dt"))
          .where(F.col("sent").isNotNull() & D.in_window("sent", w.start, w.end)))
    df = _finish(df, t).withColumn(
        "lag", F.when(F.col("req_dt").isNotNull(), D.business_days_inclusive("req_dt", "sent")))
    status = (F.when(F.col("req_dt").isNull(), V.NO_ENDORSEMENT_REQUEST)
              .when(F.col("sent").isNull(), V.NO_ENDORSEMENT_SENT)
              .otherwise(L.sla_band_max("lag", V.KPI3_GREEN_MAX_BUSINESS_DAYS)))
    out = sort_for_output(df, [F.col("underwriter"), D.day("sent"), F.col("eff_date")], ["quote_id"])
    return out.select(
        *_week_cols("sent"), "underwriter", F.lit(V.KPI3_TRANSACTION_LABEL).alias("transaction_type"),
        F.col("quote_code").alias("quote_number"), "policy_number",
        L.policy_status("bind_dt", "trans_finalize_dt").alias("policy_status"),
        F.col("eff_date").alias("endorsement_effective_dt"), F.col("req_dt").alias("endorsement_requested_dttime"),
        F.col("sent").alias("endorsement_sent_dttime"), D.day("sent").alias("endorsement_sent_dt"),
        F.col("lag").alias("kpi3_business_days"), status.alias("kpi3_status"))


def kpi4_policy_sent(t: Tables, p: ReportParams) -> DataFrame:
    """Calendar days from policy effective date to policy sent (document, else finalize date)."""
    w = p.weeks
    t = _scoped(t, _doc_files(t, L.doc_is_policy_sent("document_name"), w),
                quote_pred=D.in_window("trans_finalize_dt", w.start, w.end))
    docs = first_documents(t.dms_file_mst, t.dms_document_detail_mst,
                           {"policy_doc_dt": L.doc_is_policy_sent("document_name")})
    sp = _spine(t, V.TT_NB_AND_RENEWAL)
    df = (sp.join(docs, sp.submission_code == docs.submission_number, "left")
          .withColumn("sent", F.coalesce("policy_doc_dt", "trans_finalize_dt"))
          .where(F.col("sent").isNotNull() & D.in_window("sent", w.start, w.end)))
    df = _finish(df, t).withColumn("days", D.days_between("eff_date", "sent"))
    out = sort_for_output(df, [F.col("underwriter"), D.day("sent"), F.col("eff_date")], ["quote_id"])
    return out.select(
        *_week_cols("sent"), "underwriter", F.col("lkp_desc").alias("transaction_type"),
        F.col("submission_code").alias("submission_number"), F.col("quote_code").alias("quote_number"),
        "policy_number", L.policy_status("bind_dt", "trans_finalize_dt").alias("policy_status"),
        F.col("eff_date").alias("policy_effective_dt"), D.day("sent").alias("policy_sent_dt"),
        F.col("days").alias("kpi4_calendar_days"),
        L.sla_band_calendar("days", V.KPI4_GREEN_MAX_CALENDAR_DAYS).alias("kpi4_status"))


def kpi5_renewal_lead(t: Tables, p: ReportParams) -> DataFrame:
    """Calendar days a renewal quote was sent before the renewal's effective date.

    Sent date priority: quote-to-agent document, renewal invoice document, quote-sent tracer,
    quote date, quote creation."""
    w = p.weeks
    t = _scoped(t, _doc_files(t, L.doc_is_quote_to_agent_prefix("document_name")
                              | L.doc_is_renewal_invoice("document_name"), w),
                _tracer_quotes(t, L.tracer_is_quote_sent("tracer_desc"), w),
                D.in_window("quote_dt", w.start, w.end) | D.in_window("created_dt", w.start, w.end))
    docs = first_documents(t.dms_file_mst, t.dms_document_detail_mst, {
        "agent_quote_doc_dt": L.doc_is_quote_to_agent_prefix("document_name"),
        "renewal_invoice_dt": L.doc_is_renewal_invoice("document_name")})
    trc = tracer_extremes(t.bms_tracers, L.tracer_is_quote_sent("tracer_desc"), mins={"quote_sent_trc_dt": F.lit(True)})
    sp = _spine(t, V.TT_RENEWALS)
    df = (sp.join(docs, sp.submission_code == docs.submission_number, "left")
          .join(trc, "quote_id", "left")
          .withColumn("sent", F.coalesce("agent_quote_doc_dt", "renewal_invoice_dt", "quote_sent_trc_dt", "quote_dt", "created_dt"))
          .where(F.col("sent").isNotNull() & D.in_window("sent", w.start, w.end)))
    df = _finish(df, t).withColumn(
        "lead", F.when(F.col("eff_date").isNotNull(), D.days_between("sent", "eff_date")))
    out = sort_for_output(df, [F.col("underwriter"), D.day("sent"), F.col("eff_date")], ["quote_id"])
    return out.select(
        *_week_cols("sent"), "underwriter", F.lit(V.KPI5_TRANSACTION_LABEL).alias("transaction_type"),
        F.col("submission_code").alias("submission_number"), F.col("quote_code").alias("quote_number"),
        "policy_number", L.policy_status("bind_dt", "trans_finalize_dt").alias("policy_status"),
        F.col("eff_date").alias("renewal_effective_dt"), D.day("sent").alias("renewal_quote_sent_dt"),
        D.day("trans_finalize_dt").alias("finalize_dt"), F.col("lead").alias("kpi5_days_before_eff"),
        L.sla_band_min("lead", V.KPI5_GREEN_MIN_LEAD_DAYS).alias("kpi5_status"))
