"""Per-operator queries: each exercises one operator family of the inventory over the whole derived
tables and is registered next to the reports in ``__spark_entry__`` (with an independent DuckDB
oracle in ``oracle_sql.py``).  The scorecard's intermediate steps are exposed the same way."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates as D
from ..functions import fixed_values as V
from ..functions import fmt as FMT
from ..functions import labels as L
from ..functions import money as M
from ..functions import text as X
from ..operators import filters as FL
from ..operators.asof import first_at_or_after
from ..operators.distinct import distinct_counts, distinct_flags, id_bitmaps, merge_on
from ..operators.documents import document_events, first_documents, tracer_extremes
from ..operators.existence import min_over_sources, semi_join_any
from ..operators.joins import keyed, split_join
from ..operators.latest import latest_option, preferred_quote
from ..operators.lineage import new_stage
from ..operators.ordering import with_position
from ..params import ReportParams
from ..sources.catalog import TABLE_NAMES, Tables, load_tables
from ..sources.snapshots import publish_tables
from . import scorecard as SC
from .backfill import weekly_backfill
from .common import (agencies, agency_scalar_lookup, live_quotes, live_submissions, quotes_with_type,
                     resolved_agency_id, sort_for_output, types_where, users)
from .reports import _email_keys, active_building_businesses, agency_code_number, agency_id_from_text

I = lambda c: F.col(c).cast(T.IntegerType())


def _b(c) -> F.Column:
    """Boolean as 0/1 (NULL stays NULL) for value comparison."""
    return c.cast(T.IntegerType())


# ---------------------------------------------------------------- scans, parameters, projection

def src_scan(t: Tables, p: ReportParams) -> DataFrame:
    """Row count of every operational table, published as a snapshot of the as-of date and loaded from it."""
    root = new_stage(t.bms_quote_mst)
    publish_tables(t, root, p.as_of)
    t = load_tables(t.bms_quote_mst.sparkSession, root, as_of=p.as_of)
    frames = [getattr(t, n).select(F.lit(n).alias("table_name")) for n in TABLE_NAMES]
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f)
    return u.groupBy("table_name").agg(F.count(F.lit(1)).alias("row_count"))


def param_windows(t: Tables, p: ReportParams) -> DataFrame:
    """All report windows for every distinct submission date taken as the as-of date."""
    d = t.bms_submission_mst.select(D.day("created_dt").alias("as_of")).distinct()
    return d.select(
        "as_of",
        D.week_start(F.date_sub("as_of", 14)).alias("weeks_start"), D.week_start("as_of").alias("weeks_end"),
        D.year_start("as_of").alias("ytd_start"), F.date_add("as_of", 1).alias("ytd_end"),
        D.months_added("as_of", -3).alias("rolling3_start"),
        D.months_added(D.month_start("as_of"), -1).alias("prev_month_start"))


def proj_alias_const(t: Tables, p: ReportParams) -> DataFrame:
    q = t.bms_quote_mst
    return q.select(F.col("quote_code").alias("quote_number"), F.lit(V.KPI1_TRANSACTION_LABEL).alias("transaction_type"),
                    F.col("policy_number"), (F.col("quote_id") * 10).alias("quote_id_x10"))


def kpi1_backfill(t: Tables, p: ReportParams) -> DataFrame:
    """KPI 1 for the 52 weekly as-of dates up to the parameter's, in one run."""
    return weekly_backfill(t, p, "rpt_kpi1_submission_to_quote", [p.as_of - timedelta(weeks=n) for n in range(52)])


# ---------------------------------------------------------------- filters

def flt_soft_delete_lenient(t: Tables, p: ReportParams) -> DataFrame:
    return live_submissions(t).where(F.col("user_id_accexecutive").isNotNull()).select(
        "submission_id", I("flg_active").alias("flg_active"), I("purge_status").alias("purge_status"))


def flt_soft_delete_strict(t: Tables, p: ReportParams) -> DataFrame:
    o = t.bms_options_mst
    return o.where(FL.active_strict("flg_active")).select("quote_id", "product_id", "business_id")


def flt_in_like_3vl(t: Tables, p: ReportParams) -> DataFrame:
    """Quotes kept by the heat-map type test, with the forecast test alongside (3-valued logic)."""
    q = quotes_with_type(t)
    return q.where(L.tt_heatmap("lkp_desc")).select("quote_id", "lkp_desc", _b(L.tt_forecast("lkp_desc")).alias("in_forecast"))


def flt_not_in_null(t: Tables, p: ReportParams) -> DataFrame:
    """Submissions whose agency code is not an excluded one (a NULL code is dropped, as NOT IN does)."""
    ag = agencies(t).select("agency_id", "agency_code")
    sb = t.bms_submission_mst.select("submission_id", "original_producer_id")
    df = sb.join(ag, sb.original_producer_id == ag.agency_id)
    return df.where(~F.col("agency_code").isin(*V.RETENTION_EXCLUDED_AGENCY_CODES)).select("submission_id", "agency_code")


def flt_doc_name_like(t: Tables, p: ReportParams) -> DataFrame:
    d = t.dms_document_detail_mst
    n = F.col("document_name")
    return d.select("file_id", "created_dt", "document_name",
                    _b(L.doc_is_quote_to_agent(n)).alias("is_quote_to_agent"),
                    _b(L.doc_is_quote_to_agent_prefix(n)).alias("is_quote_to_agent_prefix"),
                    _b(L.doc_is_bind_request(n)).alias("is_bind_request"),
                    _b(L.doc_is_binder_sent(n)).alias("is_binder_sent"),
                    _b(L.doc_is_endorsement_sent(n)).alias("is_endorsement_sent"),
                    _b(L.doc_is_policy_sent(n)).alias("is_policy_sent"),
                    _b(L.doc_is_renewal_invoice(n)).alias("is_renewal_invoice"))


def flt_halfopen_window(t: Tables, p: ReportParams) -> DataFrame:
    w = p.rolling3
    return t.bms_quote_mst.where(D.in_window("created_dt", w.start, w.end)).select("quote_id", "created_dt")


def flt_closed_window(t: Tables, p: ReportParams) -> DataFrame:
    w = p.quarter
    return t.bms_options_mst.where(D.in_window("proposed_eff_date", w.start, w.end, closed=True)).select(
        "quote_id", "product_id", "proposed_eff_date")


def flt_nonblank(t: Tables, p: ReportParams) -> DataFrame:
    return t.bms_quote_mst.where(FL.non_blank("policy_number")).select("quote_id", "policy_number")


def flt_premium_threshold(t: Tables, p: ReportParams) -> DataFrame:
    o = t.bms_options_mst
    prem = M.money_or_zero("sub_total_premium", o.schema["sub_total_premium"].dataType)
    return o.where(prem > V.PREMIUM_THRESHOLD).select("quote_id", "product_id", prem.alias("premium"))


def fn_parse_money(t: Tables, p: ReportParams) -> DataFrame:
    o = t.bms_options_mst
    txt = o.sub_total_premium.cast(T.StringType())
    return o.select("quote_id", "product_id",
                    M.parse_money(txt).alias("from_text"),
                    M.parse_money(F.concat(F.lit("$"), txt)).alias("from_dollar_text"),
                    M.parse_money("effective_dt").alias("from_date_text"))


# ---------------------------------------------------------------- joins and applies

def join_inner_dims(t: Tables, p: ReportParams) -> DataFrame:
    q = t.bms_quote_mst.select("quote_id", "submission_id")
    sb = t.bms_submission_mst.select("submission_id", "submission_code", "user_id_accexecutive")
    uw = users(t)
    df = q.join(sb, "submission_id").join(uw, sb.user_id_accexecutive == uw.user_id)
    return df.select("quote_id", "submission_code", X.person_name_short("first_name", "last_name").alias("underwriter"))


def join_left_lookup(t: Tables, p: ReportParams) -> DataFrame:
    q = t.bms_quote_mst
    tt = types_where(t)
    st = t.adm_bm_statuses
    df = q.join(tt, q.lkp_transaction_type_id == tt.lkp_id, "left").join(st, "status_id", "left")
    return df.select("quote_id", "lkp_desc", "status_code")


def join_left_filter_on(t: Tables, p: ReportParams) -> DataFrame:
    sb = t.bms_submission_mst
    ag = agencies(t, FL.active_lenient("flg_active")).select("agency_id", "agency_name")
    return sb.join(ag, sb.original_producer_id == ag.agency_id, "left").select("submission_id", "agency_name")


def join_left_to_inner(t: Tables, p: ReportParams) -> DataFrame:
    q = quotes_with_type(t, V.TT_NB_AND_RENEWAL)
    return q.select("quote_id", "lkp_desc")


def join_coalesce_key(t: Tables, p: ReportParams) -> DataFrame:
    q = t.bms_quote_mst.select("quote_id", "submission_id", F.col("original_producer_id").alias("q_producer"))
    sb = t.bms_submission_mst.select("submission_id", F.col("original_producer_id").alias("s_producer"))
    ag = agencies(t).select("agency_id", "agency_code")
    df = q.join(sb, "submission_id", "left").withColumn("agency_id", resolved_agency_id(F.col("q_producer"), F.col("s_producer")))
    return df.join(ag, "agency_id", "left").select("quote_id", "agency_id", "agency_code")


def semi_exists_joined(t: Tables, p: ReportParams) -> DataFrame:
    o = t.bms_options_mst.select("quote_id", "product_id", "business_id")
    return o.join(active_building_businesses(t), "business_id", "left_semi")


def apply_min_per_key(t: Tables, p: ReportParams) -> DataFrame:
    """Earliest document of five classes per submission in one aggregation, and the earliest
    quote tracer per quote."""
    n = F.col("document_name")
    return first_documents(t.dms_file_mst, t.dms_document_detail_mst, {
        "quote_doc_dt": L.doc_is_quote_to_agent(n), "bind_req_dt": L.doc_is_bind_request(n),
        "policy_doc_dt": L.doc_is_policy_sent(n), "agent_quote_doc_dt": L.doc_is_quote_to_agent_prefix(n),
        "renewal_invoice_dt": L.doc_is_renewal_invoice(n)})


def top1_latest_option(t: Tables, p: ReportParams) -> DataFrame:
    o = t.bms_options_mst
    s = o.schema
    o = (o.withColumn("eff_date", D.try_date("effective_dt", s["effective_dt"].dataType))
         .withColumn("prem", M.parse_money("sub_total_premium", s["sub_total_premium"].dataType))
         .withColumn("fees", (M.money_or_zero("total_fee_taxable", s["total_fee_taxable"].dataType)
                              + M.money_or_zero("total_fee_non_taxable", s["total_fee_non_taxable"].dataType)).cast(M.MONEY)))
    return latest_option(o, ["eff_date", "prem", "fees"])


def top1_per_group_bound_first(t: Tables, p: ReportParams) -> DataFrame:
    nb = quotes_with_type(t, (V.TT_NEW_BUSINESS,))
    return preferred_quote(nb, ["quote_id", "quote_code", "bind_dt"])


def asof_first_after(t: Tables, p: ReportParams) -> DataFrame:
    """Per quote with an endorsement request: first endorsement document of its submission at or
    after the request (many anchors per submission: the bucketed sweep)."""
    span = tracer_extremes(t.bms_tracers, L.tracer_is_endorsement("tracer_desc"),
                          maxs={"req_dt": L.tracer_is_endorsement_start("tracer_desc")})
    q = t.bms_quote_mst.select("quote_id", "submission_id")
    sb = t.bms_submission_mst.select("submission_id", "submission_code")
    anchors = span.join(q, "quote_id").join(sb, "submission_id").select("quote_id", "submission_code", "req_dt")
    endt = document_events(t.dms_file_mst, t.dms_document_detail_mst, L.doc_is_endorsement_sent("document_name"))
    endt = endt.withColumnRenamed("submission_number", "submission_code")
    return first_at_or_after(anchors, endt, "submission_code", "req_dt", "created_dt", "sent_dt")


def union_min_two_sources(t: Tables, p: ReportParams) -> DataFrame:
    cd, tm = _email_keys(t, (V.EMAIL_QUOTE,))
    return min_over_sources([cd, tm], ["business_id", "quote_id"], "created_dt", "sent_dt")


def semi_or_two_sources(t: Tables, p: ReportParams) -> DataFrame:
    o = t.bms_options_mst.select("quote_id", "business_id", "product_id")
    return semi_join_any(o, list(_email_keys(t, V.EMAIL_QUOTE_OR_RENEWAL)), ["business_id", "quote_id"])


def scalar_subq_agency(t: Tables, p: ReportParams) -> DataFrame:
    q = t.bms_quote_mst.select("quote_id", "submission_id", F.col("original_producer_id").alias("q_producer"))
    sb = t.bms_submission_mst.select("submission_id", F.col("original_producer_id").alias("s_producer"))
    df = q.join(sb, "submission_id", "left").withColumn("agency_id", resolved_agency_id(F.col("q_producer"), F.col("s_producer")))
    df = df.join(agency_scalar_lookup(t), "agency_id", "left")
    return df.select("quote_id", F.coalesce("agency_code", F.lit("")).alias("agency_code"),
                     F.coalesce("agency_name", F.lit("")).alias("agency_name"))


def join_fanout_kept(t: Tables, p: ReportParams) -> DataFrame:
    o = keyed(t.bms_options_mst.select("quote_id", "product_id"), ["quote_id"], "_option")
    ins = keyed(t.bms_quote_insured_mst.select("quote_id", "insured_name"), ["quote_id"], "_insured")
    df = split_join(o.frame, t.bms_quote_mst.select("quote_id"), ["quote_id"], "inner", left_hot=o)
    return split_join(df, ins.frame, ["quote_id"], "inner", left_hot=o, right_hot=ins).drop("_option", "_insured")


# ---------------------------------------------------------------- aggregations

def _sub_quotes(t: Tables) -> DataFrame:
    sb = t.bms_submission_mst.select("submission_id", F.col("original_producer_id").alias("agency_id"))
    return live_quotes(t).select("quote_id", "submission_id", "bind_dt", "lkp_transaction_type_id").join(sb, "submission_id")


def agg_group_sum_count(t: Tables, p: ReportParams) -> DataFrame:
    sb = t.bms_submission_mst
    return sb.groupBy(F.col("original_producer_id").alias("agency_id"), F.year("created_dt").alias("created_year")).agg(
        F.count(F.lit(1)).alias("n_submissions"),
        F.sum(F.when(FL.live("flg_active", "purge_status"), 1).otherwise(0)).cast(T.LongType()).alias("n_live"))


def agg_count_distinct(t: Tables, p: ReportParams) -> DataFrame:
    ids = {"n_submissions": "submission_id", "n_quotes": "quote_id"}
    return distinct_counts(id_bitmaps(_sub_quotes(t), ["agency_id"], ids), ["agency_id"], list(ids))


def agg_cond_count_distinct(t: Tables, p: ReportParams) -> DataFrame:
    df = _sub_quotes(t)
    bound = F.col("bind_dt").isNotNull()
    per_q = distinct_flags(df, ["agency_id"], "quote_id", {
        "quotes_bound": bound, "quotes_type0": F.col("lkp_transaction_type_id") == 0,
        "quotes_bound_type1": bound & (F.col("lkp_transaction_type_id") == 1)})
    per_s = distinct_flags(df, ["agency_id"], "submission_id", {"submissions_bound": bound})
    return merge_on(per_q, per_s, "agency_id")


def agg_cond_sum(t: Tables, p: ReportParams) -> DataFrame:
    o = t.bms_options_mst
    prem = M.money_or_zero("sub_total_premium", o.schema["sub_total_premium"].dataType)
    df = o.select("quote_id", prem.alias("prem")).join(_sub_quotes(t), "quote_id")
    bound = F.col("bind_dt").isNotNull()
    return df.groupBy("agency_id").agg(
        F.sum(F.when(bound, F.col("prem")).otherwise(F.lit(0).cast(M.MONEY))).alias("bound_premium"),
        F.sum(F.when(bound, 1).otherwise(0)).cast(T.LongType()).alias("bound_rows"))


def agg_pivot_max(t: Tables, p: ReportParams) -> DataFrame:
    return tracer_extremes(t.bms_tracers, L.tracer_is_endorsement("tracer_desc"), maxs={
        "req_dt": L.tracer_is_endorsement_start("tracer_desc"),
        "fin_dt": L.tracer_is_endorsement_finalized("tracer_desc")})


def sort_numeric_suffix(t: Tables, p: ReportParams) -> DataFrame:
    ag = agencies(t).select("agency_id", "agency_code")
    sb = t.bms_submission_mst.select("submission_id", "original_producer_id")
    df = sb.join(ag, sb.original_producer_id == ag.agency_id)
    df = df.select("submission_id", "agency_code", agency_code_number("agency_code").alias("code_number"))
    return with_position(sort_for_output(df, [F.col("code_number"), F.col("agency_code")], ["submission_id"]))


def union_distinct_spine(t: Tables, p: ReportParams) -> DataFrame:
    u = SC.submission_universe(t, p)
    c = SC.submissions_created(t, p)
    return u.select("agency_id").unionByName(c.select("agency_id")).distinct()


# ---------------------------------------------------------------- scalar functions

def fn_strings(t: Tables, p: ReportParams) -> DataFrame:
    i = t.bms_quote_insured_mst
    return i.select("quote_id", X.strip("adr_phy_city").alias("city_trim"), F.upper("insured_name").alias("insured_upper"),
                    F.substring("insured_name", 1, 5).alias("insured_left5"),
                    X.fixed_width("adr_phy_state_code", 4).alias("state_w4"))


def fn_person_name(t: Tables, p: ReportParams) -> DataFrame:
    o = t.bms_options_mst.select("quote_id", "product_id", "user_id_acc_executive")
    u = users(t)
    df = o.join(u, o.user_id_acc_executive == u.user_id)
    return df.select("quote_id", "product_id",
                     X.person_name_short("first_name", "last_name").alias("name_short"),
                     X.person_name_full3("first_name", "middle_name", "last_name").alias("name_full3"),
                     X.person_name_full3_trimlast("first_name", "middle_name", "last_name").alias("name_full3_trimlast"))


def fn_format(t: Tables, p: ReportParams) -> DataFrame:
    o = t.bms_options_mst
    prem = M.money_or_zero("sub_total_premium", o.schema["sub_total_premium"].dataType)
    return o.select("quote_id", "product_id", FMT.us_date("proposed_eff_date").alias("eff_us"),
                    FMT.us_date("effective_dt", o.schema["effective_dt"].dataType).alias("eff_text_us"),
                    M.money_text(prem).alias("premium_text"),
                    FMT.int_text(D.days_between(F.lit(p.as_of), "proposed_eff_date")).alias("days_until"))


def fn_dates(t: Tables, p: ReportParams) -> DataFrame:
    q = t.bms_quote_mst
    return q.select("quote_id", D.day("created_dt").alias("created_day"),
                    F.date_add(D.day("created_dt"), 3).alias("plus3"), F.date_sub(D.day("created_dt"), 14).alias("minus14"),
                    D.months_added("created_dt", -3).alias("minus3m"), D.month_start("created_dt").alias("month_start"),
                    D.days_between("created_dt", "bind_dt").alias("days_to_bind"),
                    F.year("created_dt").alias("created_year"))


#: name -> text form of a date that TRY_CONVERT(date, text) reads, as a Spark pattern
DATE_FORMS = {"compact": "yyyyMMdd", "slashes": "yyyy/MM/dd", "dots": "MM.dd.yyyy", "us_short": "M/d/yy", "six_digits": "yyMMdd",
              "month_first": "MMM d, yyyy", "day_first": "dd MMMM yyyy", "dashes": "d-MMM-yy", "year_first": "yyyy MMM d",
              "iso_time": "yyyy-MM-dd'T'HH:mm:ss", "us_time": "M-d-yyyy hh:mm a"}


def fn_try_cast(t: Tables, p: ReportParams) -> DataFrame:
    """Dates and numbers from text: as the table has them, and dates written in each further form and read again."""
    o = t.bms_options_mst
    eff = D.try_date("effective_dt", o.schema["effective_dt"].dataType)
    again = [D.try_date(F.date_format(F.col("created_dt") + F.expr("INTERVAL 14 HOURS 5 MINUTES"), f), T.StringType()).alias(n)
             for n, f in DATE_FORMS.items()]
    return o.select("quote_id", "product_id", eff.alias("eff_date"),
                    agency_id_from_text(F.col("business_id")).alias("business_int"),
                    agency_id_from_text(F.col("effective_dt")).alias("eff_as_int"), *again)


def fn_ratio(t: Tables, p: ReportParams) -> DataFrame:
    df = distinct_flags(_sub_quotes(t), ["agency_id"], "quote_id", {"quotes": F.lit(True), "bound": F.col("bind_dt").isNotNull()})
    return df.select("agency_id", "quotes", "bound", M.ratio4("bound", "quotes").alias("bind_ratio"),
                     M.ratio4(F.col("quotes") - F.col("bound"), "quotes").alias("open_ratio"))


def _quote_pairs(t: Tables) -> DataFrame:
    q = t.bms_quote_mst.select("quote_id", "submission_id", "created_dt", "quote_dt", "bind_dt")
    sb = t.bms_submission_mst.select("submission_id", F.col("created_dt").alias("sb_created_dt"))
    return q.join(sb, "submission_id")


def fn_business_days_inclusive(t: Tables, p: ReportParams) -> DataFrame:
    df = _quote_pairs(t).where(F.col("bind_dt").isNotNull())
    return df.select("quote_id", D.business_days_inclusive("created_dt", "bind_dt").alias("bd_inclusive"))


def fn_business_days_exclusive(t: Tables, p: ReportParams) -> DataFrame:
    df = _quote_pairs(t)
    return df.select("quote_id", D.business_days_exclusive("sb_created_dt", "bind_dt").alias("bd_exclusive"),
                     D.business_days_exclusive("sb_created_dt", "quote_dt").alias("bd_exclusive_quote"))


def fn_iso_week_label(t: Tables, p: ReportParams) -> DataFrame:
    y, w = D.week_label("created_dt")
    return t.bms_tracers.select("quote_id", "tracer_sub_type_id", "created_dt", y.alias("week_year"), w.alias("week_of_year")).distinct()


def fn_null(t: Tables, p: ReportParams) -> DataFrame:
    q = t.bms_quote_mst
    return q.select("quote_id", F.coalesce("quote_dt", "created_dt").alias("start_dt"),
                    F.coalesce(I("purge_status"), F.lit(0)).alias("purge_or_zero"),
                    F.nullif(F.trim("policy_number"), F.lit("")).alias("policy_or_null"),
                    F.coalesce("trans_finalize_dt", "bind_dt", "quote_dt", "created_dt").alias("latest_known"))


def fn_policy_status(t: Tables, p: ReportParams) -> DataFrame:
    return t.bms_quote_mst.select("quote_id", L.policy_status("bind_dt", "trans_finalize_dt").alias("policy_status"))


def fn_sla_band(t: Tables, p: ReportParams) -> DataFrame:
    df = _quote_pairs(t)
    lag = D.business_days_exclusive("sb_created_dt", "quote_dt")
    cal = D.days_between("created_dt", "bind_dt")
    return df.select("quote_id", L.sla_band_max(lag, V.KPI1_GREEN_MAX_BUSINESS_DAYS).alias("band_max3"),
                     L.sla_band_max(lag, V.KPI2_GREEN_MAX_BUSINESS_DAYS).alias("band_max5"),
                     L.sla_band_calendar(cal, V.KPI4_GREEN_MAX_CALENDAR_DAYS).alias("band_calendar30"),
                     L.sla_band_min(cal, V.KPI5_GREEN_MIN_LEAD_DAYS).alias("band_min45"))


def fn_follow_up(t: Tables, p: ReportParams) -> DataFrame:
    e = t.bms_email_confirmation_details
    d1, d2, d3 = V.FOLLOW_UP_DAYS
    return e.select("quote_id", "business_id", "created_dt", FMT.us_date("created_dt").alias("sent_us"),
                    FMT.us_date(F.date_add(D.day("created_dt"), d1)).alias("first_follow_up"),
                    FMT.us_date(F.date_add(D.day("created_dt"), d2)).alias("second_follow_up"),
                    FMT.us_date(F.date_add(D.day("created_dt"), d3)).alias("qcl_due")).distinct()


# ---------------------------------------------------------------- scorecard steps

def sc_submission_universe(t: Tables, p: ReportParams) -> DataFrame:
    return SC.submission_universe(t, p).select("submission_id", "agency_id")


def sc_submissions_created(t: Tables, p: ReportParams) -> DataFrame:
    return SC.submissions_created(t, p)


def sc_submissions_activity(t: Tables, p: ReportParams) -> DataFrame:
    return SC.submission_counts(SC.submission_universe(t, p)).select("agency_id", "submissions_activity")


def sc_quote_start(t: Tables, p: ReportParams) -> DataFrame:
    return SC.agency_measures(t, p).select("agency_id", *SC.QUOTE_START_MEASURES)


def sc_production(t: Tables, p: ReportParams) -> DataFrame:
    return SC.agency_measures(t, p).select("agency_id", *SC.PRODUCTION_MEASURES)


def sc_decline(t: Tables, p: ReportParams) -> DataFrame:
    return SC.agency_measures(t, p).where("declines > 0").select("agency_id", *SC.DECLINE_MEASURES)


def sc_agency_metrics(t: Tables, p: ReportParams) -> DataFrame:
    return SC.agency_metrics(t, p).drop("agency_id")


def sc_rollup(t: Tables, p: ReportParams) -> DataFrame:
    return SC.rolled_up(SC.agency_metrics(t, p)).select("agency_code", "agency_name", "submissions_created", "binds")


def sc_final(t: Tables, p: ReportParams) -> DataFrame:
    return SC.final_agg(SC.agency_metrics(t, p))


def sc_ratios(t: Tables, p: ReportParams) -> DataFrame:
    r = SC.agency_scorecard(t, p)
    return r.select("agency_code", "agency_name", "sub_to_quote_pct_vs_intake", "sub_to_quote_pct_vs_activity",
                    "quote_to_bind_pct", "decline_rate_pct", "carryover_pct", "dollar_hit_ratio_pct",
                    "avg_bound_premium_per_bind")


def sc_scores(t: Tables, p: ReportParams) -> DataFrame:
    r = SC.agency_scorecard(t, p)
    return r.select("agency_code", "agency_name", "mvs_overall", "mvs_momentum", "ops_efficiency_score",
                    "pipeline_health_score")


def sc_problem_type(t: Tables, p: ReportParams) -> DataFrame:
    r = SC.agency_scorecard(t, p)
    return r.select("agency_code", "agency_name", "problem_type_label", "problem_type_explanation",
                    "primary_recommended_action")


OPERATOR_QUERIES = {f.__name__: f for f in [
    src_scan, param_windows, proj_alias_const, kpi1_backfill,
    flt_soft_delete_lenient, flt_soft_delete_strict, flt_in_like_3vl, flt_not_in_null, flt_doc_name_like,
    flt_halfopen_window, flt_closed_window, flt_nonblank, flt_premium_threshold, fn_parse_money,
    join_inner_dims, join_left_lookup, join_left_filter_on, join_left_to_inner, join_coalesce_key,
    semi_exists_joined, apply_min_per_key, top1_latest_option, top1_per_group_bound_first, asof_first_after,
    union_min_two_sources, semi_or_two_sources, scalar_subq_agency, join_fanout_kept,
    agg_group_sum_count, agg_count_distinct, agg_cond_count_distinct, agg_cond_sum, agg_pivot_max,
    sort_numeric_suffix, union_distinct_spine,
    fn_strings, fn_person_name, fn_format, fn_dates, fn_try_cast, fn_ratio, fn_business_days_inclusive,
    fn_business_days_exclusive, fn_iso_week_label, fn_null, fn_policy_status, fn_sla_band, fn_follow_up,
    sc_submission_universe, sc_submissions_created, sc_submissions_activity, sc_quote_start, sc_production,
    sc_decline, sc_agency_metrics, sc_rollup, sc_final, sc_ratios, sc_scores, sc_problem_type,
]}


# ---------------------------------------------------------------- queries over the raw event table

def asof_first_after_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forward as-of operator on timestamps with times of day: for every signup event, the
    first purchase of the same user at or after it."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "event_type")
    signups = ev.where(F.col("event_type") == "signup").select("event_id", "user_id", "ts")
    buys = ev.where(F.col("event_type") == "purchase").select("user_id", F.col("ts").alias("buy_ts"))
    out = first_at_or_after(signups, buys, "user_id", "ts", "buy_ts", "first_purchase_ts")
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return out.select("event_id", "user_id", F.date_format("ts", fmt).alias("signup_ts"),
                      F.date_format("first_purchase_ts", fmt).alias("first_purchase_ts"))


RAW_QUERIES = {"asof_first_after_events": asof_first_after_events}
