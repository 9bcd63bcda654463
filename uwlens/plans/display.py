"""Display column names of each report (the names the BI feeds and automations consume).

Reports compute snake_case columns; ``with_display_names`` renames them for publishing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- FIXED VALUES: display names per report, in output order (snake_case -> display name) -----
_KPI_HEAD = [("week_year", "Week Year"), ("week_of_year", "Week Of Year"), ("underwriter", "Underwriter"),
             ("transaction_type", "Transaction Type")]

DISPLAY_NAMES: dict[str, list[tuple[str, str]]] = {
    "rpt_kpi1_submission_to_quote": _KPI_HEAD + [
        ("submission_number", "Submission Number"), ("quote_number", "Quote Number"), ("policy_number", "Policy Number"),
        ("policy_status", "Policy Status"), ("policy_effective_dt", "Policy Effective Dt"),
        ("submission_received_dt", "Submission Received Dt"), ("quote_sent_dt", "Quote Sent Dt"),
        ("kpi1_business_days", "KPI1 Business Days Submission→Quote"), ("kpi1_status", "KPI1 Status")],
    "rpt_kpi2_binder": _KPI_HEAD + [
        ("submission_number", "Submission Number"), ("quote_number", "Quote Number"), ("policy_number", "Policy Number"),
        ("policy_status", "Policy Status"), ("policy_effective_dt", "Policy Effective Dt"),
        ("binder_requested_dttime", "Binder Requested DtTime"), ("binder_sent_dttime", "Binder Sent DtTime"),
        ("binder_sent_dt", "Binder Sent Dt"), ("kpi2_business_days", "KPI2 Business Days Request→BinderSent"),
        ("kpi2_status", "KPI2 Status")],
    "rpt_kpi3_endorsement": _KPI_HEAD + [
        ("quote_number", "Quote Number"), ("policy_number", "Policy Number"), ("policy_status", "Policy Status"),
        ("endorsement_effective_dt", "Endorsement Effective Dt"),
        ("endorsement_requested_dttime", "Endorsement Requested DtTime"),
        ("endorsement_sent_dttime", "Endorsement Sent DtTime"), ("endorsement_sent_dt", "Endorsement Sent Dt"),
        ("kpi3_business_days", "KPI3 Business Days Request→Sent"), ("kpi3_status", "KPI3 Status")],
    "rpt_kpi4_policy_sent": _KPI_HEAD + [
        ("submission_number", "Submission Number"), ("quote_number", "Quote Number"), ("policy_number", "Policy Number"),
        ("policy_status", "Policy Status"), ("policy_effective_dt", "Policy Effective Dt"),
        ("policy_sent_dt", "Policy Sent Dt"), ("kpi4_calendar_days", "KPI4 Calendar Days Eff→PolicySent"),
        ("kpi4_status", "KPI4 Status")],
    "rpt_kpi5_renewal_lead": _KPI_HEAD + [
        ("submission_number", "Submission Number"), ("quote_number", "Quote Number"), ("policy_number", "Policy Number"),
        ("policy_status", "Policy Status"), ("renewal_effective_dt", "Renewal Effective Dt"),
        ("renewal_quote_sent_dt", "Renewal Quote Sent Dt"), ("finalize_dt", "Finalize Dt"),
        ("kpi5_days_before_eff", "KPI5 Days QuoteSentBeforeEff"), ("kpi5_status", "KPI5 Status")],
    "rpt_agency_retention": [
        ("agency_code", "Agency Code"), ("agency_name", "Agency Name"), ("cohort_year", "Cohort Year"),
        ("renewals_started", "Renewals Started"), ("renewals_bound", "Renewals Bound"),
        ("renewal_retention_pct", "Renewal Retention %")],
    "rpt_heatmap_detail": [
        ("policy_number", "Policy Number"), ("lob", "LOB"), ("product_name", "Product Name"),
        ("policy_status", "Policy Status"), ("agency_id", "Agency Id"), ("agency_name", "Agency Name"),
        ("risk_city", "Risk City"), ("risk_state", "Risk State"), ("risk_zip", "Risk Zip"),
        ("transaction_type", "Transaction Type"), ("written_premium", "Written Premium")],
    "rpt_quotes_due": [
        ("submission_number", "Submission Number"), ("quote_number", "Quote Number"), ("uw_broker", "UWBroker"),
        ("insured_name", "Insured Name"), ("agency_code", "Agency Code"), ("agency_name", "Agency Name"),
        ("transaction_type", "Transaction Type"), ("premium", "Premium"), ("proposed_eff_date", "Proposed Eff Date"),
        ("proposed_exp_date", "Proposed Exp Date"), ("days_until_effective_date", "Days Until Effective Date"),
        ("quote_status", "Quote Status")],
    "rpt_renewals_forecast": [
        ("agency_code", "Agency Code"), ("agency_name", "Agency Name"), ("underwriter", "Underwriter"),
        ("policy_number", "Policy Number"), ("submission_number", "Submission Number"), ("quote_id", "Quote ID"),
        ("policy_status", "Policy Status"), ("transaction_type", "Transaction Type"),
        ("effective_date", "Effective Date"), ("expiration_date", "Expiration Date"),
        ("written_premium", "Written Premium"), ("risk_city", "Risk City"), ("risk_state", "Risk State"),
        ("risk_zip", "Risk Zip")],
    "rpt_agency_scorecard": [
        ("agency_code", "Agency Code"), ("agency_name", "Agency Name"),
        ("submissions_created_r3m", "Submissions Created Rolling 3 Mo (New Intake)"),
        ("submissions_activity_r3m", "Submissions with Rolling 3 Mo Activity (Created/Quoted/Bound)"),
        ("submissions_quoted_r3m", "Submissions Quoted Rolling 3 Mo (Had a Quote Started)"),
        ("quotes_started_r3m", "Quotes Started Rolling 3 Mo (Cohort)"),
        ("raw_quote_rows_started_r3m", "Raw Quote Rows Started Rolling 3 Mo"),
        ("quotes_started_bound_to_date", "Quotes Started Rolling 3 Mo That Are Bound (To Date)"),
        ("sub_to_quote_pct_vs_intake", "Submission→Quote % (vs New Intake)"),
        ("sub_to_quote_pct_vs_activity", "Submission→Quote % (vs Rolling 3 Mo Activity Submissions)"),
        ("quote_to_bind_pct", "Quote→Bind % (Pipeline Cohort)"),
        ("nb_quotes_started_r3m", "New Business Quotes Started Rolling 3 Mo"),
        ("nb_quotes_bound_to_date", "New Business Quotes Bound (To Date)"),
        ("nb_quote_to_bind_pct", "New Business Quote→Bind % (Pipeline)"),
        ("renewal_quotes_started_r3m", "Renewal Quotes Started Rolling 3 Mo"),
        ("renewal_quotes_bound_to_date", "Renewal Quotes Bound (To Date)"),
        ("renewal_quote_to_bind_pct", "Renewal Quote→Bind % (Pipeline)"),
        ("declines_created_r3m", "Declines Created Rolling 3 Mo"),
        ("decline_rate_pct", "Decline Rate % (vs Submissions Quoted Rolling 3 Mo)"),
        ("binds_r3m", "Binds in Rolling 3 Mo (Production)"),
        ("binds_r3m_from_cohort", "Binds in Rolling 3 Mo from Quotes Started Rolling 3 Mo"),
        ("binds_r3m_carryover", "Binds in Rolling 3 Mo from Prior-Period Quotes (Carryover)"),
        ("carryover_pct", "Carryover % of Rolling 3 Mo Binds"),
        ("binds_per_intake_pct", "Binds ÷ New Intake Submissions % (Production Throughput)"),
        ("binds_per_activity_pct", "Binds ÷ Rolling 3 Mo Activity Submissions % (Production Throughput)"),
        ("bound_premium_r3m", "Bound Premium in Rolling 3 Mo (Quote Options Proxy)"),
        ("bound_fees_r3m", "Bound Fees in Rolling 3 Mo (Quote Options Proxy)"),
        ("declined_premium_r3m", "Declined Premium from Declines Created Rolling 3 Mo (Quote Options Proxy)"),
        ("dollar_hit_ratio_pct", "Dollar Hit Ratio % (Bound ÷ (Bound+Declined))"),
        ("nb_binds_r3m", "New Business Binds in Rolling 3 Mo"),
        ("renewal_binds_r3m", "Renewal Binds in Rolling 3 Mo"),
        ("nb_bound_premium_r3m", "New Business Bound Premium in Rolling 3 Mo (Quote Options Proxy)"),
        ("renewal_bound_premium_r3m", "Renewal Bound Premium in Rolling 3 Mo (Quote Options Proxy)"),
        ("avg_bound_premium_per_bind", "Avg Bound Premium per Bind (Quote Options Proxy)"),
        ("bound_premium_r3m_from_cohort", "Bound Premium in Rolling 3 Mo from Quotes Started Rolling 3 Mo (Quote Options Proxy)"),
        ("bound_premium_r3m_carryover", "Bound Premium in Rolling 3 Mo from Carryover Quotes (Quote Options Proxy)"),
        ("bound_fees_r3m_from_cohort", "Bound Fees in Rolling 3 Mo from Quotes Started Rolling 3 Mo (Quote Options Proxy)"),
        ("bound_fees_r3m_carryover", "Bound Fees in Rolling 3 Mo from Carryover Quotes (Quote Options Proxy)"),
        ("mvs_overall", "MVS (Overall)"), ("mvs_momentum", "MVS (Momentum)"),
        ("ops_efficiency_score", "Ops Efficiency Score (0–100)"), ("pipeline_health_score", "Pipeline Health (0–100)"),
        ("problem_type_label", "Problem Type Label"), ("problem_type_explanation", "Problem Type Explanation"),
        ("primary_recommended_action", "Primary Recommended Action")],
    "rpt_quote_followup": [
        ("quote_code", "quote_code"), ("business_id", "business_id"), ("quote_sent_date", "quote_sent_date"),
        ("first_follow_up_due_date", "first_follow_up_due_date"), ("second_follow_up_due_date", "second_follow_up_due_date"),
        ("qcl_due_date", "qcl_due_date"), ("proposed_eff_date", "proposed_eff_date"),
        ("proposed_exp_date", "proposed_exp_date"), ("premium", "premium"), ("quote_status", "quote_status")],
    "rpt_submission_lookup": [
        ("submission_number", "Submission Number"), ("agency_name", "Agency Name"), ("insured_name", "Insured Name")],
}


def with_display_names(df: DataFrame, report: str) -> DataFrame:
    """Rename a report's columns to its display names (order kept)."""
    names = dict(DISPLAY_NAMES[report])
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])
