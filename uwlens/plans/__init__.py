"""End-to-end report jobs (one function per report) and their registry."""

from .kpi import kpi1_submission_to_quote, kpi2_binder, kpi3_endorsement, kpi4_policy_sent, kpi5_renewal_lead
from .reports import (agency_retention, heatmap_detail, quote_followup, quotes_due, renewals_forecast,
                      submission_lookup)
from .scorecard import agency_scorecard

REPORTS = {
    "rpt_kpi1_submission_to_quote": kpi1_submission_to_quote,
    "rpt_kpi2_binder": kpi2_binder,
    "rpt_kpi3_endorsement": kpi3_endorsement,
    "rpt_kpi4_policy_sent": kpi4_policy_sent,
    "rpt_kpi5_renewal_lead": kpi5_renewal_lead,
    "rpt_agency_retention": agency_retention,
    "rpt_heatmap_detail": heatmap_detail,
    "rpt_quotes_due": quotes_due,
    "rpt_renewals_forecast": renewals_forecast,
    "rpt_agency_scorecard": agency_scorecard,
    "rpt_quote_followup": quote_followup,
    "rpt_submission_lookup": submission_lookup,
}

#: Reports whose rows come in a defined order (the renewals forecast has none).
SORTED_REPORTS = frozenset(REPORTS) - {"rpt_renewals_forecast"}

__all__ = ["REPORTS", "SORTED_REPORTS"]
