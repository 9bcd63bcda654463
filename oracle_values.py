"""FIXED VALUES of the reports, stated a second time for the oracle.

Labels, codes, name patterns and thresholds that results must reproduce.  They are kept apart from the
package on purpose: a value changed on one side only makes the comparison of its query fail.
"""

POLICY_NOT_BOUND = "Not Bound"
POLICY_BOUND_NOT_FINALIZED = "Bound – Not Finalized"
POLICY_FINALIZED = "Policy Finalized"
NO_BINDER_REQUEST = "No Binder Request Found"
NO_BINDER_SENT = "No Binder Sent Found"
NO_ENDORSEMENT_REQUEST = "No Endorsement Request Found"
NO_ENDORSEMENT_SENT = "No Endorsement Sent Found"
KPI1_GREEN_MAX_BUSINESS_DAYS = 3
KPI2_GREEN_MAX_BUSINESS_DAYS = 5
KPI3_GREEN_MAX_BUSINESS_DAYS = 5
KPI4_GREEN_MAX_CALENDAR_DAYS = 30
KPI5_GREEN_MIN_LEAD_DAYS = 45
TT_NEW_BUSINESS = "New Business"
TT_NB_AND_RENEWAL = ("New Business", "Renewal")
TT_RENEWALS = ("Renewal", "Renewals")
TT_ENDORSEMENTS = ("Endorsement", "Endorsements")
TT_HEATMAP = ("New Business", "Renewal", "Renewals", "Endorsement", "Endorsements", "Cancellation", "Cancellations")
TT_CANCEL_PREFIX = "Cancel%"
TT_NOTICE_PREFIX = "Notice of Cancellation%"
TT_FORECAST_EXCLUDED = ("Endorsement", "Endorsements", "Cancellation", "Cancellations")
KPI1_TRANSACTION_LABEL = "New Business"
KPI3_TRANSACTION_LABEL = "Endorsement"
KPI5_TRANSACTION_LABEL = "Renewal"
DOC_QUOTE_TO_AGENT_CONTAINS = ("%QUOTE TO AG%", "%QUOTE TO AGENT%")
DOC_BIND_REQUEST = ("%RTB%", "%REQ TO BIND%", "%BIND REQ%", "%REQUEST TO BIND%", "%BIND REQUEST%")
DOC_BINDER_SENT = ("BINDER TO AG%", "BINDER TO AGT%", "BINDER TO AGENT%")
DOC_ENDORSEMENT_SENT_ALL = ("%ENDT%", "%TO%", "%AG%")
DOC_POLICY_SENT_ALL = ("%POLICY%", "%TO%", "%AG%")
DOC_QUOTE_TO_AGENT_PREFIX = ("QUOTE TO AG%", "QUOTE TO AGENT%")
DOC_RENEWAL_INVOICE_PREFIX = "DBI RENEWAL INVOICE%"
TRACER_SUBTYPE_QUOTE = "SSPNS"
TRACER_QUOTE_PREFIX = "Quote%"
TRACER_QUOTE_SENT = ("Quote Sent", "Renewal Quote Sent")
TRACER_ENDORSEMENT_ANY = "%Endorsement%policy No.%"
TRACER_ENDORSEMENT_START = ("Endorsement % start on policy No.%", "Internal Endorsement% start on policy No.%")
TRACER_ENDORSEMENT_FINALIZED = ("Endorsement % Finalized on policy No.%", "Internal Endorsement% Finalized on policy No.%")
EMAIL_QUOTE = "QUOTE"
EMAIL_QUOTE_OR_RENEWAL = ("QUOTE", "RENEWAL_QUOTE")
OPEN_QUOTE_STATUSES = (
    "NB_QUOTE_OFFERED",
    "NB_BINDER_CANCELLED",
    "NB_BINDER_REQUESTED",
    "REN_QUOTE_OFFERED",
    "REN_BINDER_CANCELLED",
    "REN_BINDER_REQUESTED",
)
STATUS_NB_QUOTE_OFFERED_TEXT = "New Business Quote Offered"
PREMIUM_THRESHOLD = 2500
FOLLOW_UP_DAYS = (3, 25, 30)
RETENTION_EXCLUDED_AGENCY_CODES = ("AGT001", "AGT002")
AGENCY_CODE_PREFIX = "AGT"
AGENCY_ROLLUP = (
    ("AGT044", "AGT044", "HUB International Northwest, LLC"),
    ("AGT070", "AGT044", "HUB International Northwest, LLC"),
    ("AGT071", "AGT044", "HUB International Northwest, LLC"),
    ("AGT092", "AGT092", "RISQ Consulting"),
    ("AGT093", "AGT092", "RISQ Consulting"),
    ("AGT059", "AGT055", "Nissi"),
    ("AGT055", "AGT055", "Nissi"),
)
PROBLEM_TEXT_WIDTHS = (60, 400, 160)
PROBLEM_TYPES = (
    (1, "No Activity",
     "No submissions created or touched in the Rolling 3 Mo window for this agency.",
     "No action needed—monitor monthly for reactivation."),
    (2, "Intake Not Worked Yet",
     "New intake exists in the Rolling 3 Mo window but no quotes/binds yet—likely not worked, incomplete, or waiting in queue.",
     "Assign owner; enforce first-touch SLA; validate completeness and request missing items same day."),
    (3, "Intake Quality / Intake Triage",
     "High new intake but low submission→quote conversion vs intake in the Rolling 3 Mo window. Focus: submission quality standards, minimum info gate, and appetite alignment.",
     "Coach agency on minimum submission standards; implement intake gate; share appetite/do-not-send list; schedule producer call."),
    (4, "Processing Bottleneck (Work→Quote)",
     "Many submissions were touched in the Rolling 3 Mo window, but relatively few became quoted. Focus: internal processing/underwriting throughput and turnaround time.",
     "Rebalance workload; prioritize quoting queue; remove internal blockers; set 24–48h quote-start SLA for this agency."),
    (5, "Competitiveness / Follow-Up (Quote→Bind)",
     "Quotes are being started, but cohort quote→bind is low. Focus: competitiveness (pricing/terms), carrier fit, and follow-up discipline.",
     "Review top losses; adjust market/pricing strategy; tighten follow-up cadence; require producer status updates on open quotes."),
    (6, "Appetite Mismatch (High Declines)",
     "Decline rate is elevated relative to quoted submissions in the Rolling 3 Mo window. Focus: refine appetite guidance to agency and reduce off-target quoting effort.",
     "Run appetite reset: train producer team; add pre-qual questions; decline earlier; reduce UW time on off-appetite accounts."),
    (7, "Backlog-Driven (High Carryover)",
     "Rolling 3 Mo production is primarily coming from prior-period quotes (carryover). Focus: strengthen current cohort conversion to avoid next-period dip.",
     "Push current cohort: daily close-out list; prioritize quotes started in the Rolling 3 Mo window; target renewals/NB pending decisions; prevent next-period cliff."),
    (8, "Healthy / Monitor",
     "Key funnel indicators look stable in the Rolling 3 Mo window. Continue monitoring for changes in intake, conversion, or declines.",
     "Maintain service level; expand relationship; identify upsell/cross-sell opportunities and replicate what is working."),
)
