"""Column -> Column expressions (all native Catalyst expressions; no Python UDFs)."""

from . import fixed_values
from .dates import (business_days_exclusive, business_days_inclusive, day, days_between, in_window, month_start,
                    months_added, try_date, week_crossings, week_label, week_start, year_start)
from .fmt import int_text, us_date
from .labels import (doc_is_bind_request, doc_is_binder_sent, doc_is_endorsement_sent, doc_is_policy_sent,
                     doc_is_quote_to_agent, doc_is_quote_to_agent_prefix, doc_is_renewal_invoice, like_all,
                     like_any, policy_status, sla_band_calendar, sla_band_max, sla_band_min, tracer_is_endorsement,
                     tracer_is_endorsement_finalized, tracer_is_endorsement_start, tracer_is_quote,
                     tracer_is_quote_sent, tt_forecast, tt_heatmap)
from .money import FINE, MONEY, RATIO, money_or_zero, money_text, parse_money, ratio4
from .text import (fixed_width, person_name_full3, person_name_full3_trimlast, person_name_short, strip,
                   strip_or_empty)

__all__ = [n for n in dir() if not n.startswith("_")]
