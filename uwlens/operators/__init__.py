"""DataFrame -> DataFrame operators the reports are composed of."""

from .asof import first_at_or_after
from .distinct import distinct_flags
from .documents import document_events, first_documents, tracer_extremes
from .existence import keys_in_any, min_over_sources, semi_join_any
from .filters import active_lenient, active_strict, flag_set, live, non_blank, not_purged
from .latest import latest_option, option_dollars, option_effective_date, preferred_quote, top1
from .lookup import first_row_per_key

__all__ = [n for n in dir() if not n.startswith("_")]
