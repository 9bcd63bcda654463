"""uwlens - underwriting analytics for an insurance MGA on Apache Spark.

Layout: ``sources`` (schemas, loading, sinks), ``functions`` (column expressions), ``operators``
(DataFrame operators), ``plans`` (the reports), ``streaming`` (scheduled re-runs), ``params``
(as-of date and windows).
"""

from .params import ReportParams

__version__ = "0.1.0"
__all__ = ["ReportParams"]
