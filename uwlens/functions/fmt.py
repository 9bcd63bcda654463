"""Output formatting: US dates, integers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnLike = Column | str


def _c(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def us_date(c: ColumnLike, dtype: T.DataType | None = None) -> Column:
    """CONVERT(NVARCHAR(10), x, 110).

    A DATE/TIMESTAMP becomes ``mm-dd-yyyy``.  A text column is not reformatted by that conversion
    (the style applies to date types only); it is cut to 10 characters, so pass its type.
    """
    c = _c(c)
    if isinstance(dtype, T.StringType):
        return F.substring(c, 1, 10)
    return F.date_format(c.cast(T.DateType()), "MM-dd-yyyy")


def int_text(c: ColumnLike, width: int = 10) -> Column:
    """CONVERT(NVARCHAR(n), int)."""
    return F.substring(_c(c).cast(T.StringType()), 1, width)
