"""Money and ratio expressions with the decimal types the reports use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnLike = Column | str

MONEY = T.DecimalType(18, 2)
RATIO = T.DecimalType(18, 4)
FINE = T.DecimalType(18, 6)

# A plain decimal number after removing thousands separators and the dollar sign.  Exponent
# notation ('1e3') is rejected on purpose: the source system's conversion refuses it.
PLAIN_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\s*$"


def _c(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_money(c: ColumnLike, dtype: T.DataType | None = None) -> Column:
    """TRY_CONVERT(DECIMAL(18,2), REPLACE(REPLACE(text, ',', ''), '$', '')).

    Numeric input is cast directly (its text form carries neither separator).  Text loses ``,`` and
    ``$``, must then be a plain number, and is rounded half-up to cents; anything else is NULL.
    """
    c = _c(c)
    if dtype is not None and isinstance(dtype, (T.DecimalType, T.IntegralType)):
        return c.try_cast(MONEY)
    s = F.translate(c.cast(T.StringType()), ",$", "")
    return F.when(s.rlike(PLAIN_NUMBER), F.trim(s).try_cast(MONEY))


def money_or_zero(c: ColumnLike, dtype: T.DataType | None = None) -> Column:
    """ISNULL(x, 0) as money."""
    return F.coalesce(parse_money(c, dtype), F.lit(0).cast(MONEY))


def money_text(c: ColumnLike, width: int = 50) -> Column:
    """CONVERT(NVARCHAR(n), money): '1234.50'; NULL stays NULL."""
    return F.substring(_c(c).cast(T.StringType()), 1, width)


def ratio4(num: ColumnLike, den: ColumnLike) -> Column:
    """Count ratio as DECIMAL(18,4) rounded half-up; NULL when the denominator is 0 or NULL."""
    n, d = _c(num).cast(RATIO), _c(den).cast(RATIO)
    return F.when(_c(den) != 0, (n / d).cast(RATIO))
