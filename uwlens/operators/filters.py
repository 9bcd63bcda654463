"""Soft-delete and flag predicates (three rules the reports use, kept distinct on purpose)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def active_lenient(flag: ColumnLike) -> Column:
    """ISNULL(flg_active, 1) = 1: an unknown flag counts as active."""
    return F.coalesce(_c(flag), F.lit(1)) == 1


def active_strict(flag: ColumnLike) -> Column:
    """flg_active = 1: an unknown flag drops the row."""
    return _c(flag) == 1


def not_purged(purge_status: ColumnLike) -> Column:
    """ISNULL(purge_status, 0) = 0."""
    return F.coalesce(_c(purge_status), F.lit(0)) == 0


def flag_set(flag: ColumnLike) -> Column:
    """ISNULL(flag, 0) = 1 (e.g. a decline closure)."""
    return F.coalesce(_c(flag), F.lit(0)) == 1


def live(df_flag: ColumnLike, df_purge: ColumnLike) -> Column:
    """Lenient active and not purged: the usual rule for submissions and quotes."""
    return active_lenient(df_flag) & not_purged(df_purge)


def non_blank(c: ColumnLike) -> Column:
    """LTRIM(RTRIM(x)) <> '' (NULL is not non-blank)."""
    return F.trim(_c(c)) != ""
