"""Scalar lookups in code tables.

Joins to code tables carry no hint: ``spark.sql.autoBroadcastJoinThreshold`` and AQE choose a broadcast
from byte sizes (statistics, then run time), and a table that has grown is joined by shuffle instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_row_per_key(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """One row per ``key`` for scalar lookups (one row of an id, without an order): the least row, taken
    as a whole, so that a duplicated id never pairs one row's code with another row's name.  Partial
    aggregation makes it safe for any key skew."""
    least = df.groupBy(key).agg(F.min(F.struct(*cols)).alias("_row"))
    return least.select(key, *[F.col(f"_row.{c}").alias(c) for c in cols])
