"""Existence and earliest-of-several-sources operators on composite keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def keys_in_any(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Distinct key tuples present in at least one source (partial aggregation, skew-safe)."""
    return _union([s.select(*keys) for s in sources]).distinct()


def semi_join_any(df: DataFrame, sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose key tuple exists in any source: one left-semi join instead of an OR of
    correlated ``COUNT(...) > 0`` subqueries."""
    return df.join(keys_in_any(sources, keys), keys, "left_semi")


def min_over_sources(sources: list[DataFrame], keys: list[str], ts: str, out: str) -> DataFrame:
    """MIN(ts) per key tuple over the UNION ALL of the sources."""
    return _union([s.select(*keys, F.col(ts).alias(out)) for s in sources]).groupBy(*keys).agg(F.min(out).alias(out))
