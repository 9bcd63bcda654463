"""Positions of globally sorted rows, without a window over all of them.

``orderBy`` leaves rows in range partitions that follow each other in order.  ``with_position`` writes the
sorted frame once with each row's partition and place in it, counts the rows of each partition, and adds the
count of the partitions before: one number per partition moves, no row does, and no task sees all rows.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import materialized

_PLACE_BITS = 33  # of monotonically_increasing_id: the row's place; above them the partition's number


def with_position(ordered: DataFrame, name: str = "position") -> DataFrame:
    """``ordered`` (the result of an ``orderBy``, perhaps projected) plus its 1-based ``name``."""
    rows = materialized(ordered.withColumn("_mark", F.monotonically_increasing_id()))
    part = F.shiftright("_mark", _PLACE_BITS)
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = [0, *accumulate(n for _, n in counts)]
    first = ordered.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "_part bigint, _first bigint")
    place = F.col("_mark").bitwiseAND((1 << _PLACE_BITS) - 1)
    # one row per partition of the sort
    return (rows.withColumn("_part", part).join(F.broadcast(first), "_part")
            .select(*ordered.columns, (F.col("_first") + place + 1).alias(name)))
