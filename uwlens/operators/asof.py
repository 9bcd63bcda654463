"""Forward as-of join: for each anchor, the first event at or after it with the same key.

Spark has no as-of join.  Two exact strategies, both free of all-pairs expansion and both reading
each input once:

* ``unique_anchor=True`` (at most one anchor per key): equi-join events to anchors on the key,
  keep ``event >= anchor``, take the minimum per anchor.  Each event meets exactly one anchor, and the
  minimum is a partial (map-side) aggregate.  Anchors without a qualifying event are not returned.
* otherwise (many anchors per key): a distributed suffix minimum.  Anchor rows and distinct event times
  are range-partitioned by (key, time) into slices, so neither a key nor a day nor one instant is a unit
  of work: a key that holds a third of all rows spreads over a third of the slices.  Inside a slice, a
  window from late to early carries the running minimum event time to every anchor.  What a slice does
  not see is the first event of the key's later slices: each (key, slice) gets it from a window over the
  slices' first events.  Only a key that crosses a slice's edge has such a carry, so there are at most
  two per slice, a table small enough to broadcast however large the inputs are.  Every anchor row is
  returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import materialized

_LAST = (1 << 63) - 1


def first_at_or_after(anchors: DataFrame, events: DataFrame, key: str, anchor_ts: str, event_ts: str,
                      out: str, unique_anchor: bool = False) -> DataFrame:
    """``anchors`` plus column ``out`` = MIN(event_ts) over events of the same ``key`` with
    ``event_ts >= anchor_ts`` (see the module notes for which anchors are returned).  A NULL key or
    anchor time has no event."""
    ev = (events.select(F.col(key).alias("_key"), F.col(event_ts).alias("_et"))
          .where(F.col("_et").isNotNull() & F.col("_key").isNotNull()).distinct())  # partial: a hot key's equal times collapse
    if unique_anchor:
        cols = anchors.columns
        j = ev.join(anchors.where(F.col(anchor_ts).isNotNull()), F.col("_key") == anchors[key])
        return j.where(F.col("_et") >= F.col(anchor_ts)).groupBy(*cols).agg(F.min("_et").alias(out))
    return _suffix_minimum(anchors, ev, key, anchor_ts, out)


def sliced(anchors: DataFrame, ev: DataFrame, key: str, anchor_ts: str, slices: int) -> DataFrame:
    """Anchors (``_row``) and events (``_row`` NULL) in range partitions of (key, time), with the partition's
    number ``_slice``.  At equal times events come after all anchors, so an anchor's events are in its slice
    or a later one; anchors at one instant are told apart by a hash of their row, so they may split."""
    a = anchors.select(F.col(key).alias("_key"), F.col(anchor_ts).alias("_t"),
                       F.shiftrightunsigned(F.xxhash64(*anchors.columns), 1).alias("_tie"), F.struct(*anchors.columns).alias("_row"))
    a = a.withColumn("_tie", F.least(F.col("_tie"), F.lit(_LAST - 1)))
    e = ev.select("_key", F.col("_et").cast(anchors.schema[anchor_ts].dataType).alias("_t"), F.lit(_LAST).alias("_tie"),
                  F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    dealt = a.unionByName(e).repartitionByRange(slices, "_key", "_t", "_tie")
    return materialized(dealt.withColumn("_slice", F.spark_partition_id()))


def carries(dealt: DataFrame) -> DataFrame:
    """(_key, _slice, _later): the first event of the key's later slices, where there is one.

    At most one row per slice and key that goes on after it, that is fewer rows than slices."""
    event = F.when(F.col("_row").isNull(), F.col("_t"))
    firsts = dealt.where(F.col("_key").isNotNull()).groupBy("_key", "_slice").agg(F.min(event).alias("_first"))
    after = Window.partitionBy("_key").orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return firsts.withColumn("_later", F.min("_first").over(after)).where(F.col("_later").isNotNull()).drop("_first")


def _suffix_minimum(anchors: DataFrame, ev: DataFrame, key: str, anchor_ts: str, out: str) -> DataFrame:
    kind = anchors.schema[anchor_ts].dataType
    event_kind = ev.schema["_et"].dataType
    if event_kind != kind:  # compare in the finer type of the two, as >= does
        wide = event_kind if kind.typeName() == "date" else kind
        anchors = anchors.withColumn("_at", F.col(anchor_ts).cast(wide))
        found = _suffix_minimum(anchors, ev.withColumn("_et", F.col("_et").cast(wide)), key, "_at", out)
        return found.drop("_at").withColumn(out, F.col(out).cast(event_kind))
    slices = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sliced(anchors, ev, key, anchor_ts, slices)
    down = (Window.partitionBy("_slice", "_key").orderBy(F.col("_t").desc_nulls_last(), F.col("_tie").desc())
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    swept = dealt.withColumn("_near", F.min(F.when(F.col("_row").isNull(), F.col("_t"))).over(down)).where(F.col("_row").isNotNull())
    # fewer rows than slices: bounded by the number of partitions, not by the data
    found = swept.join(F.broadcast(carries(dealt)), ["_key", "_slice"], "left")
    first = F.when(F.col("_t").isNotNull() & F.col("_key").isNotNull(), F.coalesce("_near", "_later"))
    return found.select("_row.*", first.alias(out))
