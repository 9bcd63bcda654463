"""Equi-joins that split hot keys.

A sort-merge join sends all rows of a key to one task.  AQE may split such a task at run time, but not on the
outer side's partner, not on a bucketed layout (there is no shuffle to split), and only once the shuffle has
happened.  Here hot keys are found before the join and dealt over several cells:

1. ``keyed`` writes a side once (``lineage``) and, in the same pass, observes a frequent-items sketch of its
   join key.  Keys with clearly more rows than a task's share are *hot*; at most ``HOT_KEYS`` are kept, which
   covers every key with more than a thousandth of the rows.  Rows get a stored number, so what is dealt by it
   stays where it is when a task is run again.
2. ``split_join`` gives a hot key as many cells as its rows fill task shares.  The side on which it is hot is
   dealt over them by row number, the other side's rows of this key (and only of this key) are repeated for
   each.  A key that is hot on both sides gets a grid.  The join is one join on (key, cell): each input is read
   once, and pairs are neither lost nor repeated.

For a left outer join the repeated rows of the left side need care: a cell may hold none of the key's rows.  A
key that the sketch has reported exists on the right, so an empty cell's NULL row is dropped there and the
other cells have the matches.  Left rows with a NULL key match nothing and are dealt by their hash.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import materialized

HOT_KEYS = 1000
_TRACKED = 10 * HOT_KEYS
#: A key is hot from this many times the rows an even deal would give a task.
_SHARE = 2


@dataclass(frozen=True)
class Keyed:
    """A materialised side of a join: its rows with their number (column ``mark``), and the cells of its hot keys."""

    frame: DataFrame
    on: tuple[str, ...]
    mark: str
    cells: dict[tuple, int]


def keyed(df: DataFrame, on: list[str], mark: str) -> Keyed:
    """``df`` materialised once, its hot values of ``on`` found in the same pass."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a sketch holds one scalar: several columns go in as text and come back as values
    item = F.col(on[0]) if len(on) == 1 else F.when(_all_set(on), F.to_json(F.struct(*on)))
    seen = Observation()
    numbered = df.withColumn(mark, F.monotonically_increasing_id())
    frame = materialized(numbered.select("*", item.alias("_item")).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k(_item, {HOT_KEYS}, {_TRACKED})").alias("top")).drop("_item"))
    rows, top = seen.get["rows"] or 0, seen.get["top"] or []
    hot = {r["item"]: ceil(r["count"] * tasks / rows) for r in top if r["item"] is not None and r["count"] * tasks > _SHARE * rows}
    if len(on) > 1 and hot:
        kinds = frame.select(*on).schema
        texts = df.sparkSession.createDataFrame(list(hot.items()), "item string, cells int")
        hot = {tuple(r.key): r.cells for r in texts.select(F.from_json("item", kinds).alias("key"), "cells").collect()}
    else:
        hot = {(k,): n for k, n in hot.items()}
    return Keyed(frame, tuple(on), mark, hot)


def _all_set(on: list[str]) -> Column:
    out = F.lit(True)
    for k in on:
        out = out & F.col(k).isNotNull()
    return out


def split_join(left: DataFrame, right: DataFrame, on: list[str], how: str, left_hot: Keyed | None = None,
               right_hot: Keyed | None = None) -> DataFrame:
    """``left.join(right, on, how)`` for how = "inner" or "left"; same rows, same multiplicities.

    ``left_hot`` / ``right_hot`` tell the hot keys of a side (the side itself, or what it was made from, with
    the row number kept)."""
    if how not in ("inner", "left"):
        raise ValueError(f"split_join does not do {how} joins")
    across, down = (left_hot.cells if left_hot else {}), (right_hot.cells if right_hot else {})
    outer = how == "left"
    if not across and not down:
        return left.join(right, on, how)
    kinds = left.select(*on).schema
    keys = left.sparkSession.createDataFrame(
        [(*k, across.get(k, 1), down.get(k, 1), k in down) for k in {*across, *down}],
        kinds.add("_across", T.IntegerType()).add("_down", T.IntegerType()).add("_sure", T.BooleanType()))
    keys = F.broadcast(keys)  # at most 2 HOT_KEYS rows
    width, height = F.coalesce("_across", F.lit(1)), F.coalesce("_down", F.lit(1))
    place = F.pmod(F.col(left_hot.mark), width).cast("int") if across else F.lit(0)
    nowhere = -1 - F.pmod(F.xxhash64(*left.columns), F.lit(1 << 20)).cast("int")
    l = left.join(keys, on, "left").select(
        *left.columns, "_sure", F.when(_all_set(on), place).otherwise(nowhere).alias("_a"),
        F.explode(F.sequence(F.lit(0), height - 1)).alias("_b"))
    r = right.join(keys, on, "left").select(
        *right.columns, F.lit(True).alias("_here"), (F.pmod(F.col(right_hot.mark), height).cast("int") if down else F.lit(0)).alias("_b"),
        F.explode(F.sequence(F.lit(0), width - 1)).alias("_a"))
    joined = l.join(r, [*on, "_a", "_b"], how)
    if outer and down:
        joined = joined.where(F.col("_sure").isNull() | ~F.col("_sure") | F.col("_here").isNotNull())
    return joined.select(*left.columns, *[c for c in right.columns if c not in on])


def left_join_hot_right(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """``left.join(right, on, "left")`` for a right side with possibly hot keys (equi-join on
    same-named columns; NULL keys never match, as in the plain join).  The right side is read once."""
    side = keyed(right, on, "_right_mark")
    return split_join(left, side.frame, on, "left", right_hot=side).drop("_right_mark")
