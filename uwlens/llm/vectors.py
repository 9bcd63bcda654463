"""Integer vectors of an embedding table and row numbers, shared by the whitening and the top-k operator."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, pick

SCALE = 256
_IN_PARTITION = 33  # bits that monotonically_increasing_id keeps for the row's place in its partition


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): each component c as the bigint floor(scale * c), rows without a whole finite vector left out."""
    vectors = pick(rows, vec_id=id_col, vec=vector_col).select("vec_id", F.col("vec").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.where(F.col("vec").isNotNull() & finite).select(
        "vec_id", F.transform("vec", lambda c: F.floor(c * float(scale))).alias("x"))


def numbered(df: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``df`` staged, with ``row_no``: 0, 1, 2, ... without gaps.

    Rows keep the place they have in the task that writes them; a task's rows start where those of the
    tasks before end.  Only one row per writing task is summed up, and no row is shuffled for it."""
    staged = scratch.save(df.withColumn("mark", F.monotonically_increasing_id()), name)
    task = F.shiftright("mark", _IN_PARTITION)
    place = F.col("mark").bitwiseAND((1 << _IN_PARTITION) - 1)
    cells = staged.groupBy(task.alias("task")).agg((F.max(place) + 1).alias("rows"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = scratch.save(cells.select("task", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first")), f"{name}-first")
    return (staged.withColumn("task", task).join(first, "task")
            .withColumn("row_no", F.col("first") + place).drop("task", "first", "mark"))


def even_length(vectors: DataFrame, name: str = "x") -> tuple[DataFrame, int, int]:
    """The vectors, shorter ones filled with zeros; their common length; their number."""
    longest, shortest, n = vectors.agg(F.max(F.size(name)), F.min(F.size(name)), F.count(F.lit(1))).first()
    if n and longest != shortest:
        filler = F.array_repeat(F.lit(0).cast("bigint"), F.lit(longest) - F.size(name))
        vectors = vectors.withColumn(name, F.concat(name, filler))
    return vectors, longest or 0, n


@contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """Within it, frames run with at most ``most`` rows in an Arrow batch; the caller's setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)
