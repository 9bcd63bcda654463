"""Helpers shared by the training-data operators: column picking, staging, ordered positions, bitmaps."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[\x20\x09-\x0D]+"
#: Bits of one ``bitmap_construct_agg`` bitmap.
BITMAP_BITS = 32768
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else (``lower`` would change other alphabets too)."""
    return F.translate(text, UPPER, LOWER)


def whole_text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes, the form Python helpers take: ``bytes.lower`` and ``bytes.split`` know ASCII only."""
    return whole_text(text).cast("binary")


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """The named input columns under working names; other columns, however called, cannot clash."""
    at = {name: df.columns.index(source) for name, source in cols.items()}
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(name) for name, i in at.items()])


def with_results(df: DataFrame, **results: Column) -> DataFrame:
    """Input columns plus result columns; an input column of a result's name (in any case) gives way."""
    taken = {k.lower() for k in results}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *[v.alias(k) for k, v in results.items()])


def crc_remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id has remainder -1."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus, F.lit(-1))


class Scratch:
    """Intermediate tables below the session's ``spark.checkpoint.dir``: written once, then read by
    every branch that needs them, so lineage ends there and a lost executor costs a re-read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark.range(0))}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def save_only(self, df: DataFrame, name: str) -> DataFrame:
        """``save`` for a frame that nothing else reads: Spark deletes its shuffle files when it is written."""
        before = self.spark.conf.get(SHUFFLE_CLEANUP, None)
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            return self.save(df, name)
        finally:
            if before is None:
                self.spark.conf.unset(SHUFFLE_CLEANUP)
            else:
                self.spark.conf.set(SHUFFLE_CLEANUP, before)

    def drop(self, name: str) -> None:
        """Delete a table that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Let Python workers take at most ``rows`` texts and about ``size`` bytes at a time (the session's Arrow
    batch limits): a batch exists several times over, in the JVM, in Arrow and in the worker, and a limit
    on rows alone would leave it open when the texts are long."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def freed_at_once(spark: SparkSession) -> None:
    """Let Python workers give arrays and Arrow buffers of 4 MiB and more back to the system when they are freed
    (environment of workers started from now on; values that the session was given stay).  By default glibc raises
    that size to 32 MiB as arrays are freed, and a worker, which is used again, keeps most of the memory it ever took."""
    for name, value in (("MALLOC_MMAP_THRESHOLD_", str(4 << 20)), ("MALLOC_TRIM_THRESHOLD_", str(32 << 20)),
                        ("ARROW_DEFAULT_MEMORY_POOL", "system")):
        spark.sparkContext.environment.setdefault(name, value)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt_in_order(df: DataFrame, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """``df`` staged in range partitions of ``order``, with the partition's number as ``range_no``."""
    spark = df.sparkSession
    return scratch.save(df.repartitionByRange(partitions(spark), *order)
                        .withColumn("range_no", F.spark_partition_id()), name)


def positions(dealt: DataFrame, group: str, order: list[Column], extra: DataFrame | None = None) -> DataFrame:
    """1-based ``position`` of each row of ``dealt_in_order`` within its (non-null) ``group``.

    A distributed prefix sum: rows are numbered inside each (range, group) cell and cells are offset
    by the counts of the ranges before, so no group meets in one task however large it is.  ``extra``
    (one row per group) is attached through the cells, at most one per range for a hot group."""
    cells = dealt.groupBy("range_no", group).agg(F.count(F.lit(1)).alias("cell_rows"))
    before = Window.partitionBy(group).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("rows_before", F.coalesce(F.sum("cell_rows").over(before), F.lit(0))).drop("cell_rows")
    if extra is not None:
        cells = cells.join(extra, group, "left")
    here = Window.partitionBy("range_no", group).orderBy(*order)
    return (dealt.withColumn("in_cell", F.row_number().over(here))
            .join(cells, ["range_no", group])
            .withColumn("position", F.col("rows_before") + F.col("in_cell"))
            .drop("in_cell", "rows_before", "range_no"))


def bitmap_of(slots: DataFrame, col: str) -> DataFrame:
    """One bit per value of ``col`` (a non-negative bigint below a caller-set bound), as rows
    (bucket, bitmap) of 4 KiB each: at most bound / 32768 rows, which makes a broadcast of it safe."""
    return (slots.groupBy(F.floor(F.col(col) / BITMAP_BITS).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.col(col) % BITMAP_BITS).alias("bitmap")))


def bit_is_set(bitmap: Column, slot: Column) -> Column:
    """Whether ``slot``'s bit is set in its bucket's bitmap (null bitmap: not set)."""
    bit = (slot % BITMAP_BITS).cast("int")
    byte = F.conv(F.hex(bitmap.substr(F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))


def flagged_by(df: DataFrame, bitmap: DataFrame, slot: str, flag: str) -> DataFrame:
    """``df`` plus boolean ``flag``: the bit of ``slot`` is set.  Joins the bounded bitmap by broadcast."""
    marks = F.broadcast(bitmap.withColumnsRenamed({"bucket": "bm_bucket", "bitmap": "bm_bits"}))
    joined = df.join(marks, F.floor(F.col(slot) / BITMAP_BITS) == F.col("bm_bucket"), "left")
    return joined.withColumn(flag, bit_is_set(F.col("bm_bits"), F.col(slot))).drop("bm_bucket", "bm_bits")
