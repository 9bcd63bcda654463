"""Exact de-duplication by two-pass Bloom filtering.

Pass 1 reads every text once and stages a slim key row (id, SHA-256 of the normalised text, two
filter slots); the two slots of every row, unique ones included, shuffle to be counted.  A slot that more than one row hits is marked in a bitmap of ``filter_bits`` bits; the
bitmap is the Bloom filter "possibly repeated".  Pass 2 tests each row's two slots against it: rows
with an unmarked slot are certainly unique and pass straight through, only the rest shuffle in this pass.

The filter never exceeds ``filter_bits / 8`` bytes, whatever the input; a fuller filter only lets more
(slim) rows shuffle, it never changes a result.  A hot group is counted under salts first and its rows
meet their group's totals per salt, so a text that a third of all rows share spreads over all tasks.

Defined results: null text counts as empty; texts are equal when identical after lower-casing A-Z;
of equal texts the largest id stays (null ids are smallest); rows that repeat both id and text are
labelled alike by ``exact_duplicates`` and ``drop_exact_duplicates`` keeps one of them; an empty table
gives an empty result; other input columns are ignored by the first and kept by the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, bitmap_of, flagged_by, partitions, pick, whole_text

FILTER_BITS = 1 << 27


def _slots(df: DataFrame, key: str, bits: int) -> DataFrame:
    """Two Bloom positions of a 64-digit hexadecimal key, from its leading 120 bits."""
    for i, name in enumerate(("slot_a", "slot_b")):
        digits = F.substring(F.col(key), 1 + 15 * i, 15)
        df = df.withColumn(name, F.conv(digits, 16, 10).cast("bigint") % bits)
    return df


def _keys(docs: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    rows = pick(docs, doc_id=id_col, text=text_col)
    return _slots(rows.select("doc_id", F.sha2(ascii_lower(whole_text(F.col("text"))), 256).alias("text_sha256")),
                  "text_sha256", bits)


def _possibly_repeated(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """The Bloom filter: slots hit by two or more rows."""
    hits = keys.select(F.explode(F.array_distinct(F.array("slot_a", "slot_b"))).alias("slot"))
    repeated = hits.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return scratch.save(bitmap_of(repeated, "slot"), "filter")


def _flagged(rows: DataFrame, bloom: DataFrame) -> DataFrame:
    rows = flagged_by(rows, bloom, "slot_a", "hit_a")
    rows = flagged_by(rows, bloom, "slot_b", "hit_b")
    return rows.withColumn("possibly_repeated", F.col("hit_a") & F.col("hit_b")).drop("slot_a", "slot_b", "hit_a", "hit_b")


def _labels(docs: DataFrame, id_col: str, text_col: str, bits: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    keys = scratch.save(_keys(docs, id_col, text_col, bits), "keys")
    bloom = _possibly_repeated(keys, scratch)
    rows = _flagged(keys, bloom)
    unique = rows.where(~F.col("possibly_repeated")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")

    salt = F.pmod(F.xxhash64("doc_id"), F.lit(partitions(spark)))
    suspects = rows.where("possibly_repeated").select("doc_id", "text_sha256", salt.alias("salt"))
    salted = suspects.groupBy("text_sha256", "salt").agg(
        F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
    whole = salted.groupBy("text_sha256").agg(F.sum("n").alias("group_size"), F.max("top").alias("keep_id"))
    groups = salted.select("text_sha256", "salt").join(whole, "text_sha256")
    grouped = suspects.join(groups, ["text_sha256", "salt"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return unique.unionByName(grouped), bloom


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    return _labels(docs, id_col, text_col, filter_bits)[0]


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          filter_bits: int = FILTER_BITS) -> DataFrame:
    """The input rows that stay, all columns as they came.  Rows the filter clears never shuffle."""
    labels, bloom = _labels(docs, id_col, text_col, filter_bits)
    losers = labels.where(~F.col("kept")).select(F.col("doc_id").alias("lost_id"), F.col("text_sha256").alias("lost_sha")).distinct()
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    body = packed.select("row", F.col(f"row.`{id_col}`").alias("doc_id"),
                         F.sha2(ascii_lower(whole_text(F.col(f"row.`{text_col}`"))), 256).alias("text_sha256"))
    rows = _flagged(_slots(body, "text_sha256", filter_bits), bloom)
    straight = rows.where(~F.col("possibly_repeated")).select("row.*")
    stay = (rows.where("possibly_repeated")
            .join(losers, F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("text_sha256") == F.col("lost_sha")), "left_anti")
            .dropDuplicates(["doc_id", "text_sha256"]).select("row.*"))
    return straight.unionByName(stay)
