"""Mixing sources to target weights by systematic sampling.

Each source's target size comes from its weight: weights share the corpus's whole size, no target
exceeds ``max_repeat`` times its source's size, and the excess is reshared by weight until none is
above.  Every document of a source then expects ``rate = target / size`` copies.  Documents are put
in order of size inside their source, expected copies are prefix-summed, one random offset in (0, 1)
is added per source, and a document is emitted once for every integer its interval crosses.  Sorting
by size spreads the copies evenly over short and long texts, so the words taken differ from the target
by about one document.

The prefix sum is distributed (``common.positions``): the slim key rows are range-partitioned by
(source, size, hash, id), numbered in their cells and offset by earlier cells' counts.

Defined results: size is the number of words (null text: 0); a null source is a source of its own,
after all others; an empty source or corpus has target 0 and takes nothing; ties are ordered by the
id's MD5 and then the id, so reruns agree; repeated rows are sampled one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch, dealt_in_order, pick, positions, whole_text

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = 17


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs."""
    parts = F.split(whole_text(text), SPACES)
    return F.size(F.filter(parts, lambda w: w != "")).cast("bigint")


def _source_order(source: Column) -> list[Column]:
    return [source.isNull().cast("int"), source]


def source_targets(sizes: DataFrame, weights: Sequence[float], max_repeat: float, scratch: Scratch) -> DataFrame:
    """Targets of sources: ``sizes`` has (source_key, source, source_size), one row per source.

    Weights go to the sources by their rank in code-point order, repeating.  The water level rises
    until no further source overflows; each round moves three sums to the driver."""
    order = _source_order(F.col("source"))
    ranked = positions(dealt_in_order(sizes.withColumn("one", F.lit(1)), order, scratch, "sources"), "one", order).drop("one")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("position") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = scratch.save(ranked.select("source_key", "source_size", weight.alias("weight")), "weights")
    cap = F.col("source_size") * float(max_repeat)
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > cap
        full, held, free = table.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)),
                                     F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if full == capped or not free:
            break
        capped, level = full, (total - held) / free
    return table.select("source_key", "source_size", F.least(F.col("weight") * F.lit(level), cap).alias("target"))


def offset_of(source_key: Column, seed: int) -> Column:
    """The source's one random offset, k / 4096 with k from 1 to 4095."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), source_key)), 1, 12)
    return (F.conv(digits, 16, 10).cast("bigint") % 4095 + 1) / F.lit(4096.0)


def systematic_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                      weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, text_hash, size, source_size, target, copies, taken."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = pick(docs, doc_id=id_col, text=text_col, source=source_col)
    source = F.col("source").cast("string")
    keys = rows.select("doc_id", source.alias("source"),
                       F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("source_key"),
                       word_count(F.col("text")).alias("size"), F.xxhash64(whole_text(F.col("text"))).alias("text_hash"),
                       F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("tie"))
    in_source = [F.col("size"), F.col("tie"), F.col("doc_id"), F.col("text_hash")]
    keys = scratch.save(keys, "sizes")
    dealt = dealt_in_order(keys, [*_source_order(F.col("source")), *in_source], scratch, "keys")
    sizes = dealt.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, max_repeat, scratch)
    placed = positions(dealt, "source_key", in_source, targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = offset_of(F.col("source_key"), seed)
    crossed = F.floor(F.col("position") * rate + start) - F.floor((F.col("position") - 1) * rate + start)
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.least(crossed, F.lit(max_repeat))).cast("bigint")
    return placed.select("doc_id", "source", "text_hash", "size", "source_size", "target",
                         copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """The mixture itself: each document's row as often as it was drawn, all columns as they came.

    Rows that repeat id, source and text are drawn together and emitted from one of them."""
    def key(id_, source, text_hash):
        return F.md5(F.to_json(F.struct(id_.cast("string").alias("i"), source.alias("s"), text_hash.alias("h"))))

    drawn = (systematic_copies(docs, id_col, text_col, source_col, weights, max_repeat, seed)
             .groupBy(key(F.col("doc_id"), F.col("source"), F.col("text_hash")).alias("mix_key"))
             .agg(F.sum("copies").alias("mix_copies")).where("mix_copies > 0"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row"))
    body = packed.select("mix_row", key(F.col(f"mix_row.`{id_col}`"), F.col(f"mix_row.`{source_col}`").cast("string"),
                                        F.xxhash64(whole_text(F.col(f"mix_row.`{text_col}`")))).alias("mix_key"))
    return (body.dropDuplicates(["mix_key"]).join(drawn, "mix_key")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select("mix_row.*"))
