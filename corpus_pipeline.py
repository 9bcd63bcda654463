"""The corpus pipeline: five stages over ``documents``, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of ``documents``; between stages the
rows are written as Parquet below the session's ``spark.checkpoint.dir`` and read again, so a stage's
lineage is one scan.  Each stage is judged on its own input: the classifier learns from the labelled rows
among it, sources are weighed by what is left of them.

Defined results: an empty table passes through all stages; the operators' modules state what null, empty,
repeated and tied rows give.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uwlens.llm.common import Scratch, crc_remainder
from uwlens.llm.decontaminate import decontaminate
from uwlens.llm.exact_dedup import drop_exact_duplicates
from uwlens.llm.mixing import mix
from uwlens.llm.near_dedup import drop_near_duplicates
from uwlens.llm.quality_mil import keep_good, train_quality


#: Similarity from which the pipeline takes texts for near copies, on sets of five words (op10 has its own).
NEAR_RATIO = (80, 100)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go (score below one half)."""
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_remainder(F.col("doc_id"), 3) != 1)
    return keep_good(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (similarity 0.8 or more) stays, the one with the smallest doc_id."""
    return drop_near_duplicates(docs, ratio=NEAR_RATIO)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; the others lose benchmark passages (and n_chars follows the text)."""
    clean = decontaminate(docs.withColumn("text_before", F.col("text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    changed = ~F.col("text").eqNullSafe(F.col("text_before"))
    n_chars = F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", n_chars).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight draws them."""
    return mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", benchmark),
    ("source_mixing", mixture),
]

#: Neither the classifier nor the near-duplicate stage can be stated in SQL; tests check run() by parts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
