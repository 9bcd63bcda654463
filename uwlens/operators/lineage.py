"""Staging a small intermediate that several branches of one plan read.

Spark re-executes a DataFrame's lineage for every branch that reads it, and it estimates a filtered, joined
frame from the sizes of the tables below it: a set of twenty keys counts as terabytes, so joins to it shuffle
the large side.  ``materialized`` writes such a frame once as Parquet below the cluster's checkpoint folder
(``spark.checkpoint.dir``, shared and fault-tolerant) and reads it back.  Lineage ends there, a lost executor
costs a re-read, and the planner sees the true size in bytes: a set within
``spark.sql.autoBroadcastJoinThreshold`` is broadcast to the scan of a large table, which is then not shuffled,
and a larger one is joined by shuffle.

Staged files lie in one folder per application, which Hadoop deletes when the driver's JVM ends.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(df: DataFrame) -> str:
    """The session's ``spark.checkpoint.dir``.

    Only a local-mode session (tests, local runs) without that setting gets a scratch folder of
    our own; on a cluster a machine-local folder would be invisible to other executors, so the
    setting is required there."""
    spark = df.sparkSession
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder: reports checkpoint small "
                               "intermediates there")
        configured = tempfile.mkdtemp(prefix="uwlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return configured


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def new_stage(df: DataFrame) -> str:
    """An unused folder name below the application's staging folder."""
    spark = df.sparkSession
    root = f"{checkpoint_dir(df)}/uwlens-stage-{spark.sparkContext.applicationId}"
    files, at = _hadoop_path(spark, root)
    if not files.exists(at):
        files.mkdirs(at)
        files.deleteOnExit(at)
    return f"{root}/{uuid.uuid4().hex}"


def materialized(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: same rows and columns, no lineage, its true size in bytes."""
    path = new_stage(df)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialized_together(*frames: DataFrame) -> list[DataFrame]:
    """Several frames that do not depend on each other, written at the same time."""
    if len(frames) < 2:
        return [materialized(f) for f in frames]
    with ThreadPoolExecutor(len(frames)) as pool:
        return list(pool.map(inheritable_thread_target(frames[0].sparkSession)(materialized), frames))


def bytes_of(frame: DataFrame) -> int:
    """Bytes of a materialised frame's files."""
    total = 0
    for name in frame.inputFiles():
        files, at = _hadoop_path(frame.sparkSession, name)
        total += files.getFileStatus(at).getLen()
    return total
