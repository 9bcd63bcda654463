"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every report relies on.  AQE re-plans joins from runtime sizes (that is the size check
# behind every non-hinted broadcast) and splits skewed shuffle partitions of sort-merge joins.
BASE_CONF: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

INPUT_BYTES_A_PARTITION = 4 << 20
ADVISORY_SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    """``builder`` with BASE_CONF, for every session this package makes (the time zone of the windows
    must not follow the cluster's)."""
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    return builder


def build_session(master: str = "local[*]", app: str = "uwlens", shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = configured(SparkSession.builder.master(master).appName(app))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def deal_by_size(spark: SparkSession, input_bytes: int) -> None:
    """Let shuffles of this session have partitions in proportion to the input.

    A task sorts and groups its whole partition, some 400 bytes a row of operational data, so with a fixed number
    of partitions, or with AQE merging them up to its usual 64 MB, its memory grows with the tables.  The number of
    partitions is only raised, and an advisory size that the session was given stays."""
    wanted = -(-input_bytes // INPUT_BYTES_A_PARTITION)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    if spark.conf.get(ADVISORY_SIZE, None) is None:
        spark.conf.set(ADVISORY_SIZE, "8m")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's ``spark.checkpoint.dir``; only a local-mode session without it gets a
    scratch folder (see ``operators.lineage.checkpoint_dir``)."""
    from .operators.lineage import checkpoint_dir

    return checkpoint_dir(spark.range(0))
