"""Session with the settings the plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


# Bytes of input that a shuffle partition stands for.
PARTITION_BYTES = 128 << 20


def partitions_for(input_bytes: int) -> int:
    """Shuffle partitions for an input of this size; adaptive execution merges those that turn out small."""
    return max(200, -(-input_bytes // PARTITION_BYTES))


# A union of tables that are laid out alike must not count as laid out so itself: in Spark 4.1 adaptive execution may lose
# that layout after a join above has been planned on it, and the job ends with "Can't zip RDDs with unequal numbers of partitions".
PLAIN_UNIONS = ("spark.sql.unionOutputPartitioning", "false")


def plain_unions(spark: SparkSession) -> None:
    """For sessions that others have built: what is joined or grouped after a union is shuffled first."""
    spark.conf.set(*PLAIN_UNIONS)


def build_session(app: str = "foliotree", master: str | None = None, shuffle_partitions: int | None = None,
                  input_bytes: int | None = None, **conf: str) -> SparkSession:
    """``shuffle_partitions`` sets their number, ``input_bytes`` lets it follow the size of the input."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config(*PLAIN_UNIONS)
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    elif input_bytes:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions_for(input_bytes)))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
