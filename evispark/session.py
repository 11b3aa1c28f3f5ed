"""Session helpers: builder for local use, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; a larger one is shuffled.
BROADCAST_ROWS = 50_000


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("evispark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session.

    Only where the cluster names none (tests on one machine) a temporary folder is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = named.get() if named.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = "file://" + tempfile.mkdtemp(prefix=f"evispark-{os.getpid()}-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder, so that lost executors cost no recomputation of its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_checked(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark `df` for broadcast only if a count shows at most `max_rows` rows; otherwise leave the join to Spark."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def shuffled(df: DataFrame) -> DataFrame:
    """Mark a side that grows with the data: it is joined by sort and merge, whatever size Spark guesses for it, and never sent to the driver."""
    return df.hint("merge")


def ranked(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """`df` with its place in the whole order, from 1: rows are sorted in ranges and each range starts after the rows of those before, so no task holds all of them. `order` must be total."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    counts = {r[0]: r[1] for r in ranged.groupBy("_part").count().collect()}  # one row per task
    start, at = F.lit(0), 0
    for p in sorted(counts):
        start, at = F.when(F.col("_part") == p, at).otherwise(start), at + counts[p]
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn(name, (start + within).cast("bigint")).drop("_part")
