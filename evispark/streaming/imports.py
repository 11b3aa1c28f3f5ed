"""Incremental import: occurrences arrive as files, are resolved against the registry and upserted per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from evispark.operators.registry import lookup


def arrivals(spark: SparkSession, path: str, schema: StructType, per_batch: int = 100) -> DataFrame:
    """A stream over the parquet files that land in `path`."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def resolve(rows: DataFrame, elements: DataFrame) -> DataFrame:
    """Fill missing element ids by exact or alias match in the same facet; others stay as they are."""
    found = lookup(rows.withColumnRenamed("element_id", "given"), elements)
    return found.withColumn("element_id", F.coalesce("given", "element_id")).drop("given")


def run(stream: DataFrame, elements: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write each resolved batch once under its own number: a batch that runs again after a loss replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        resolve(batch, elements).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(stream: DataFrame, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Load sessions of a stream: loads with gaps of at most `gap`, closed once the watermark has passed."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
