"""Reading the project's tables and settling repeated deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], load_col: str, columns: list[str] | None = None) -> DataFrame:
    """One row per key: that of the latest load, ties broken by the row's content.

    Rows with a null key are kept as one group of their own. The aggregate combines on the map side,
    so a key that is delivered very often costs no large group.
    """
    cols = [c for c in (columns or df.columns) if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in cols])
    rank = F.struct(F.col(f"`{load_col}`"), F.xxhash64(*[F.col(f"`{c}`") for c in cols]) if cols else F.lit(0))
    picked = df.groupBy(*keys).agg(F.max_by(row, rank).alias("_row"))
    return picked.select(*keys, *[F.col("_row").getField(c).alias(c) for c in cols])
