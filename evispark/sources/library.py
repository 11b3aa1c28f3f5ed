"""Library documents and logs: tolerant JSON scans, append logs, versioned index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def scan(spark: SparkSession, pattern: str, schema: StructType) -> DataFrame:
    """One row per JSON document under `pattern`, with `path` and `dir`; broken documents and documents that are no object are left out.

    `paper_id` is the document's own, else the folder's name.
    """
    with_bad = StructType([*schema.fields, StructField("_bad", StringType())])
    df = spark.read.schema(with_bad).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(pattern)
    df = df.withColumn("path", F.col("_metadata.file_path")).withColumn("dir", F.regexp_extract("path", "([^/]+)/[^/]+$", 1))
    df = df.select(F.struct(*df.columns).alias("_d")).where("_d._bad is null").select("_d.*").drop("_bad")  # as a whole: the reader refuses a query of the broken column alone
    return df.withColumn("paper_id", F.coalesce("paper_id", "dir")) if "paper_id" in schema.fieldNames() else df.withColumn("paper_id", F.col("dir"))


def append_log(rows: DataFrame, path: str) -> None:
    """Append rows to a JSON-lines log."""
    rows.write.mode("append").json(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a table as a whole: written beside under a new version, then named in `_current`. Readers see the old version or the new one."""
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = [int(s.getPath().getName()[1:]) for s in (fs.listStatus(fs_path) if fs.exists(fs_path) else []) if s.getPath().getName().startswith("v")]
    version = max(versions, default=0) + 1
    df.write.parquet(f"{path}/v{version}")
    spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("overwrite").json(f"{path}/_current")
    for old in sorted(versions)[:-1]:  # the version before stays for readers that have it open
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{old}"), True)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The version of a replaced table that `_current` names."""
    version = spark.read.schema("version int").json(f"{path}/_current").first()[0]
    return spark.read.parquet(f"{path}/v{version}")
