"""Bibliographic text records: tag-line citation files in two dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TAG = r"^([A-Z][A-Z0-9])  - ?(.*)$"


def read_records(spark: SparkSession, path: str, flush_on_type: bool = False) -> DataFrame:
    """(file, record, title, doi, year, journal, authors, url, pii) of the tag-line files under `path`.

    A record starts with TY and ends with ER. With `flush_on_type` (the pool dialect) a new TY or the end of the file ends it too; without, a record
    that has no ER is left out. Lines without a tag continue the tag before. Repeated AU lines are kept in order; year is the first four digits of PY or Y1; a DOI comes
    from DO. Files are independent, and each file's lines are numbered in order, so its records never mix with another's.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    w = Window.partitionBy("file").orderBy("pos")  # one file's lines
    tag = F.regexp_extract("line", TAG, 1)
    rows = text.withColumn("tag", F.when(tag != "", tag)).withColumn("value", F.when(tag != "", F.trim(F.regexp_extract("line", TAG, 2))).otherwise(F.trim("line")))
    rows = rows.withColumn("record", F.sum((F.col("tag") == "TY").cast("int")).over(w)).withColumn("ended", F.sum((F.col("tag") == "ER").cast("int")).over(w)).where("record > 0")
    rows = rows.withColumn("n", F.count("tag").over(w)).withColumn("open", F.coalesce(F.col("ended"), F.lit(0)))
    tagged = rows.groupBy("file", "record", "n").agg(F.max("tag").alias("tag"), F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]), " ")).alias("value"), F.min("pos").alias("pos"))  # the lines of one tag
    closed = F.max((F.col("tag") == "ER").cast("int")).over(Window.partitionBy("file", "record"))
    kept = tagged.withColumn("closed", closed)
    kept = kept if flush_on_type else kept.where("closed = 1")
    after = F.max(F.when(F.col("tag") == "ER", F.col("pos"))).over(Window.partitionBy("file", "record"))
    kept = kept.withColumn("er", after).where("er is null or pos <= er")
    first = lambda *tags: F.coalesce(*[F.min_by("value", F.when((F.col("tag") == t) & (F.col("value") != ""), F.col("pos"))) for t in tags])
    authors = F.transform(F.array_sort(F.collect_list(F.when(F.col("tag").isin("AU", "A1") & (F.col("value") != ""), F.struct("pos", "value")))), lambda x: x["value"])
    out = kept.groupBy("file", "record").agg(
        first("TI", "T1").alias("title"), first("DO").alias("doi"), F.regexp_extract(F.coalesce(first("PY", "Y1"), F.lit("")), "([0-9]{4})", 1).alias("year"),
        first("JO", "T2", "JF", "JA").alias("journal"), authors.alias("authors"), first("UR", "L1").alias("url"))
    return out.withColumn("pii", F.nullif(F.regexp_extract(F.coalesce("url", F.lit("")), "pii/([A-Z0-9]+)", 1), F.lit("")))
