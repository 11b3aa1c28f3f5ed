"""Core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.operators import units
from evispark.plans import block_queries, connect_queries, evidence_queries, graph_queries, index_queries, map_queries, more_queries, pool_queries, registry_queries, text_queries
from evispark.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each stated value of a listed quantity in its common unit; entities are elements."""
    occ = table(spark, sf, "occurrences").select("occ_id", "element_id", "quote", "values_json")
    found = units.harmonise(occ, table(spark, sf, "unit_targets"), "occ_id", "element_id", "quote", "values_json")
    text = found.select(F.col("key").alias("occ_id"), "quantity", units.exponent_text("lo").alias("lo"), units.exponent_text("hi").alias("hi"))
    return text.distinct()


def p4_conversions(spark: SparkSession, sf: str) -> DataFrame:
    """Each spelling with its conversion, how it was settled (common, confirmed, known, snapped, refused) and the values stated in it."""
    occ = table(spark, sf, "occurrences").select("occ_id", "element_id", "quote", "values_json")
    rows, found = units.conversions_of(occ, table(spark, sf, "unit_targets"), "occ_id", "element_id", "quote", "values_json")
    c = spark.createDataFrame([(u, *x) for u, x in sorted(found.items())], "unit string, quantity string, scale double, shift double, how string")
    return rows.groupBy("unit").agg(F.count("*").alias("stated")).join(F.broadcast(c), "unit")  # at most MAX_SPELLINGS rows


_MODULES = [block_queries, connect_queries, evidence_queries, index_queries, graph_queries, map_queries, pool_queries, text_queries, more_queries, registry_queries]
QUERIES: dict[str, Query] = {"p4_found": p4_found, "p4_conversions": p4_conversions}
SQL: dict[str, str] = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
