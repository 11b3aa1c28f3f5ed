"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str, b: str, most: int = 40) -> DataFrame:
    """(node, component): each node of the edge list with the least node of its component.

    Works on any ordered type. Null ends are left out, self-loops give a component of one, an empty table gives
    no rows. No neighbourhood is ever collected: hubs are handled by aggregate and join. Raises if `most` rounds don't suffice.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = e.select("u").unionAll(e.select(F.col("v").alias("u"))).distinct()
    stars = cut(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(most):
        stars = cut(_small_star(_large_star(stars)))
        state = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == before:
            return nodes.join(stars, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))
        before = state
    raise RuntimeError(f"components did not settle in {most} rounds")
