"""Items that appear together: basket collapsing.

Each basket (record) is reduced to its sorted array of distinct item codes; identical arrays are grouped into one
row with a weight, pairs are enumerated once per distinct basket, and the weights are summed per pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.session import BROADCAST_ROWS, broadcast_checked, cut


def collapse(rows: DataFrame, basket: str, item: str) -> DataFrame:
    """(items array<int>, weight): the distinct baskets and how many records have each.

    `item` holds integer codes. Repeated rows count once; null baskets and null items are left out.
    The first aggregate deduplicates on the map side, so a basket or an item that holds a third of all rows is
    reduced to at most one row per distinct pair before the shuffle. The array length is bounded by the item list.
    """
    clean = rows.select(F.col(basket).alias("_b"), F.col(item).alias("_i")).where("_b is not null and _i is not null")
    baskets = clean.groupBy("_b").agg(F.sort_array(F.collect_set("_i")).alias("items"))
    return baskets.groupBy("items").agg(F.count("*").alias("weight"))


def cooccurring_pairs(rows: DataFrame, items: DataFrame, basket: str = "basket", item: str = "item", min_pairs: int = 5, min_lift: float = 4.0) -> DataFrame:
    """Pairs of items in at least `min_pairs` common baskets and at least `min_lift` times as often as by chance.

    `rows`: one row per (basket, item) mention, repeats allowed; `items`: the list of valid items (column `item`).
    Result: item_a < item_b, n, n_a, n_b, n_ab, lift, conviction (of a => b; null where it is unbounded).
    n counts the baskets with at least one valid item. An item alone in every basket, an empty table, null keys and
    items outside the list give no rows. A pair whose n_ab * n equals min_lift * n_a * n_b exactly counts.

    Two exact bounds save pairs before they are enumerated: n_ab <= min(n_a, n_b) asks n_a >= min_pairs, and
    n_ab * n >= min_lift * n_a * n_b asks n_a <= n / min_lift.
    """
    codes = items.select(F.col(item).alias("_name")).where("_name is not null").distinct()
    codes = cut(codes.withColumn("_code", F.row_number().over(Window.orderBy("_name"))))  # the item list is small and fixed
    coded = rows.select(F.col(basket).alias("_b"), F.col(item).alias("_name")).join(broadcast_checked(codes), "_name")
    sets = cut(collapse(coded, "_b", "_code"))
    n = sets.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    singles = sets.select(F.explode("items").alias("_code"), "weight").groupBy("_code").agg(F.sum("weight").alias("c"))
    keep = cut(singles.where((F.col("c") >= min_pairs) & (F.col("c") * F.lit(min_lift) <= F.lit(n))).join(codes, "_code"))
    slim = sets
    if keep.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # else the same pairs are dropped after counting
        bounded = [r[0] for r in keep.select("_code").orderBy("_code").collect()]
        slim = sets.withColumn("items", F.array_sort(F.array_intersect("items", F.array(*map(F.lit, bounded)).cast("array<int>"))))
    slim = slim.where("size(items) > 1").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "items")  # few bytes, many pairs
    left = slim.select(F.posexplode("items").alias("_p", "_a"), "items", "weight")
    both = left.select("_a", F.explode(F.expr("slice(items, _p + 2, size(items))")).alias("_b"), "weight")
    both = both.select((F.shiftleft(F.col("_a").cast("long"), 32) + F.col("_b")).alias("_ab"), "weight")
    pairs = both.groupBy("_ab").agg(F.sum("weight").alias("n_ab")).where(F.col("n_ab") >= min_pairs)
    pairs = pairs.select(F.shiftright("_ab", 32).cast("int").alias("_a"), F.expr("_ab & 4294967295").cast("int").alias("_b"), "n_ab")
    a = keep.select(F.col("_code").alias("_a"), F.col("_name").alias("item_a"), F.col("c").alias("n_a"))
    b = keep.select(F.col("_code").alias("_b"), F.col("_name").alias("item_b"), F.col("c").alias("n_b"))
    out = pairs.join(broadcast_checked(a), "_a").join(broadcast_checked(b), "_b")
    out = out.where(F.col("n_ab") * F.lit(n) >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
    lift = F.col("n_ab") * F.lit(n) / (F.col("n_a") * F.col("n_b"))
    conviction = F.when(F.col("n_ab") < F.col("n_a"), (1 - F.col("n_b") / F.lit(n)) / (1 - F.col("n_ab") / F.col("n_a")))
    return out.select("item_a", "item_b", F.lit(n).alias("n"), "n_a", "n_b", "n_ab", lift.alias("lift"), conviction.alias("conviction"))
