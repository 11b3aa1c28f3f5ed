"""All similar pairs between set-valued records: sorted sketch forests.

Every distinct set gets a minhash signature per tree. In each tree the signatures are ordered lexicographically and
sets that share a common prefix are neighbours; a crowded prefix is deepened by the next minhash of the tree. The number
of trees follows from the target recall at the threshold and the starting depth. Every candidate is verified exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evispark.keys import norm_key
from evispark.llm.common import pairs_of
from evispark.session import cut, shuffled

PRIME = np.uint64((1 << 61) - 1)


def trees_for(threshold: float, depth: int, recall: float) -> int:
    """Trees needed so that a pair at `threshold` shares a prefix of `depth` in one of them with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


def tag_sets(df: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """(key, tags): the sorted distinct norm_key values of the arrays together. Null arrays count as empty; null and blank values are dropped."""
    parts = [F.coalesce(F.col(f"`{a}`"), F.array().cast("array<string>")) for a in arrays]
    tags = F.transform(F.concat(*parts), lambda x: norm_key(x))
    return df.select(F.col(f"`{key}`").alias(key), F.array_sort(F.array_distinct(F.filter(tags, lambda x: x.isNotNull() & (x != "")))).alias("tags"))


def _signer(trees: int, depth: int, seed: int = 11):
    """Pandas function: array<long> tag hashes -> array<int> of trees*depth minhashes."""
    rng = np.random.default_rng(seed)
    a = (rng.integers(1, 1 << 31, trees * depth, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    b = rng.integers(0, 1 << 62, trees * depth, dtype=np.uint64)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def sign(hashes: pd.Series) -> pd.Series:
        out = []
        for start in range(0, len(hashes), 512):
            part = hashes.iloc[start : start + 512]
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            flat = np.concatenate(part.to_list()).astype(np.int64).view(np.uint64)
            mixed = flat ^ (flat >> np.uint64(29))
            grid = mixed[None, :] * a[:, None] + b[:, None]
            grid ^= grid >> np.uint64(32)
            grid *= np.uint64(0x9E3779B97F4A7C15)
            mins = np.minimum.reduceat(grid >> np.uint64(33), np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=1)
            out.extend(mins.T.astype(np.int32))
        return pd.Series(out)

    return sign


def similar_classes(sets: DataFrame, key: str, threshold: float = 0.6, recall: float = 0.999, depth: int = 4, crowd: int = 64, levels: int = 4) -> tuple[DataFrame, DataFrame]:
    """(membership, links) of the records in `sets` (key, tags: sorted distinct values, at least one each).

    membership: key, cls - records with equal sets share a class, whose id is a hash of the set.
    links: cls_a < cls_b, shared, total - the pairs of different sets with shared >= threshold * total.
    Copies thus never meet each other in a join; any number of equal records costs one class. Null or empty sets have
    no class. Prefix groups of more than `crowd` sets are deepened up to `levels` times; as deepening can part similar sets, the
    sets of crowded groups are also joined exactly by rare-first prefixes of the sets themselves, so that no partner is dropped.
    """
    trees, full = trees_for(threshold, depth, recall), depth + levels
    sets = sets.where("size(tags) > 0").select(F.col(f"`{key}`").alias(key), "tags")
    classed = sets.withColumn("cls", F.xxhash64(F.array_join("tags", "\x1f")))
    classes = cut(classed.groupBy("cls").agg(F.min("tags").alias("tags")))
    hashed = classes.select("cls", F.transform("tags", lambda t: F.xxhash64(t)).alias("h"))
    signed = hashed.select("cls", _signer(trees, full)("h").alias("s"))
    slices = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.slice("s", t * full + 1, full).alias("s")))
    rows = signed.select("cls", F.explode(slices).alias("x")).select("cls", "x.tree", "x.s")
    found, crowded = [], cut(rows)
    for level in range(levels + 1):
        at = crowded.withColumn("p", F.xxhash64("tree", F.slice("s", 1, depth + level)))
        sizes = at.groupBy("p").agg(F.count("*").alias("n"))
        mates = sizes.where(F.col("n") > 1)
        at = at.join(shuffled(mates), "p")
        small = at.where(F.col("n") <= crowd).groupBy("p").agg(F.sort_array(F.collect_set("cls")).alias("c"))  # at most `crowd` ids
        found.append(small.select(F.explode(F.expr(pairs_of("c"))).alias("q")).select("q.x", "q.y"))
        crowded = cut(at.where(F.col("n") > crowd).drop("p", "n"))
        if level == 0 and not crowded.isEmpty():  # what deepening parts may still be similar: exactly, among these sets only
            found.append(_prefix_pairs(classes.join(shuffled(crowded.select("cls").distinct()), "cls"), threshold))
        if crowded.isEmpty():
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionAll(more)
    pairs = pairs.groupBy("x", "y").agg(F.lit(1).alias("_"))
    a = classes.select(F.col("cls").alias("x"), F.col("tags").alias("ta"))
    b = classes.select(F.col("cls").alias("y"), F.col("tags").alias("tb"))
    joined = pairs.join(shuffled(a), "x").join(shuffled(b), "y")
    shared = F.size(F.array_intersect("ta", "tb"))
    links = joined.withColumn("shared", shared).withColumn("total", F.size("ta") + F.size("tb") - F.col("shared"))
    links = links.where(F.col("shared") >= F.lit(threshold) * F.col("total"))
    return classed.select(key, "cls"), links.select(F.col("x").alias("cls_a"), F.col("y").alias("cls_b"), "shared", "total")


def _prefix_pairs(classes: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs (x < y) among distinct sets: each pair at the threshold shares one of the rarest values of both.

    Exact. Values are ordered by frequency; a set of n values is listed under its n - ceil(threshold * n) + 1 rarest.
    """
    tokens = classes.select("cls", F.explode("tags").alias("t"), F.size("tags").alias("n"))
    freq = tokens.groupBy("t").agg(F.count("*").alias("f"))
    ranked = tokens.join(shuffled(freq), "t").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("o"))
    keep = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    listed = ranked.select("cls", "n", F.explode(F.slice("o", 1, keep)).alias("e")).select("cls", "n", F.col("e.t").alias("t"))
    a, b = listed.toDF("x", "nx", "t"), listed.toDF("y", "ny", "t")
    near = (F.col("x") < F.col("y")) & (F.col("nx") >= F.col("ny") * threshold - 1e-9) & (F.col("ny") >= F.col("nx") * threshold - 1e-9)
    return a.join(shuffled(b), "t").where(near).select("x", "y")


def expand(membership: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Record pairs (a < b as strings) of the links and of equal sets."""
    m = membership.select(F.col(key).alias("k"), "cls")
    across = links.join(shuffled(m.toDF("ka", "cls_a")), "cls_a").join(shuffled(m.toDF("kb", "cls_b")), "cls_b").select("ka", "kb")
    within = m.toDF("ka", "cls").join(shuffled(m.toDF("kb", "cls")), "cls").where("ka < kb").select("ka", "kb")
    both = across.unionAll(within)
    return both.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).where("a < b").distinct()
