"""Filling containers of fixed capacity: pattern packing by non-negative least squares.

Sizes are binned upwards, the histogram of the bins is all the driver sees. Patterns of few documents that fill a container are generated as columns, each
the best fill for what the columns before leave; their repeat counts are fitted to the histogram by non-negative least squares and rounded, and what is left is
packed by further full patterns and best fit first, on the histogram too. Every text then finds its place by its rank within its bin, so assignment is
a lookup, whatever the number of texts.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.session import cut

BINS = 512


@lru_cache(maxsize=4)
def encoder(folder: str, name: str = "byte_bpe_50k.tiktoken"):
    """The public byte-level BPE tokenizer whose rank file lies in `folder`."""
    import tiktoken

    # Fixed value: the published splitting pattern of this tokenizer.
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, key: str, text: str, folder: str) -> DataFrame:
    """(key, tokens) of whole texts. Null and empty texts have 0 tokens; null keys are left out."""

    @F.pandas_udf("int")
    def count(s: pd.Series) -> pd.Series:
        e = encoder(folder)
        return s.map(lambda t: len(e.encode_ordinary(t)) if t else 0)

    return docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), count(F.coalesce(text, F.lit(""))).alias("tokens"))


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """(key, piece, start, size): a text over the capacity in full pieces and a rest, any other as it is; empty texts have no piece."""
    n = F.ceil(F.col("tokens") / capacity).cast("int")
    rows = sizes.where("tokens > 0").select("key", "tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    start = F.col("piece") * capacity
    return rows.select("key", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("tokens") - start).cast("int").alias("size"))


def nnls(columns: np.ndarray, target: np.ndarray, start: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Counts x >= 0 that bring the sum of `columns` (patterns x bins) closest to `target` by weighted least squares, by accelerated projected gradient from `start`. Residuals weigh as shares of their bin."""
    a = columns / np.sqrt(1.0 + target)
    goal = target / np.sqrt(1.0 + target)
    v, norm = np.ones(len(a)), 1.0
    for _ in range(30):  # greatest eigenvalue, for the step
        v = a @ (v @ a)
        norm = np.linalg.norm(v) or 1.0
        v /= norm
    x, y, t = start, start, 1.0
    for _ in range(rounds):
        nxt = np.maximum(0.0, y - (a @ (y @ a - goal)) / norm)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = nxt + (t - 1) / s * (nxt - x), nxt, s
    return x


def knapsack(value: np.ndarray, most: np.ndarray, bins: int) -> np.ndarray | None:
    """Uses of each size (index) of the pattern of greatest value that fills `bins`, or as nearly as at all possible, with at most `most` of each size; None if nothing fits."""
    items = []
    for s in np.flatnonzero(most):
        rest, k = min(int(most[s]), bins // max(1, int(s))), 1
        while s and rest > 0:  # powers of two, and what is left of them
            items.append((int(s), min(k, rest)))
            rest, k = rest - k, 2 * k
    best = np.full(bins + 1, -np.inf)
    best[0] = 0.0
    taken = np.zeros((len(items), bins + 1), bool)
    for k, (s, m) in enumerate(items):
        w = s * m
        with_it = best[: bins + 1 - w] + value[s] * m
        better = with_it > best[w:]
        taken[k, w:] = better
        best[w:] = np.where(better, with_it, best[w:])
    full = int(np.flatnonzero(best > -np.inf)[-1])
    if full == 0:
        return None
    uses, room = np.zeros(bins + 1, np.int64), full
    for k in range(len(items) - 1, -1, -1):
        if taken[k, room]:
            uses[items[k][0]] += items[k][1]
            room -= items[k][0] * items[k][1]
    return uses


#: Patterns that are generated for the fit, and further ones for what rounding leaves.
COLUMNS, MORE = 256, 1024


def generate(histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(patterns x bins, first counts): columns for the fit, each the full pattern that takes most of the sizes whose residual is relatively largest.

    A pattern holds a size at most twice as often as an average container does. Each is counted so often that no size is used up beyond its histogram, and no more than twice a fair share of the containers.
    """
    bins = len(histogram) - 1
    size = np.arange(bins + 1)
    containers = max(1.0, float((histogram * size).sum()) / bins)
    rest = histogram.astype(float)
    found, counts = [], []
    for _ in range(COLUMNS):
        most = np.minimum(np.ceil(2 * histogram / containers), np.floor(rest)).astype(np.int64)
        uses = knapsack(size * rest / np.maximum(histogram, 1), most, bins)
        if uses is None or (uses * size).sum() < bins:
            break
        at = uses > 0
        n = min(float((rest[at] / uses[at]).min()), max(1.0, 2 * containers / COLUMNS))
        found.append(uses)
        counts.append(n)
        rest = np.maximum(0.0, rest - n * uses)
    return np.array(found).reshape(len(found), bins + 1), np.array(counts)


def plan(histogram: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """((pattern, repeats) that use up the histogram exactly, how many of them are fitted ones, which come first); index = bin size, the last is the capacity.

    Fitted counts are rounded and never go beyond what is left. The residual is packed by further full patterns while there are any, then greatest size first, each into the open pattern with the least room
    that takes it, with as many repeats at a time as both sides allow.
    """
    bins = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    found: list[tuple[tuple[int, ...], int]] = []
    if left.sum() == 0:
        return found, 0

    def place(uses: np.ndarray, n: int) -> None:
        at = uses > 0
        n = min(n, int((left[at] // uses[at]).min()))
        if n > 0:
            found.append((tuple(np.repeat(np.arange(bins + 1), uses).tolist()), n))
            left[:] -= n * uses

    columns, first = generate(histogram)
    if len(columns):
        fitted = nnls(columns.astype(float), histogram.astype(float), first)
        for k in np.argsort(-fitted, kind="stable"):
            place(columns[k], int(round(fitted[k])))
    split, size = len(found), np.arange(bins + 1)
    for _ in range(MORE):
        uses = knapsack(size * (left / np.maximum(histogram, 1) + size / bins), left, bins)
        if uses is None or (uses * size).sum() < bins:
            break
        place(uses, int(left.max()))
    opened: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # room -> patterns with that room
    for s in range(bins, 0, -1):
        n = int(left[s])
        for room in sorted(r for r in opened if r >= s):
            while n and opened.get(room):
                p, m = opened[room].pop()
                fit = min(room // s, n) if room else 0
                if fit == 0:
                    opened[room].append((p, m))
                    break
                take = min(m, n // fit)
                if take < m:
                    opened[room].append((p, m - take))
                opened.setdefault(room - s * fit, []).append(((*p, *[s] * fit), take))
                n -= take * fit
            if not opened.get(room):
                opened.pop(room, None)
            if not n:
                break
        fit = bins // s
        if n // fit:
            opened.setdefault(bins - s * fit, []).append(((s,) * fit, n // fit))
        if n % fit:
            opened.setdefault(bins - s * (n % fit), []).append(((s,) * (n % fit), 1))
    found += [x for ps in opened.values() for x in ps]
    return found, split


def slots(found: list[tuple[tuple[int, ...], int]], bins: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """size -> (first rank, first container, places per container) of each run of places, in rank order."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    rank = [0] * (bins + 1)
    container = 0
    for p, n in found:
        for s in sorted(set(p)):
            k = p.count(s)
            runs.setdefault(s, []).append((rank[s], container, k))
            rank[s] += k * n
        container += n
    return {s: tuple(np.array(x, np.int64) for x in zip(*r)) for s, r in runs.items()}


def pack(sizes: DataFrame, capacity: int = 2048) -> DataFrame:
    """(key, piece, start, size, container, fitted): every piece of every text in one container of `capacity` tokens, and whether that is one of a fitted pattern.

    `sizes`: key, tokens, one row per text. Texts of 0 tokens are left out; a text is split only if it alone exceeds the capacity; nothing is cut or dropped.
    Ranks within a bin come from counts per slice of rows, so a bin that holds a third of all texts is no single task. The
    driver holds the histogram of at most BINS bins and the patterns that use it up.
    """
    bins = min(BINS, capacity)
    rows = pieces(sizes, capacity).withColumn("bin", F.ceil(F.col("size") * bins / capacity).cast("int"))
    slices = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    rows = cut(rows.withColumn("slice", F.pmod(F.xxhash64("key", "piece"), F.lit(slices))))
    counts = cut(rows.groupBy("bin", "slice").agg(F.count("*").alias("n")))
    histogram = np.zeros(bins + 1, np.int64)
    for b, n in counts.groupBy("bin").agg(F.sum("n")).collect():
        histogram[b] = n
    found, split = plan(histogram)
    fitted = sum(n for _, n in found[:split])  # containers are numbered in the order of the plan
    places = sizes.sparkSession.sparkContext.broadcast(slots(found, bins))
    before = Window.partitionBy("bin").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select("bin", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # `slices` rows per bin
    within = F.row_number().over(Window.partitionBy("bin", "slice").orderBy("key", "piece")) - 1
    ranked = rows.withColumn("within", within).join(offset, ["bin", "slice"]).withColumn("rank", F.col("offset") + F.col("within"))

    @F.pandas_udf("bigint")
    def container(bin_: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(bin_), np.int64)
        b, r = bin_.to_numpy(), rank.to_numpy()
        for s in np.unique(b):
            at = b == s
            first, start, k = places.value[int(s)]
            run = np.searchsorted(first, r[at], side="right") - 1
            out[at] = start[run] + (r[at] - first[run]) // k[run]
        return pd.Series(out)

    return ranked.select("key", "piece", "start", "size", container("bin", "rank").alias("container")).withColumn("fitted", F.col("container") < fitted)


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: pieces, containers, tokens, the fullest container, the share of the containers' room that is used, and the share of the pieces that stand in fitted patterns."""
    per = packed.groupBy("container").agg(F.sum("size").alias("used"), F.count("*").alias("n"), F.max("fitted").alias("fitted"))
    share = F.sum(F.when(F.col("fitted"), F.col("n")).otherwise(0)) / F.sum("n")
    return per.agg(F.sum("n").alias("pieces"), F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), (F.sum("used") / (F.count("*") * F.lit(capacity))).alias("used_share"), share.alias("fitted_share"))
