"""Pairs by blocks: sets are dealt into blocks, each pair of blocks is one task that counts or weighs what their members share by arrays, so that no table of pairs is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.session import broadcast_checked, cut

#: Members of one block, and sums that a task holds at once.
BLOCK, CELLS = 16_384, 1 << 19


def blocked(sets: DataFrame, block: int, upper: bool = False, mine: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides of the grid over `sets` (id and columns), each row with the blocks `i` and `j` of the tasks that need it, of the right side with `_` after all names; with `upper` only those with i <= j. With `mine` (id) the left side has only those of its members, in blocks of their own."""
    s = rows = cut(sets)
    n = m = max(1, -(-s.count() // block))
    if mine is not None:
        rows = cut(s.join(broadcast_checked(mine.select("id").distinct()), "id", "left_semi"))
        m = max(1, -(-rows.count() // block))
    own = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    every = lambda k: F.sequence(F.lit(0), F.lit(k - 1))
    left = rows.withColumn("i", own(m)).withColumn("j", F.explode(F.filter(every(n), lambda b: b >= F.col("i")) if upper else every(n)))
    right = s.withColumn("j", own(n)).withColumn("i", F.explode(F.filter(every(m), lambda b: b <= F.col("j")) if upper else every(m)))
    tasks = n * (n + 1) // 2 if upper else m * n
    parts = min(4 * tasks, 4_096)
    right = right.select(*[F.col(c).alias(f"{c}_") for c in right.columns])  # columns of its own, as both sides stem from one table
    return left.repartition(parts, "i", "j"), right.repartition(parts, "i_", "j_")


class Postings:
    """Members of a block by item: `of(items, rows)` are all (row, member, weight) that share an item."""

    def __init__(self, lists: pd.Series, weights: pd.Series | None = None):
        self.n = len(lists)
        size = lists.map(len).to_numpy(np.int64)
        items = np.concatenate(lists.to_list()).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
        by = np.argsort(items, kind="stable")
        self.items, self.member = items[by], np.repeat(np.arange(self.n), size)[by]
        self.weight = None if weights is None else np.concatenate(weights.to_list())[by]

    def sums(self, rows: np.ndarray, items: np.ndarray, n: int) -> np.ndarray:
        """(n, members): number of common items, or the sum of their weights, of the sets given by `rows` (0 to n - 1) and `items`."""
        lo, hi = np.searchsorted(self.items, items, "left"), np.searchsorted(self.items, items, "right")
        k = hi - lo
        at = np.repeat(lo - np.cumsum(k) + k, k) + np.arange(k.sum())
        cell = np.repeat(rows * self.n, k) + self.member[at]
        got = np.bincount(cell, None if self.weight is None else self.weight[at], n * self.n)
        return got.reshape(n, self.n)


def chunks(lists: pd.Series, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, rows, items) of consecutive members, as many as CELLS sums allow."""
    step = max(1, CELLS // max(1, width))
    for at in range(0, len(lists), step):
        part = lists.iloc[at : at + step]
        size = part.map(len).to_numpy(np.int64)
        yield at, at + len(part), np.repeat(np.arange(len(part)), size), np.concatenate(part.to_list()).astype(np.int64)


def best_pairs(sets: DataFrame, k: int, mine: DataFrame | None = None) -> DataFrame:
    """(me, other, s, shared): for each of `sets` (id string, items array<bigint>, weights array<double>) the k others of the greatest sum of common weights, rounded to 1e-9 and above 0, ties to the larger id. Exact. With `mine` (id) only for those of its members, the others still being all."""

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"me": [], "other": [], "s": [], "shared": []}).astype({"me": object, "other": object, "s": float, "shared": "int64"})
        if not len(left) or not len(right):
            return none
        right = right.rename(columns=lambda c: c.removesuffix("_")).sort_values("id", key=lambda c: c.str.encode("utf-8")).reset_index(drop=True)  # places are in order of id
        names, mine = right["id"].to_numpy(object), left["id"].to_numpy(object)
        place = {x: p for p, x in enumerate(names)}
        p = Postings(right["items"], right["weights"])
        flat, size = np.concatenate(right["items"].to_list()).astype(np.int64), right["items"].map(len).to_numpy(np.int64)
        first = np.cumsum(size) - size
        kinds = np.unique(flat)
        out = []
        for lo, hi, rows, items in chunks(left["items"], p.n):
            got = p.sums(rows, items, hi - lo)
            for r in range(lo, hi):
                if (self := place.get(mine[r])) is not None:
                    got[r - lo, self] = 0
            wide = p.n // (4 * k)
            heads = got[:, : 4 * k * wide].reshape(hi - lo, 4 * k, wide).max(2) if wide else np.zeros((hi - lo, k))
            floor = np.partition(heads, -k, axis=1)[:, -k]  # the k-th of the best of some groups is no more than the k-th of all
            r, c = np.divmod(np.flatnonzero(got >= np.maximum(floor, 1e-9)[:, None] - 2e-9), p.n)
            s = np.rint(got[r, c] * 1e9).astype(np.int64)
            r, c, s = r[s > 0], c[s > 0], s[s > 0]
            by = np.lexsort((-c, -s, r))
            r, c, s = r[by], c[by], s[by]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            r, c, s = r[rank < k], c[rank < k], s[rank < k]
            have = np.isin(items, kinds)
            own = np.sort(rows[have] * len(kinds) + np.searchsorted(kinds, items[have]))
            n = size[c]
            at = np.repeat(first[c] - np.cumsum(n) + n, n) + np.arange(n.sum())
            common = np.isin(np.repeat(r, n) * len(kinds) + np.searchsorted(kinds, flat[at]), own)
            shared = np.bincount(np.repeat(np.arange(len(r)), n), common, len(r)).astype(np.int64)
            out.append(pd.DataFrame({"me": mine[lo + r], "other": names[c], "s": s / 1e9, "shared": shared}))
        return pd.concat(out)

    left, right = blocked(sets, BLOCK, mine=mine)
    near = left.drop("weights").groupBy("i", "j").cogroup(right.groupBy("i_", "j_")).applyInPandas(best, "me string, other string, s double, shared bigint")
    rank = F.row_number().over(Window.partitionBy("me").orderBy(F.desc("s"), F.desc("other")))
    return near.withColumn("r", rank).where(F.col("r") <= k).drop("r")


#: Members of one block where every pair may be a result.
DENSE_BLOCK = 2_048


def overlapping(sets: DataFrame, fields: list[str], least: float) -> DataFrame:
    """(a, b, best) with a < b over `sets` (id bigint; of each field its items, array<bigint>): pairs that share at least `least` of the smaller set of a field, with the greatest such share, six digits. Exact; pairs go from the task that finds them straight to the result."""

    def pairs(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b, best = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(left) and len(right):
            right = right.rename(columns=lambda c: c.removesuffix("_"))
            x, y = left["id"].to_numpy(np.int64), right["id"].to_numpy(np.int64)
            inner = left["i"].iloc[0] == left["j"].iloc[0]
            p = [Postings(right[f]) for f in fields]
            size = [(left[f].map(len).to_numpy(np.int64), right[f].map(len).to_numpy(np.int64)) for f in fields]
            step = max(1, CELLS // len(right))
            for lo in range(0, len(left), step):
                n = min(step, len(left) - lo)
                top = np.zeros(n * len(right))
                for f, post, (nx, ny) in zip(fields, p, size):
                    rows, items = np.repeat(np.arange(n), nx[lo : lo + n]), np.concatenate(left[f].iloc[lo : lo + n].to_list()).astype(np.int64)
                    got = post.sums(rows, items, n).ravel()
                    at = np.flatnonzero(got)
                    smaller = np.minimum(nx[lo + at // len(right)], ny[at % len(right)])
                    ok = got[at] >= least * smaller - 1e-9
                    at = at[ok]
                    top[at] = np.maximum(top[at], got[at] / smaller[ok])
                at = np.flatnonzero(top)
                one, other = x[lo + at // len(right)], y[at % len(right)]
                keep = one < other if inner else slice(None)
                a.append(np.minimum(one, other)[keep])
                b.append(np.maximum(one, other)[keep])
                best.append(np.floor(top[at][keep] * 1e6 + 0.5) / 1e6)
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "best": np.concatenate(best)})

    left, right = blocked(sets, DENSE_BLOCK, upper=True)
    return left.groupBy("i", "j").cogroup(right.groupBy("i_", "j_")).applyInPandas(pairs, "a bigint, b bigint, best double")
