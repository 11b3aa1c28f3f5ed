"""Similarity graph over papers: inverse-frequency weights, top-k edges, degrees, neighbours, label propagation, naming."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.operators.components import connected_components
from evispark.session import cut, shuffled


def idf(features: DataFrame, n_papers: int) -> DataFrame:
    """(element_id, df, idf) with idf = ln(N / df); N counts papers without features too."""
    df = features.groupBy("element_id").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log(F.lit(float(n_papers)) / F.col("df")))


def pair_scores(features: DataFrame, weights: DataFrame, n_papers: int, cap: float = 0.3, capped: bool = True) -> DataFrame:
    """(a, b, score, shared) with a < b: sum of the weights of the common elements, rounded to 1e-9.

    Elements in more than max(5, N * cap) papers are left out where capped: they tell papers apart least and their pairs would be most.
    """
    w = weights.where(F.col("df") <= max(5, int(n_papers * cap))) if capped and cap < 1 else weights
    return pair_sums(features.join(w.select("element_id", "idf"), "element_id"))


#: Papers of one element in one slice of its pair join.
SLICE = 2_000


def pair_sums(f: DataFrame, sides: DataFrame | None = None) -> DataFrame:
    """(a, b, score, shared) with a < b over features (paper_id, element_id, idf). An element of many papers is cut into slices, and each pair of slices is a task of its own.

    With `sides` (paper_id) only pairs with one of these papers are formed.
    """
    parts = F.ceil(F.count("*") / SLICE).cast("int")
    n = f.groupBy("element_id").agg(parts.alias("parts"))
    g = f.join(n, "element_id").withColumn("slice", F.pmod(F.xxhash64("paper_id"), F.col("parts")).cast("int"))
    mine = g if sides is None else g.join(sides, "paper_id", "left_semi")
    x = mine.select(F.col("paper_id").alias("x"), "element_id", "idf", F.col("slice").alias("sx"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("sy"))
    y = g.select(F.col("paper_id").alias("y"), "element_id", F.col("slice").alias("sy"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("sx"))
    j = x.join(y, ["element_id", "sx", "sy"])
    j = j.where("x < y") if sides is None else j.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "element_id", "idf").dropDuplicates(["x", "y", "element_id"])
    return j.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.round(F.sum("idf"), 9).alias("score"), F.count("*").alias("shared"))


#: Elements up to which a paper is looked up by its subsets; pairs with a wider one are formed element by element, with the same scores.
NARROW = 10


def nearest(f: DataFrame, asks: DataFrame, k: int, others: DataFrame | None = None) -> DataFrame:
    """(me, other, score): the k papers nearest to each of `asks` (paper_id) over features (paper_id, element_id, idf), ties to the least id, never itself; only of `others` (paper_id) if given. Exact, without the pairs of frequent elements.

    What a paper shares with another is a subset of its own elements. Of the papers that hold a subset the k + 1 of least id are kept: a paper missing there has k before it that share no less, so none of the k nearest is missing
    in the list of what it shares. A weight below zero (an element of more papers than are counted) would break that, so lists are kept apart by the set of such elements.
    """
    own = f.groupBy("paper_id").agg(F.array_sort(F.collect_set(F.struct("element_id", "idf"))).alias("all"))  # the elements of one paper
    own = cut(own.select("paper_id", F.filter("all", lambda e: e["idf"] >= 0).alias("es"), F.filter("all", lambda e: e["idf"] < 0).alias("neg")).withColumn("wide", F.size("es") > NARROW))
    total = lambda es: F.aggregate(es, F.lit(0.0), lambda t, e: t + e["idf"])

    def subsets(d: DataFrame) -> DataFrame:
        masks = F.expr("sequence(0, shiftleft(1, size(es)) - 1)")
        every = F.transform(masks, lambda m: F.filter("es", lambda e, i: F.getbit(m, i) == 1))
        x = d.where("not wide").select("paper_id", "neg", F.explode(every).alias("x")).where("size(x) > 0 or size(neg) > 0")
        return x.select("paper_id", "neg", F.transform("x", lambda e: e["element_id"]).alias("part"), total("x").alias("w"))

    mine = own.join(asks.select("paper_id").distinct(), "paper_id", "left_semi")
    pool = own if others is None else own.join(others.select("paper_id").distinct(), "paper_id", "left_semi")
    asked = subsets(mine).select(F.col("paper_id").alias("me"), F.col("neg").alias("mine"), "part", "w")
    first = F.row_number().over(Window.partitionBy("part", "neg").orderBy("paper_id"))
    held = subsets(pool).join(asked.select("part").distinct(), "part", "left_semi").withColumn("r", first).where(F.col("r") <= k + 1).select("part", "neg", F.col("paper_id").alias("other"))
    both = F.array_intersect("mine", "neg")
    found = asked.join(held, "part").where((F.col("me") != F.col("other")) & ((F.size("part") > 0) | (F.size(both) > 0))).groupBy("me", "other").agg(F.max(F.round(F.col("w") + total(both), 9)).alias("score"))
    if not own.where("wide").isEmpty():
        one = lambda d: d.select("paper_id", "wide", F.explode(F.concat("es", "neg")).alias("e")).select("paper_id", "wide", "e.element_id", "e.idf")
        x, y = one(mine).toDF("me", "wx", "element_id", "idf"), one(pool).drop("idf").toDF("other", "wy", "element_id")
        found = found.unionByName(x.join(y, "element_id").where("(wx or wy) and me <> other").groupBy("me", "other").agg(F.round(F.sum("idf"), 9).alias("score")))
    rank = F.row_number().over(Window.partitionBy("me").orderBy(F.desc("score"), "other"))
    return found.withColumn("r", rank).where(F.col("r") <= k).select("me", "other", "score")


def top_edges(scores: DataFrame, k: int = 8, least: float = 0.0) -> DataFrame:
    """Edges that are among the k best of either end; ties go to the smaller pair."""
    s = scores.where(F.col("score") > least)
    ends = s.select("a", "b", "score", "shared", F.explode(F.array("a", "b")).alias("node"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "a", "b"))
    return ends.withColumn("r", rank).where(F.col("r") <= k).select("a", "b", "score", "shared").distinct()


def best_edges(features: DataFrame, weights: DataFrame, n_papers: int, k: int = 8, least: float = 0.0, cap: float = 0.3) -> DataFrame:
    """(a, b, score, shared): the rows of `top_edges` over `pair_scores`, without its pairs: the k best of each paper by lists of common subsets, what they share counted for those only."""
    w = weights.where(F.col("df") <= max(5, int(n_papers * cap))) if cap < 1 else weights
    f = cut(features.join(w.select("element_id", "idf"), "element_id"))
    near = nearest(f, f.select("paper_id"), k).where(F.col("score") > least)
    e = cut(near.groupBy(F.least("me", "other").alias("a"), F.greatest("me", "other").alias("b")).agg(F.max("score").alias("score")))
    ends = [f.select(F.col("paper_id").alias(end), "element_id") for end in "ab"]
    shared = e.join(shuffled(ends[0]), "a").join(shuffled(ends[1]), ["b", "element_id"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    return e.join(shared, ["a", "b"]).select("a", "b", "score", "shared")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(paper_id, degree, weight) of every node, 0 where it has no edge."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("paper_id"), "score")
    d = ends.groupBy("paper_id").agg(F.count("*").alias("degree"), F.round(F.sum("score"), 6).alias("weight"))
    return nodes.join(d, "paper_id", "left").select("paper_id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


def neighbours(features: DataFrame, weights: DataFrame, focus: DataFrame, k: int = 10, names: DataFrame | None = None) -> DataFrame:
    """The k papers nearest to each paper of `focus` (paper_id, a counted few): score (three digits), shared elements, and with `names` (element_id, display_name) the names of the three rarest shared ones."""
    mine = features.join(F.broadcast(focus), "paper_id", "left_semi").join(weights.select("element_id", "idf"), "element_id").select(F.col("paper_id").alias("focus"), "element_id", "idf")
    j = features.join(F.broadcast(mine), "element_id").where("paper_id <> focus")  # the elements of a few papers
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.round("idf", 9)).alias("w"), "element_id"))), 1, 3)
    s = j.groupBy("focus", "paper_id").agg(F.round(F.sum("idf"), 9).alias("raw"), F.count("*").alias("shared"), best.alias("best"))  # the elements of one paper
    s = s.where("raw > 0").withColumn("rank", F.row_number().over(Window.partitionBy("focus").orderBy(F.desc("raw"), "paper_id"))).where(F.col("rank") <= k)
    s = s.select("focus", "paper_id", F.round("raw", 3).alias("score"), "shared", "rank", "best")
    if names is None:
        return s.drop("best")
    e = s.select("focus", "paper_id", F.posexplode("best").alias("at", "b")).join(element_names(names), F.col("b.element_id") == F.col("element_id"), "left")
    shown = F.coalesce("display_name", F.substring_index("b.element_id", "/", -1))
    e = e.groupBy("focus", "paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", shown.alias("n")))), lambda x: x["n"]), " · ").alias("names"))
    return s.drop("best").join(e, ["focus", "paper_id"])


def element_names(elements: DataFrame) -> DataFrame:
    """(element_id, display_name), one row per id; a blank name is the last part of the id."""
    return elements.groupBy("element_id").agg(F.max("display_name").alias("n")).select("element_id", F.coalesce(F.nullif(F.trim("n"), F.lit("")), F.substring_index("element_id", "/", -1)).alias("display_name"))


#: Nodes up to which a group is swept in one task, as arrays of numbers; larger ones are swept by rounds over the whole table, with the same result.
ONE_TASK = 200_000


def label_propagation(edges: DataFrame, nodes: DataFrame, sweeps: int = 20, largest: int = ONE_TASK, by: str | None = None) -> DataFrame:
    """(paper_id, label): asynchronous weighted label propagation in node order, ties to the smallest label, at most `sweeps` sweeps. Nodes without an edge keep their own.

    Components don't act on each other, so each is swept on its own and the result is that of one sweep over all. With `by`, edges carry a column that keeps
    groups apart; the result has it too, and components are not looked for.
    """
    if by is None:
        comp = connected_components(edges, "a", "b")
        e = edges.join(comp.select(F.col("node").alias("a"), F.col("component").alias("_g")), "a").select("_g", "a", "b", "score")
    else:
        e = edges.select(F.col(by).alias("_g"), "a", "b", "score")
    e = cut(e)
    ends = e.select("_g", F.explode(F.array("a", "b")).alias("n")).distinct().groupBy("_g").agg(F.count("*").alias("size"))
    big = cut(ends.where(F.col("size") > largest).select("_g"))

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.unique(np.concatenate([pdf["a"].to_numpy(object), pdf["b"].to_numpy(object)]))
        x, y = (np.searchsorted(order, pdf[c].to_numpy(object)).astype(np.int32) for c in "ab")
        u, v, s = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([pdf["score"].to_numpy(float)] * 2)
        by = np.lexsort((s, v, u))
        starts = np.searchsorted(u[by], np.arange(len(order) + 1)).tolist()
        near, score = v[by].tolist(), s[by].tolist()
        label = list(range(len(order)))
        open_ = bytearray(b"\x01") * len(order)  # nodes with a neighbour that has moved since they were settled; any other would settle as before
        for _ in range(sweeps):
            moved = False
            at = open_.find(1)
            while at >= 0:
                open_[at] = 0
                votes: dict[int, float] = {}
                mine = near[starts[at] : starts[at + 1]]
                for m, w in zip(mine, score[starts[at] : starts[at + 1]]):
                    votes[label[m]] = votes.get(label[m], 0.0) + w
                best = min((-round(w, 9), x) for x, w in votes.items())[1]
                if best != label[at]:
                    label[at] = best
                    moved = True
                    for m in mine:
                        open_[m] = 1
                at = open_.find(1, at + 1)
            if not moved:
                break
        return pd.DataFrame({"_g": pdf["_g"].iloc[0], "paper_id": order, "label": order[label]})

    schema = f"_g {e.schema['_g'].dataType.simpleString()}, paper_id string, label string"
    found = e.join(big, "_g", "left_anti").groupBy("_g").applyInPandas(sweep, schema)
    if not big.isEmpty():
        found = found.unionByName(_sweep_by_rounds(e.join(big, "_g", "left_semi"), sweeps))
    if by is not None:
        return found.withColumnRenamed("_g", by)
    return nodes.join(found.drop("_g"), "paper_id", "left").select("paper_id", F.coalesce("label", "paper_id").alias("label"))


def _sweep_by_rounds(edges: DataFrame, sweeps: int) -> DataFrame:
    """The sweeps of `label_propagation` over tables of any size: within a sweep a node sees the new labels of smaller nodes and the old ones of larger nodes, and rounds are repeated until
    no label changes, which is the one solution of that rule. Each round is a join and an aggregate.
    """
    near = cut(edges.select("_g", F.col("a").alias("n"), F.col("b").alias("m"), "score").unionAll(edges.select("_g", F.col("b"), F.col("a"), "score")))
    old = cut(near.select("_g", "n").distinct().withColumn("label", F.col("n")))
    for _ in range(sweeps):
        now = old
        while True:
            seen = old.select("_g", F.col("n").alias("m"), F.col("label").alias("before")).join(now.select("_g", F.col("n").alias("m"), F.col("label").alias("after")), ["_g", "m"])
            votes = near.join(seen, ["_g", "m"]).groupBy("_g", "n", F.when(F.col("m") < F.col("n"), F.col("after")).otherwise(F.col("before")).alias("label")).agg(F.round(F.sum("score"), 9).alias("v"))
            best = cut(votes.groupBy("_g", "n").agg(F.min(F.struct((-F.col("v")).alias("v"), "label")).alias("b")).select("_g", "n", F.col("b.label").alias("label")))
            same = best.join(now.withColumnRenamed("label", "was"), ["_g", "n"]).where("label <> was").isEmpty()
            now = best
            if same:
                break
        if now.join(old.withColumnRenamed("label", "was"), ["_g", "n"]).where("label <> was").isEmpty():
            break
        old = now
    return now.select("_g", F.col("n").alias("paper_id"), "label")


def name_groups(features: DataFrame, weights: DataFrame, groups: DataFrame, names: DataFrame, n_papers: int) -> DataFrame:
    """(group, name): the two elements that mark a group (group, paper_id) best: coverage times bounded lift, coverage of a quarter first."""
    size = groups.groupBy("group").agg(F.count("*").alias("size"))
    c = features.join(groups, "paper_id").groupBy("group", "element_id").agg(F.count("*").alias("c")).join(size, "group").join(weights, "element_id")
    coverage = F.col("c") / F.col("size")
    lift = coverage / ((F.col("df") - F.col("c") + 0.5) / F.greatest(F.lit(float(n_papers)) - F.col("size"), F.lit(1.0)))
    s = c.withColumn("score", F.round(coverage * F.least(lift, F.lit(50.0)), 9)).withColumn("wide", coverage >= 0.25)
    rank = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("wide"), F.desc("score"), F.desc(F.round("idf", 9)), "element_id"))
    best = s.withColumn("r", rank).where("r <= 2").join(names, "element_id")
    return best.groupBy("group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "display_name"))), lambda x: x["display_name"]), " · ").alias("name"))


def load_sessions(papers: DataFrame, minutes: int = 30) -> DataFrame:
    """(session, start, end, papers): loads with gaps of at most `minutes` between them, by hour-free session windows."""
    s = papers.where("loaded_at is not null").groupBy(F.session_window("loaded_at", f"{minutes} minutes").alias("w")).agg(F.count("*").alias("papers"), F.max("loaded_at").alias("end"))
    return s.select(F.col("w.start").alias("start"), "end", "papers")
