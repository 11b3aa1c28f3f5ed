"""Clusters of the map: splitting, merging, arrivals, lenses, overlays, layout, placing of new papers."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.operators.graph import label_propagation, nearest
from evispark.session import cut

# Quantiles of edge weights that are tried in turn, attempts at an anchor, depth of splitting.
QUANTILES, ANCHORS, DEPTH = (0.50, 0.75, 0.90, 0.97), 6, 4
SPECIAL = ["__misc__", "__unbuilt__", "__nofacet__", "__unknown__"]
# Fixed values of the layout: smallest radius, growth by share, gap of rings, turn between rings, share of a cluster's radius in use, golden angle.
LEAST_RADIUS, GROWTH, GAP, TURN, FILL, GOLDEN = 0.05, 0.22, 0.015, 0.7, 0.85, math.pi * (3 - math.sqrt(5))


def split_oversized(labels: DataFrame, edges: DataFrame, features: DataFrame, weights: DataFrame, n_papers: int, most: int = 30) -> DataFrame:
    """(paper_id, label) in which clusters of more than `most` papers are split as `parent>child`, up to DEPTH levels.

    A cluster's inner edges at or above a quantile of their weights are swept again, the lowest quantile that gives more than one label counts. What doesn't split goes by anchors: each paper's
    heaviest element of middle frequency (4 to a third of all papers), the first rank of elements at which the papers differ. Clusters that don't split either way stay.
    """
    band = weights.where((F.col("df") >= 4) & (F.col("df") <= max(5, n_papers // 3))).select("element_id", F.round("idf", 9).alias("w"))
    top = features.join(band, "element_id").groupBy("paper_id").agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("w", "element_id")), asc=False), 1, ANCHORS), lambda x: x["element_id"]).alias("anchors"))  # the elements of one paper
    out = cut(labels.select("paper_id", "label"))
    for _ in range(DEPTH):
        size = out.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > most)
        mine = cut(out.join(size.select("label"), "label", "left_semi"))
        if mine.isEmpty():
            break
        inner = edges.join(mine.select(F.col("paper_id").alias("a"), F.col("label")), "a").join(mine.select(F.col("paper_id").alias("b"), F.col("label").alias("_lb")), "b").where("label = _lb").select("label", "a", "b", "score")
        w = Window.partitionBy("label")
        ranked = inner.withColumn("r", F.row_number().over(w.orderBy("score", "a", "b")) - 1).withColumn("c", F.count("*").over(w))
        floors = ranked.select("label", "score", "r", "c", F.explode(F.array(*map(F.lit, QUANTILES))).alias("q")).where(F.col("r") == F.least(F.floor(F.col("c") * F.col("q")), F.col("c") - 1)).select("label", "q", F.col("score").alias("floor"))
        strong = inner.join(floors, "label").where("score >= floor").withColumn("g", F.concat_ws("\u0001", "label", F.col("q").cast("string")))
        swept = label_propagation(strong, mine, by="g").withColumn("label_", F.col("label")).select(F.substring_index("g", "\u0001", 1).alias("label"), F.substring_index("g", "\u0001", -1).cast("double").alias("q"), "paper_id", F.col("label_").alias("sub"))
        tried = cut(mine.join(floors.select("label", "q"), "label").join(swept, ["label", "q", "paper_id"], "left").withColumn("sub", F.coalesce("sub", "paper_id")))
        won = tried.groupBy("label", "q").agg(F.countDistinct("sub").alias("k")).where("k > 1").groupBy("label").agg(F.min("q").alias("q"))
        by_edges = tried.join(won, ["label", "q"]).select("paper_id", "label", "sub")
        dense = mine.join(inner.select("label").distinct(), "label", "left_semi").join(won.select("label"), "label", "left_anti").join(top, "paper_id", "left")
        at = dense.select("paper_id", "label", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(ANCHORS)), lambda i: F.coalesce(F.try_element_at("anchors", i), F.lit("__none__")))).alias("i", "sub"))
        differ = at.groupBy("label", "i").agg(F.countDistinct("sub").alias("k")).where("k > 1").groupBy("label").agg(F.min("i").alias("i"))
        by_anchor = at.join(differ, ["label", "i"]).select("paper_id", "label", "sub")
        moved = cut(by_edges.unionByName(by_anchor).select("paper_id", F.concat("label", F.lit(">"), "sub").alias("to")))
        if moved.isEmpty():
            break
        out = cut(out.join(moved, "paper_id", "left").select("paper_id", F.coalesce("to", "label").alias("label")))
    return out


def merge_tiny(labels: DataFrame, edges: DataFrame, least: int = 3, most: int | None = None) -> DataFrame:
    """(paper_id, label) in which clusters of fewer than `least` papers join the big one their edges weigh most for, else `__misc__`.

    In order of cluster id: a big cluster takes no more than `most` papers, single papers up to 5 % more. Without any big cluster nothing changes. One task holds the sizes of the clusters, no papers.
    """
    size = cut(labels.groupBy("label").agg(F.count("*").alias("n")))
    of = lambda end, name: labels.select(F.col("paper_id").alias(end), F.col("label").alias(name))
    e = edges.join(of("a", "la"), "a").join(of("b", "lb"), "b").where("la <> lb")
    both = e.select(F.col("la").alias("tiny"), F.col("lb").alias("to"), "score").unionAll(e.select("lb", "la", "score"))
    big = size.where(F.col("n") >= least)
    w = both.join(size.where(F.col("n") < least).select(F.col("label").alias("tiny")), "tiny", "left_semi").join(big.select(F.col("label").alias("to")), "to", "left_semi").groupBy("tiny", "to").agg(F.round(F.sum("score"), 9).alias("w"))
    offers = w.groupBy("tiny").agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), "to"))).alias("offers"))  # the big clusters around a tiny one
    empty = F.array().cast("array<struct<w:double,to:string>>")
    rows = big.select(F.lit(0).alias("kind"), "label", "n", empty.alias("offers")).unionAll(size.where(F.col("n") < least).join(offers.withColumnRenamed("tiny", "label"), "label", "left").select(F.lit(1), "label", "n", F.coalesce("offers", empty)))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: dict[str, int] = {}
        for pdf in frames:
            out = []
            for kind, c, n, offered in zip(pdf["kind"], pdf["label"], pdf["n"], pdf["offers"]):
                if kind == 0:
                    now[c] = n
                    continue
                room = None if most is None else most + (max(1, most // 20) if n == 1 else 0)
                to = next((o["to"] for o in offered if room is None or now[o["to"]] + n <= room), "__misc__") if now else c
                if to in now:
                    now[to] += n
                out.append((c, to))
            yield pd.DataFrame(out, columns=["label", "to"])

    moved = rows.repartition(1).sortWithinPartitions("kind", "label").mapInPandas(fold, "label string, to string")
    return labels.join(moved, "label", "left").select("paper_id", F.coalesce("to", "label").alias("label"))


def latest_batch(marks: DataFrame) -> DataFrame:
    """(paper_id): the papers of the last unbroken run of one batch id in the import log (seq, batch_id, paper_id), in the library or not."""
    last = marks.agg(F.max_by("batch_id", "seq").alias("last"))
    run = marks.join(F.broadcast(last))  # one row
    start = run.where("not batch_id <=> last").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("start"))
    return run.join(F.broadcast(start)).where("batch_id <=> last and seq > start and paper_id is not null").select("paper_id").distinct()  # one row


def latest_session(loads: DataFrame, minutes: int = 30) -> DataFrame:
    """(paper_id): papers of the last session of loads (paper_id, loaded_at) without a gap of more than `minutes`."""
    w = loads.where("loaded_at is not null").groupBy(F.session_window("loaded_at", f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n"))
    start = w.agg(F.max("w.start").alias("start"))
    return loads.join(F.broadcast(start)).where("loaded_at >= start").select("paper_id").distinct()  # one row


def arrivals(batch: DataFrame, papers: DataFrame, features: DataFrame, weights: DataFrame, clusters: DataFrame, k: int = 3) -> DataFrame:
    """(paper_id, cluster, neighbours, isolated) of the papers of a batch: their k nearest papers outside it and the cluster they fell in. A batch that is the whole library has no rows."""
    b = cut(batch.join(papers.select("paper_id"), "paper_id", "left_semi"))
    if papers.join(b, "paper_id", "left_anti").isEmpty():
        return papers.limit(0).select("paper_id", F.lit("").alias("cluster"), F.lit("").alias("neighbours"), F.lit(False).alias("isolated"))
    f = features.join(weights.select("element_id", "idf"), "element_id")
    mine = f.join(b, "paper_id", "left_semi").select(F.col("paper_id").alias("me"), "element_id", "idf")
    s = f.select("paper_id", "element_id").join(b, "paper_id", "left_anti").join(mine, "element_id").groupBy("me", "paper_id").agg(F.round(F.sum("idf"), 9).alias("score")).where("score > 0")
    r = s.withColumn("r", F.row_number().over(Window.partitionBy("me").orderBy(F.desc("score"), "paper_id"))).where(F.col("r") <= k)
    near = r.groupBy(F.col("me").alias("paper_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "paper_id"))), lambda x: x["paper_id"]), ",").alias("neighbours"))
    j = b.join(near, "paper_id", "left").join(clusters.select("paper_id", F.col("label").alias("cluster")), "paper_id", "left")
    return j.select("paper_id", F.coalesce("cluster", F.lit("")).alias("cluster"), F.coalesce("neighbours", F.lit("")).alias("neighbours"), F.col("neighbours").isNull().alias("isolated"))


def institution_lens(pairs: DataFrame, papers: DataFrame, places: DataFrame) -> DataFrame:
    """(paper_id, institution, size, cluster): each paper's main institution (that of most papers, ties to the least id), its number of papers, and the continent it lies in.

    `pairs`: paper_id, institution; `places`: institution, continent. Papers without an institution or with an unplaced one are in `__unknown__`.
    """
    p = pairs.where("paper_id is not null and institution is not null").distinct()
    n = p.groupBy("institution").agg(F.count("*").alias("n"))
    main = p.join(n, "institution").groupBy("paper_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "institution")).alias("m")).select("paper_id", "m.institution", (-F.col("m.n")).alias("size"))
    j = papers.select("paper_id").join(main, "paper_id", "left").join(places.groupBy("institution").agg(F.max("continent").alias("continent")), "institution", "left")
    return j.select("paper_id", "institution", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce(F.concat(F.lit("cont:"), "continent"), F.lit("__unknown__")).alias("cluster"))


def top_institutions(lens: DataFrame, k: int = 5) -> DataFrame:
    """(cluster, rank, institution, papers): the k institutions of most papers of each continent (a top-k report)."""
    n = lens.where("institution is not null and cluster <> '__unknown__'").groupBy("cluster", "institution").agg(F.count("*").alias("papers"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("papers"), "institution"))).where(F.col("rank") <= k)


def fingerprints(features: DataFrame) -> DataFrame:
    """(paper_id, fingerprint) of the sorted features of each paper."""
    return features.groupBy("paper_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("element_id")), "|"), 256).alias("fingerprint"))  # the elements of one paper


def place_incrementally(old: DataFrame, now: DataFrame, features: DataFrame, weights: DataFrame, labels: DataFrame) -> tuple[str, DataFrame]:
    """(state, labels): `same` if all fingerprints (paper_id, fingerprint) agree, `grown` if the old papers are unchanged and new ones came, else `rebuild`.

    For `same` and `grown` labels (paper_id, label) are kept and each new paper takes that of its nearest old one (`__misc__` without one); for `rebuild` they are empty.
    """
    j = old.withColumnRenamed("fingerprint", "was").join(now, "paper_id", "full")
    s = j.agg(F.coalesce(F.max((F.col("was").isNotNull() & ~F.col("was").eqNullSafe(F.col("fingerprint"))).cast("int")), F.lit(0)).alias("changed"), F.coalesce(F.max(F.col("was").isNull().cast("int")), F.lit(0)).alias("new")).first()
    if s["changed"]:
        return "rebuild", labels.limit(0)
    if not s["new"]:
        return "same", labels
    fresh = now.join(old.select("paper_id"), "paper_id", "left_anti").select("paper_id")
    f = features.join(weights.select("element_id", "idf"), "element_id")
    best = nearest(f, fresh, 1, labels).where("score > 0").select("me", F.col("other").alias("paper_id")).join(labels, "paper_id").select(F.col("me").alias("paper_id"), "label")
    placed = fresh.join(best, "paper_id", "left").select("paper_id", F.coalesce("label", F.lit("__misc__")).alias("label"))
    return "grown", labels.select("paper_id", "label").unionByName(placed)


def overlay(labels: DataFrame, meta: DataFrame) -> DataFrame:
    """(label, members_key, shown, how): the name that people gave a cluster: by the hash of its members, else of the most similar entry with a label (Jaccard at least 0.5, the later one at ties).

    `meta`: key, members (array), label_by_hand, seq. Special clusters are matched by hash only. how: `exact`, `similar` or null.
    """
    own = labels.groupBy("label").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("paper_id")), "|"), 256).alias("h"), F.count("*").alias("n")).withColumn("members_key", F.left("h", F.lit(16))).drop("h")
    exact = own.join(meta.select(F.col("key").alias("members_key"), F.col("label_by_hand").alias("exact"), F.lit(True).alias("hit")), "members_key", "left")
    m = meta.where("label_by_hand <> ''").select("key", "label_by_hand", "seq", F.size(F.array_distinct("members")).alias("k"), F.explode(F.array_distinct("members")).alias("paper_id"))
    both = m.join(labels, "paper_id").groupBy("label", "key", "label_by_hand", "seq", "k").agg(F.count("*").alias("c")).join(own.select("label", "n"), "label")
    j = both.withColumn("j", F.col("c") / (F.col("n") + F.col("k") - F.col("c"))).where("j >= 0.5").where(~F.col("label").isin(SPECIAL))
    best = j.groupBy("label").agg(F.max_by("label_by_hand", F.struct("j", "seq")).alias("similar"))
    out = exact.join(best, "label", "left")
    shown = F.when(F.col("hit"), F.nullif(F.col("exact"), F.lit(""))).otherwise(F.col("similar"))
    return out.select("label", "members_key", shown.alias("shown"), F.when(F.col("hit"), "exact").when(F.col("similar").isNotNull(), "similar").alias("how"))


def to_describe(labels: DataFrame, titles: DataFrame, described: DataFrame, samples: int = 12) -> DataFrame:
    """(label, papers, titles): clusters without a description (described: label), special ones left out, with the titles of their first papers by id as samples."""
    todo = labels.where(~F.col("label").isin(SPECIAL)).join(described.select("label").distinct(), "label", "left_anti")
    r = todo.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("paper_id"))).where(F.col("r") <= samples).join(titles.select("paper_id", "title"), "paper_id", "left")
    t = r.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "title"))), lambda x: F.nullif(x["title"], F.lit(""))), " | ").alias("titles"))
    return todo.groupBy("label").agg(F.count("*").alias("papers")).join(t, "label")


def ring_centres(sizes: DataFrame, pinned: tuple[str, ...] = ("__misc__", "__unbuilt__")) -> DataFrame:
    """(label, x, y, r, phase): discs of clusters (label, n) in rings around the largest; a ring takes discs while their angles fit, pinned clusters start a ring of their own outside. One task holds one ring's state."""
    total = sizes.agg(F.sum("n").alias("total"))
    pin = F.col("label").isin(list(pinned)).cast("int")
    rows = sizes.where("n > 0").join(F.broadcast(total)).select("label", "n", pin.alias("pin"), (F.lit(LEAST_RADIUS) + F.lit(GROWTH) * F.sqrt(F.col("n") / F.col("total"))).alias("r"))  # one row

    def lay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reach, number, ring = None, 0, None  # ring: distance, first angle, next angle, greatest radius, has unpinned
        for pdf in frames:
            out = []
            for c, pin_, r in zip(pdf["label"], pdf["pin"], pdf["r"]):
                phase = int(hashlib.sha256(c.encode()).hexdigest()[:8], 16) % 6283 / 1000.0
                if reach is None:
                    reach = r
                    out.append((c, 0.0, 0.0, r, phase))
                    continue
                while True:
                    if ring is None:
                        number += 1
                        ring = [reach + GAP + r, number * TURN, number * TURN, 0.0, False]
                    d, first, angle, widest, mixed = ring
                    ratio = (r + GAP / 2) / d
                    half = math.pi if ratio >= 0.9 else math.asin(ratio)
                    full = pin_ and mixed or ratio >= 0.9 and widest > 0 or angle + 2 * half > first + 2 * math.pi + 1e-9
                    if not full:
                        break
                    reach, ring = d + widest, None
                out.append((c, d * math.cos(angle + half), d * math.sin(angle + half), r, phase))
                ring[2:] = [angle + 2 * half, max(widest, r), mixed or not pin_]
            yield pd.DataFrame(out, columns=["label", "x", "y", "r", "phase"])

    return rows.repartition(1).sortWithinPartitions("pin", F.desc("n"), "label").mapInPandas(lay, "label string, x double, y double, r double, phase double")


def radial_layout(labels: DataFrame, years: DataFrame, pinned: tuple[str, ...] = ("__misc__", "__unbuilt__")) -> DataFrame:
    """(paper_id, label, x, y) in the unit square: clusters as discs in rings, papers within along a golden-angle spiral from the oldest outwards (year, id; no year last).

    `years`: paper_id, year (int). The same input gives the same places; one scale for both axes.
    """
    l = labels.join(years.select("paper_id", "year"), "paper_id", "left")
    c = ring_centres(labels.groupBy("label").agg(F.count("*").alias("n")), pinned)
    w = Window.partitionBy("label")
    k = F.row_number().over(w.orderBy(F.coalesce("year", F.lit(9999)), "paper_id")) - 1
    l = l.withColumn("k", k).withColumn("n", F.count("*").over(w)).join(c, "label")
    rr = F.when(F.col("n") == 1, 0.0).otherwise(F.col("r") * FILL * F.sqrt((F.col("k") + 0.5) / F.col("n")))
    th = F.col("phase") + F.col("k") * GOLDEN
    at = cut(l.select("paper_id", "label", (F.col("x") + rr * F.cos(th)).alias("x"), (F.col("y") + rr * F.sin(th)).alias("y")))
    box = at.agg(((F.max("x") + F.min("x")) / 2).alias("cx"), ((F.max("y") + F.min("y")) / 2).alias("cy"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span"))
    scale = F.lit(0.9) / F.when(F.col("span") == 0, 1.0).otherwise(F.col("span"))
    return at.join(F.broadcast(box)).select("paper_id", "label", (F.lit(0.5) + (F.col("x") - F.col("cx")) * scale).alias("x"), (F.lit(0.5) + (F.col("y") - F.col("cy")) * scale).alias("y"))  # one row


def place_new(old: DataFrame, near: DataFrame, fresh: DataFrame) -> DataFrame:
    """(paper_id, x, y) of new papers (fresh: paper_id): the centre of their three best old neighbours (near: paper_id, other, score) by weight with a small shift from the id; without any a place on the outer ring by id. Old places (paper_id, x, y) stay."""
    o = old.select(F.col("paper_id").alias("other"), "x", "y")
    r = near.join(o, "other").withColumn("r", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("score"), "other"))).where("r <= 3")
    c = r.groupBy("paper_id").agg(F.sum("score").alias("w"), F.sum(F.col("x") * F.col("score")).alias("sx"), F.sum(F.col("y") * F.col("score")).alias("sy"))
    byte = lambda k: F.conv(F.substring(F.sha2("paper_id", 256), 2 * k + 1, 2), 16, 10).cast("double") / 255
    jitter = lambda k: (byte(k) - 0.5) * 0.04
    turn = byte(2) * 2 * math.pi
    j = fresh.select("paper_id").join(c, "paper_id", "left").withColumn("w", F.when(F.col("w") == 0, 1.0).otherwise(F.col("w")))
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    x = F.coalesce(F.col("sx") / F.col("w"), F.lit(0.5) + F.lit(0.45) * F.cos(turn)) + jitter(0)
    y = F.coalesce(F.col("sy") / F.col("w"), F.lit(0.5) + F.lit(0.45) * F.sin(turn)) + jitter(1)
    return j.select("paper_id", unit(x).alias("x"), unit(y).alias("y"))


def relax(placed: DataFrame, rounds: int = 30, least: float = 0.02) -> DataFrame:
    """Places of the papers of one import pushed apart where they are nearer than `least`, in order of id, `rounds` times. Cells of a grid tell who is near, so no pair of distant papers is looked at; who is near is looked up again only where a paper leaves its cell, and rounds end once nothing moves. One import is one task."""

    def push(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("paper_id", kind="stable")
        ids, at = rows["paper_id"].tolist(), rows[["x", "y"]].to_numpy(dtype=float).tolist()
        cell = lambda p: (int(p[0] / least), int(p[1] / least))
        grid: dict[tuple[int, int], set[int]] = {}
        near = lambda c, after: sorted(k for dx in (-1, 0, 1) for dy in (-1, 0, 1) for k in grid.get((c[0] + dx, c[1] + dy), ()) if k > after)
        for i, p in enumerate(at):
            grid.setdefault(cell(p), set()).add(i)
        for _ in range(rounds):
            moved = False
            for i in range(len(ids)):
                x, y = at[i]
                here, done = cell(at[i]), i
                around = near(here, done)
                at_ = 0
                while at_ < len(around):
                    done = around[at_]
                    at_ += 1
                    dx, dy = x - at[done][0], y - at[done][1]
                    d = math.sqrt(dx * dx + dy * dy)
                    if d >= least:
                        continue
                    moved = True
                    step = (least - d) / 2 + 1e-3
                    for k, sign in ((i, 1), (done, -1)):
                        was = cell(at[k])
                        at[k] = [min(max(v + sign * u / (d + 1e-9) * step, 0.0), 1.0) for v, u in zip(at[k], (dx, dy))]
                        if (to := cell(at[k])) != was:
                            grid[was].discard(k)
                            grid.setdefault(to, set()).add(k)
                    x, y = at[i]
                    if (to := cell(at[i])) != here:
                        here, around, at_ = to, near(to, done), 0
            if not moved:
                break
        yield pd.DataFrame({"paper_id": ids, "x": [p[0] for p in at], "y": [p[1] for p in at]})

    return placed.select("paper_id", "x", "y").repartition(1).mapInPandas(push, "paper_id string, x double, y double")


def closeup(focus: DataFrame, typed: DataFrame, similar: DataFrame, inner: int = 12, outer: int = 8) -> DataFrame:
    """(focus, paper_id, ring, relation, rank): around each paper of `focus` the first `inner` distinct neighbours by typed edges (a, b, relation, seq; the first relation counts), then the `outer` most similar ones (focus, paper_id, rank) that are not among them."""
    ends = typed.select(F.col("a").alias("focus"), F.col("b").alias("paper_id"), "relation", "seq").unionAll(typed.select("b", "a", "relation", "seq")).join(focus, "focus", "left_semi")
    first = ends.groupBy("focus", "paper_id").agg(F.min_by("relation", "seq").alias("relation"), F.min("seq").alias("seq"))
    i = first.withColumn("rank", F.row_number().over(Window.partitionBy("focus").orderBy("seq", "paper_id"))).where(F.col("rank") <= inner)
    o = similar.join(i.select("focus", "paper_id"), ["focus", "paper_id"], "left_anti").withColumn("rank", F.row_number().over(Window.partitionBy("focus").orderBy("rank", "paper_id"))).where(F.col("rank") <= outer)
    return i.select("focus", "paper_id", F.lit("inner").alias("ring"), "relation", "rank").unionByName(o.select("focus", "paper_id", F.lit("outer").alias("ring"), F.lit(None).cast("string").alias("relation"), "rank"))
