"""Portfolio of review topics: relevance of papers, their edges, concepts and claims, metrics, ranking, overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Characters and texts that are written alike, in order; names of gases.
ALIKE = [("₀", "0"), ("₁", "1"), ("₂", "2"), ("₃", "3"), ("₄", "4"), ("₅", "5"), ("₆", "6"), ("₇", "7"), ("₈", "8"), ("₉", "9"), ("⁺", "+"), ("²", "2"), ("–", "-"), ("—", "-"), ("‑", "-"), (" ", " ")]
WEIGHT = {"contradicts": 3, "complements": 2, "supports": 1}


def norm_text(c: Column) -> Column:
    """Lower case with like characters made one, `carbon dioxide` as co2, `methane` as `ch4 methane`, white-space runs as one blank (not trimmed)."""
    t = F.coalesce(c, F.lit(""))
    for a, b in ALIKE:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.replace(F.replace(F.lower(t), F.lit("carbon dioxide"), F.lit("co2")), F.lit("methane"), F.lit("ch4 methane"))
    return F.regexp_replace(t, r"\s+", " ")


def gas_list(rows: DataFrame, gases: list[str]) -> DataFrame:
    """(paper_id, gases): surfaces of used materials that are a gas by their text or the end of their id, distinct, in order of `place`."""
    tail = F.lower(F.replace(F.substring_index("element_id", "/", -1), F.lit("-"), F.lit(" ")))
    g = rows.where("role = 'used' and occ_facet = 'material'").where(F.lower("surface").isin(gases) | tail.isin(gases)).withColumn("label", F.trim("surface")).where("label <> ''")
    first = g.groupBy("paper_id", "label").agg(F.min("place").alias("place"))
    return first.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]).alias("gases"))  # one paper's gases


def scored(papers: DataFrame, candidates: DataFrame) -> DataFrame:
    """(key, paper_id, score, terms, atoms): relevance of papers (paper_id, text, title, class_text: normalised; atoms, syntheses) to candidates (key, focus_terms, required_any; a few, counted).

    Each required group must have a term in the text. Terms in the text count 1, in the title 2 more, in the classification 1.5 more; up to 6 syntheses count 0.25, up to 20 atoms 0.05. No term, no row. Every paper is looked at for every candidate:
    a stated set of a few candidates.
    """
    c = candidates.select("key", F.transform("focus_terms", norm_text).alias("norms"), "focus_terms", F.transform("required_any", lambda g: F.transform(g, norm_text)).alias("required"))
    j = papers.crossJoin(F.broadcast(c))  # candidates are written by hand
    j = j.where(F.forall("required", lambda g: F.exists(g, lambda t: F.contains(F.col("text"), t))))
    hit = lambda col: F.array_distinct(F.filter("focus_terms", lambda t, i: F.contains(F.col(col), F.element_at("norms", i + 1))))
    j = j.withColumn("terms", F.array_sort(hit("text"))).where("size(terms) > 0")
    score = F.size("terms") + 2.0 * F.size(hit("title")) + 1.5 * F.size(hit("class_text")) + F.least("syntheses", F.lit(6)) * 0.25 + F.least("atoms", F.lit(20)) * 0.05
    return j.select("key", "paper_id", F.round(score, 9).alias("score"), "terms", "atoms", "syntheses")


def selected(scores: DataFrame, most: int) -> DataFrame:
    """The `most` best papers of each candidate with rank: score, atoms and id, all descending (a top-k report)."""
    r = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), F.desc("atoms"), F.desc("paper_id")))
    return scores.withColumn("rank", r).where(F.col("rank") <= most)


def internal_edges(chosen: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, a, b, relation, score, rank): edges between the chosen papers of a candidate, by weight of relation, then score."""
    a = edges.join(chosen.select("key", F.col("paper_id").alias("a")), "a").join(chosen.select("key", F.col("paper_id").alias("b")), ["key", "b"])
    w = F.lit(0)
    for k, v in WEIGHT.items():
        w = F.when(F.col("relation") == k, v).otherwise(w)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(w), F.desc("score"), "a", "b"))
    return a.withColumn("rank", rank).select("key", "a", "b", "relation", "score", "rank")


def concept_support(chosen: DataFrame, papers_of: DataFrame, index: DataFrame, most: int = 18) -> DataFrame:
    """(key, rank, concept, n_overlap, n_central, n_passing): concepts of the chosen papers by number of papers, of central ones, specific ones first, then gap (a top-k report)."""
    n = lambda r: F.sum((F.col("role") == r).cast("int"))
    g = papers_of.join(chosen.select("key", "paper_id"), "paper_id").groupBy("key", "concept").agg(F.count("*").alias("n_overlap"), n("central").alias("n_central"), n("passing").alias("n_passing"))
    g = g.join(index.select("concept", "specific", "gap"), "concept")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n_overlap"), F.desc("n_central"), F.desc("specific"), F.desc("gap"), "concept"))
    return g.withColumn("rank", rank).where(F.col("rank") <= most).select("key", "rank", "concept", "n_overlap", "n_central", "n_passing")


def claims(chosen: DataFrame, claims_of: DataFrame, candidates: DataFrame, most: int = 24) -> DataFrame:
    """(key, rank, paper_id, claim, source): distinct claims of the chosen papers in their order: findings with a focus term (or the paper's own terms), then atoms with one. `claims_of`: paper_id, kind (finding, atom), place, claim."""
    c = claims_of.withColumn("claim", F.trim("claim")).where("claim <> ''").join(chosen.select("key", "paper_id", F.col("rank").alias("paper_rank"), "terms"), "paper_id").join(F.broadcast(candidates.select("key", "focus_terms")), "key")  # a few candidates
    hit = F.exists("focus_terms", lambda t: F.contains(norm_text(F.col("claim")), norm_text(t)))
    c = c.where(hit | ((F.col("kind") == "finding") & (F.size("terms") > 0)))
    order = F.struct("paper_rank", F.when(F.col("kind") == "finding", 0).otherwise(1).alias("k"), "place")
    once = c.groupBy("key", "paper_id", "claim").agg(F.min(order).alias("at"), F.min_by("kind", order).alias("source"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("at"))).where(F.col("rank") <= most).select("key", "rank", "paper_id", "claim", "source")


def level(papers: Column, atoms: Column, syntheses: Column, edges: Column) -> Column:
    return F.when((papers >= 45) & (atoms >= 350) & (syntheses >= 90) & (edges >= 40), "strong_12000_word_review").when((papers >= 28) & (atoms >= 180) & (syntheses >= 50), "borderline_or_focused_large_review").otherwise("insufficient_for_12000_without_more_evidence")


def risk(ratio: Column, status: Column) -> Column:
    return F.when(status == "already_generated_flagship", "completed_reference_manuscript").when(ratio >= 0.65, "high_overlap_reframe_or_delay").when(ratio >= 0.35, "moderate_overlap_requires_distinct_thesis").otherwise("low_overlap")


def readiness(level_: Column, risk_: Column, edges: Column) -> Column:
    return F.when(level_ == "insufficient_for_12000_without_more_evidence", "do_not_generate_full_manuscript_yet").when(risk_ == "high_overlap_reframe_or_delay", "delay_until_distinct_thesis_is_locked").when(edges < 60, "generate_focused_review_or_expand_edges_first").otherwise("ready_for_sectioned_manuscript_generation")


def metrics(chosen: DataFrame, papers: DataFrame, edges: DataFrame, accepted: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per candidate: volumes, six partial scores with their caps, density, years, overlap with accepted papers, priority, and the labels that follow.

    `papers`: paper_id, atoms, syntheses, figures, year (int), methods, objects, gases (arrays); `edges`: internal edges; `accepted`: paper_id; `candidates`: key, status. Candidates without papers have zeros.
    """
    p = chosen.select("key", "paper_id").join(papers, "paper_id").join(accepted.select("paper_id").distinct().withColumn("acc", F.lit(1)), "paper_id", "left")
    kinds = lambda c: p.select("key", F.explode(c).alias("v")).groupBy("key").agg(F.countDistinct("v").alias(f"n_{c}"))
    g = p.groupBy("key").agg(F.count("*").alias("papers"), F.sum("atoms").alias("atoms"), F.sum("syntheses").alias("syntheses"), F.sum("figures").alias("figures"), F.sum((F.col("year") >= 2024).cast("int")).alias("recent"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.sum(F.coalesce("acc", F.lit(0))).alias("overlap"))
    for c in ("methods", "objects", "gases"):
        g = g.join(kinds(c), "key", "left")
    e = edges.groupBy("key").agg(F.count("*").alias("edges"), *[F.sum((F.col("relation") == r).cast("int")).alias(r) for r in WEIGHT])
    j = candidates.select("key", "status").join(g, "key", "left").join(e, "key", "left")
    counts = ["papers", "atoms", "syntheses", "figures", "recent", "overlap", "n_methods", "n_objects", "n_gases", "edges", *WEIGHT]
    j = j.select("key", "status", "first_year", "last_year", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    n = F.col
    ratio = F.when(n("papers") > 0, n("overlap") / n("papers")).otherwise(0.0)
    j = j.withColumn("overlap_ratio", ratio)
    part = {
        "evidence_score": F.least(F.lit(35.0), n("papers") * 0.45 + n("atoms") * 0.012 + n("syntheses") * 0.035),
        "relation_score": F.least(F.lit(25.0), n("contradicts") * 2.2 + n("complements") * 0.45 + n("supports") * 0.25),
        "method_score": F.least(F.lit(12.0), n("n_methods") * 0.8 + n("n_gases") * 0.8 + n("n_objects") * 0.25),
        "figure_score": F.least(F.lit(14.0), n("figures") * 0.08),
        "recency_score": F.least(F.lit(8.0), n("recent") * 0.25),
        "penalty": F.when(n("status") == "already_generated_flagship", 0.0).otherwise(F.least(F.lit(24.0), n("overlap_ratio") * 24)),
    }
    j = j.withColumns(part)
    total = n("evidence_score") + n("relation_score") + n("method_score") + n("figure_score") + n("recency_score") - n("penalty")
    density = F.when(n("papers") > 1, n("edges") / (n("papers") * (n("papers") - 1) / 2)).otherwise(0.0)
    lv, rk = level(n("papers"), n("atoms"), n("syntheses"), n("edges")), risk(n("overlap_ratio"), n("status"))
    return j.withColumns({"priority": F.round(total, 2), "density": F.round(density, 4), "level": lv, "risk": rk, "readiness": readiness(lv, rk, n("edges")), "overlap_ratio": F.round("overlap_ratio", 3)})


def recommended(rows: DataFrame, most: int) -> DataFrame:
    """(rank, key, priority, level): candidates worth writing, by priority (a top-k report): neither written already nor without evidence."""
    r = rows.where("status <> 'already_generated_flagship' and level <> 'insufficient_for_12000_without_more_evidence'").orderBy(F.desc("priority"), "key").limit(most)
    return r.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("priority"), "key"))).select("rank", "key", "priority", "level")  # `most` rows


def overlaps(members: DataFrame) -> DataFrame:
    """(a, b, shared, jaccard, risk) of all pairs of candidates a < b (key, paper_id) that share a paper; pairs that share none have 0 by definition and no row. Jaccard of three digits."""
    m = members.select("key", "paper_id").distinct()
    n = m.groupBy("key").agg(F.count("*").alias("n"))
    both = m.select(F.col("key").alias("a"), "paper_id").join(m.select(F.col("key").alias("b"), "paper_id"), "paper_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    j = both.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
    raw = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return j.select("a", "b", "shared", F.round(raw, 3).alias("jaccard"), F.when(raw >= 0.45, "high_pair_overlap").when(raw >= 0.25, "moderate_pair_overlap").otherwise("low_pair_overlap").alias("risk"))


def method_metrics(totals: DataFrame, stages: DataFrame) -> DataFrame:
    """One row for the paper on the method itself: totals (papers, atoms, syntheses, edges, scripts) and stages (stage, done): five points a stage, scripts and atoms with caps."""
    s = stages.agg(F.sum(F.col("done").cast("int")).alias("stages"))
    j = totals.join(F.broadcast(s))  # one row each
    score = 40 + F.col("stages") * 5 + F.least(F.lit(20.0), F.col("scripts") * 0.25) + F.least(F.lit(15.0), F.col("atoms") / 300)
    return j.withColumn("priority", F.round(score, 2)).withColumn("level", F.when(F.col("stages") >= 6, "method_paper_supported_by_project_artifacts").otherwise("needs_more_system_validation"))
