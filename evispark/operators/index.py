"""The element index and its relational queries: statistics, search, co-occurrence, combinations, linked counts, timelines.

An index holds `elements` (one row per entry), `rows` (paper_id, element_id, role, surface, ...: one per resolved occurrence) and `papers`. All queries
are plain joins and aggregates; distinct papers are counted after a map-side deduplication of (paper, element).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.keys import slugify


@dataclass(frozen=True)
class Index:
    elements: DataFrame
    rows: DataFrame
    papers: DataFrame


def clean_role(c: Column) -> Column:
    """Lower case without outer blanks; a blank role is null."""
    r = F.lower(F.trim(c))
    return F.when(r != "", r)


def by_role(rows: DataFrame, role: str | None) -> DataFrame:
    """Rows of a role; None and `all` mean no filter. Any other word is compared as it is."""
    return rows if role in (None, "all") else rows.where(F.col("role") == role)


def topic_rows(papers: DataFrame, rows: DataFrame) -> DataFrame:
    """Synthetic rows of role `used` from each paper's tags, once per paper and topic, for papers that have occurrences."""
    tags = papers.select("paper_id", F.explode("domain_tags").alias("surface")).where(F.trim("surface") != "")
    topics = tags.withColumn("element_id", F.concat(F.lit("elem:topic/"), slugify(F.col("surface"))))
    once = topics.groupBy("paper_id", "element_id").agg(F.min("surface").alias("surface"))
    return once.join(rows.select("paper_id").distinct(), "paper_id", "left_semi").withColumn("role", F.lit("used"))


def facet_stats(ix: Index, facet: str, role: str | None = None) -> DataFrame:
    """Distinct papers per element of a facet, most papers first. Elements without a row are absent."""
    e = ix.elements.where(F.col("facet") == facet)
    n = by_role(ix.rows, role).join(e, "element_id").groupBy("element_id", "slug", "display_name").agg(F.countDistinct("paper_id").alias("papers"))
    return n.orderBy(F.desc("papers"), "display_name", "element_id")


def overview(ix: Index, role: str | None = None, top: int = 5) -> DataFrame:
    """The `top` elements of each facet with the facet's number of elements that have a row."""
    n = by_role(ix.rows, role).join(ix.elements, "element_id").groupBy("facet", "element_id", "display_name").agg(F.countDistinct("paper_id").alias("papers"))
    w = Window.partitionBy("facet")
    ranked = n.withColumn("elements", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("papers"), "display_name", "element_id")))
    return ranked.where(F.col("rank") <= top)


def search(ix: Index, text: str, limit: int = 50) -> DataFrame:
    """Elements whose name or aliases contain `text` (% and _ are wildcards), with their used papers, 0 kept. A top-`limit` report."""
    like = f"%{text.lower()}%"
    hit = ix.elements.where(F.lower("display_name").like(like) | F.lower(F.coalesce("aliases_json", F.lit(""))).like(like))
    n = by_role(ix.rows, "used").groupBy("element_id").agg(F.countDistinct("paper_id").alias("n"))
    out = hit.join(n, "element_id", "left").select("element_id", "facet", "display_name", F.coalesce("n", F.lit(0)).alias("papers"))
    return out.orderBy(F.desc("papers"), "element_id").limit(limit)


def detail(ix: Index, element: DataFrame, role: str | None = None) -> DataFrame:
    """Occurrences of the element(s) in `element` (element_id), per paper."""
    r = by_role(ix.rows, role).join(F.broadcast(element), "element_id", "left_semi").join(ix.elements.select("element_id"), "element_id", "left_semi")  # a handful of ids
    return r.groupBy("element_id", "paper_id").agg(F.count("*").alias("occurrences"), F.min("surface").alias("first_surface"), F.countDistinct("surface").alias("surfaces"))


def cooccurrence(ix: Index, anchor: DataFrame, role: str = "used") -> DataFrame:
    """Other elements in the papers of the anchor, same role on both sides. `all` isn't a role here and matches nothing."""
    rows = ix.rows.where(F.col("role") == role).select("paper_id", "element_id").distinct()
    mine = rows.join(F.broadcast(anchor), "element_id", "left_semi").select("paper_id")
    total = mine.agg(F.count("*").alias("anchor_papers"))
    other = rows.join(mine, "paper_id", "left_semi").join(F.broadcast(anchor), "element_id", "left_anti")
    n = other.groupBy("element_id").agg(F.count("*").alias("papers")).join(ix.elements.select("element_id", "facet", "display_name"), "element_id")
    return n.join(F.broadcast(total))  # one row


def with_all(rows: DataFrame, chosen: DataFrame, k: int, role: str | None = "used") -> DataFrame:
    """Papers that have all k elements of `chosen` (element_id, distinct). No element chosen: every paper with a row."""
    r = by_role(rows, role).select("paper_id", "element_id").distinct()
    if k == 0:
        return r.select("paper_id").distinct()
    return r.join(F.broadcast(chosen), "element_id", "left_semi").groupBy("paper_id").agg(F.count("*").alias("_k")).where(F.col("_k") == k).select("paper_id")


def combination(ix: Index, chosen: DataFrame, k: int, role: str = "used") -> DataFrame:
    """Papers with all chosen elements and what matched in each."""
    papers = with_all(ix.rows, chosen, k, role)
    r = ix.rows.where(F.col("role") == role).join(F.broadcast(chosen), "element_id", "left_semi").join(papers, "paper_id", "left_semi")
    return r.groupBy("paper_id", "element_id").agg(F.count("*").alias("occurrences"), F.min("surface").alias("surface"))


def paper_elements(ix: Index) -> DataFrame:
    """Elements of each paper, all roles; ids that are no entry drop out."""
    return ix.rows.join(ix.elements.select("element_id", "facet", "display_name"), "element_id").groupBy("paper_id", "facet", "element_id", "display_name").agg(F.count("*").alias("occurrences"))


def linked_counts(ix: Index, chosen: DataFrame, k: int, role: str | None = "used") -> DataFrame:
    """For every element the number of papers it would leave, given the chosen ones; elements with 0 included."""
    papers = with_all(ix.rows, chosen, k, role)
    r = by_role(ix.rows, role).select("paper_id", "element_id").distinct().join(papers, "paper_id", "left_semi")
    n = r.groupBy("element_id").agg(F.count("*").alias("n"))
    return ix.elements.select("element_id", "facet", "display_name").join(n, "element_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def profile(ix: Index, groups: DataFrame, top: int = 5) -> DataFrame:
    """Top elements per group and facet over the papers of each group (group, paper_id), used only."""
    r = by_role(ix.rows, "used").select("paper_id", "element_id").distinct().join(groups, "paper_id").join(ix.elements.select("element_id", "facet", "display_name"), "element_id")
    n = r.groupBy("group", "facet", "element_id", "display_name").agg(F.countDistinct("paper_id").alias("n"))
    rank = F.row_number().over(Window.partitionBy("group", "facet").orderBy(F.desc("n"), "display_name", "element_id"))
    return n.withColumn("rank", rank).where(F.col("rank") <= top)


def year_of(c: Column) -> Column:
    """The first plausible year in a text, else null."""
    y = F.regexp_extract(F.coalesce(c, F.lit("")), "((?:18|19|20)[0-9]{2})", 1)
    return F.when(y != "", y.cast("int"))


def first_seen(ix: Index, role: str | None = None) -> DataFrame:
    """Per element the first (year, paper) among dated papers, and all its papers, dated or not."""
    r = by_role(ix.rows, role).select("paper_id", "element_id").distinct().join(ix.elements.select("element_id", "facet", "display_name"), "element_id")
    dated = r.join(ix.papers.select("paper_id", year_of(F.col("year")).alias("y")), "paper_id", "left")
    pair = F.when(F.col("y").isNotNull(), F.struct("y", "paper_id"))
    n = dated.groupBy("element_id", "facet", "display_name").agg(F.min(pair).alias("f"), F.count("*").alias("papers_total"))
    return n.select("element_id", "facet", "display_name", F.col("f.y").alias("first_year"), F.col("f.paper_id").alias("first_paper"), "papers_total")


def chips(ix: Index) -> DataFrame:
    """Elements of each paper once, with the recorded values that the name doesn't hold already."""
    values = F.expr("from_json(values_json, 'array<struct<raw:string,unit:string,num:string>>')")
    v = ix.rows.join(ix.elements.select("element_id", "facet", "display_name"), "element_id").withColumn("v", F.explode_outer(values))
    raw = F.when((F.col("v.raw") != "") & ~F.col("display_name").contains(F.col("v.raw")), F.col("v.raw"))
    return v.groupBy("paper_id", "facet", "element_id", "display_name").agg(F.array_join(F.array_sort(F.collect_set(raw)), ", ").alias("shown"))
