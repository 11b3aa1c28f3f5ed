"""Queries of the similarity graph, the connection layer and the registry, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.keys import norm_key
from evispark.operators import graph as G
from evispark.operators import index as I
from evispark.operators.grid import best_pairs
from evispark.plans.index_queries import OCC, journals, load
from evispark.session import broadcast_checked, cut, shuffled
from evispark.tables import latest, table

METHOD_FACETS = ["preparation", "measurement", "simulation", "characterization", "analysis"]
# Weights of the facets in the connection score.
TAG_WEIGHTS = {"domain_tags": 0.6, "methods": 0.8, "research_objects": 1.0}

def lens(ix: I.Index, facets: list[str]) -> DataFrame:
    """(paper_id, element_id): used elements of the facets, once per paper."""
    return I.by_role(ix.rows, "used").join(ix.elements.where(F.col("facet").isin(facets)).select("element_id"), "element_id", "left_semi").select("paper_id", "element_id").distinct()

def _material(spark: SparkSession, sf: str):
    ix = load(spark, sf)
    f = cut(lens(ix, ["material"]))
    n = ix.papers.count()
    return ix, f, n, cut(G.idf(f, n))

def g1_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features per paper in the method lens; papers without any are kept with 0."""
    ix = load(spark, sf)
    n = lens(ix, METHOD_FACETS).groupBy("paper_id").agg(F.count("*").alias("features"))
    return ix.papers.select("paper_id").join(n, "paper_id", "left").withColumn("features", F.coalesce("features", F.lit(0)))

def g2_idf(spark: SparkSession, sf: str) -> DataFrame:
    return _material(spark, sf)[3].withColumn("idf", F.round("idf", 9))

def g3_edges(spark: SparkSession, sf: str) -> DataFrame:
    _, f, n, w = _material(spark, sf)
    return G.best_edges(f, w, n)

def g4_weak_edges(spark: SparkSession, sf: str) -> DataFrame:
    """For papers with features but no edge their two best uncapped partners, at half the score."""
    _, f, n, w = _material(spark, sf)
    g, every = f.join(w, "element_id"), f.select("paper_id").distinct()
    capped = g.where(F.col("df") <= max(5, int(n * 0.3)))
    linked = G.nearest(capped, every, 1).where("score > 6")  # its best pair is an edge of a paper, if any is
    lonely = cut(every.join(linked.select(F.col("me").alias("paper_id")), "paper_id", "left_anti"))
    near = G.nearest(g, lonely, 2).where("score > 0")
    return near.select(F.col("me").alias("node"), F.least("me", "other").alias("a"), F.greatest("me", "other").alias("b"), F.round(F.col("score") * 0.5, 6).alias("score"))

def g5_degrees(spark: SparkSession, sf: str) -> DataFrame:
    ix, f, n, w = _material(spark, sf)
    return G.degrees(G.best_edges(f, w, n), ix.papers.select("paper_id"))

def g6_label_propagation(spark: SparkSession, sf: str) -> DataFrame:
    ix, f, n, w = _material(spark, sf)
    edges = cut(G.best_edges(f, w, n))
    return G.label_propagation(edges, ix.papers.select("paper_id"))

def g7_communities(spark: SparkSession, sf: str) -> DataFrame:
    """Label groups of ten sweeps, numbered by size; equal sizes share a number."""
    ix, f, n, w = _material(spark, sf)
    edges = cut(G.best_edges(f, w, n))
    c = cut(G.label_propagation(edges, ix.papers.select("paper_id"), 10).groupBy("label").agg(F.count("*").alias("size")))
    larger = c.groupBy("size").agg(F.lit(1).alias("_"))
    number = larger.withColumn("community", F.dense_rank().over(Window.orderBy(F.desc("size")))).drop("_")  # one row per size
    return c.join(number, "size").select("label", "size", "community")

def g10_special(spark: SparkSession, sf: str) -> DataFrame:
    """Papers without features: those with no occurrence at all, and those whose occurrences lie outside the lens."""
    ix, f, _, _ = _material(spark, sf)
    bare = ix.papers.select("paper_id").join(f.select("paper_id").distinct(), "paper_id", "left_anti")
    has = ix.rows.select("paper_id").distinct().withColumn("has", F.lit(True))
    return bare.join(has, "paper_id", "left").select("paper_id", F.when(F.col("has"), "__nofacet__").otherwise("__unbuilt__").alias("group"))

def g11_names(spark: SparkSession, sf: str) -> DataFrame:
    ix, f, n, w = _material(spark, sf)
    groups = journals(ix).join(f.select("paper_id").distinct(), "paper_id", "left_semi")
    return G.name_groups(f, w, groups, ix.elements.select("element_id", "display_name"), n).withColumnRenamed("group", "journal_key")

def g14_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return G.load_sessions(table(spark, sf, "papers").select("loaded_at"))

def g16_years(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf).papers
    return p.groupBy(I.year_of(F.col("year")).alias("y")).agg(F.count("*").alias("papers"))

def _tags(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf).papers
    parts = [p.select("paper_id", F.lit(c).alias("facet"), F.explode(c).alias("v")) for c in TAG_WEIGHTS]
    all_ = parts[0].unionAll(parts[1]).unionAll(parts[2]).select("paper_id", "facet", norm_key(F.col("v")).alias("concept"))
    return all_.where("concept <> ''").distinct()

def c2_document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return _tags(spark, sf).groupBy("facet", "concept").agg(F.count("*").alias("df"))

def c3_candidate_edges(spark: SparkSession, sf: str, among: DataFrame | None = None) -> DataFrame:
    """Pairs of papers by weighted rarity of common concepts, the 10 best of either end, ties to the larger neighbour. With `among` (paper_id) only pairs with both ends there; weights and the 10 best are still those over all papers."""
    t = cut(_tags(spark, sf))
    n = t.select("paper_id").distinct().count()
    weight = F.coalesce(*[F.when(F.col("facet") == c, w) for c, w in TAG_WEIGHTS.items()])
    df = t.groupBy("facet", "concept").agg(F.count("*").alias("df")).withColumn("w", weight * F.log(F.lit(float(n)) / F.col("df")))
    df = cut(df.select("facet", "concept", "w", F.monotonically_increasing_id().alias("item")))
    f = t.where("paper_id is not null").join(shuffled(df), ["facet", "concept"]).groupBy(F.col("paper_id").alias("id")).agg(F.collect_list(F.struct("item", "w")).alias("e"))  # the concepts of one paper
    mine = None if among is None else cut(among.select(F.col("paper_id").alias("id")).distinct())
    near = best_pairs(f.select("id", "e.item", "e.w").toDF("id", "items", "weights"), 10, mine)
    if mine is not None:
        near = near.join(broadcast_checked(mine.toDF("other")), "other", "left_semi")
    return near.groupBy(F.least("me", "other").alias("a"), F.greatest("me", "other").alias("b")).agg(F.round(F.max("s"), 3).alias("score"), F.max("shared").alias("shared"))


def c4_degree_report(spark: SparkSession, sf: str) -> DataFrame:
    """Greatest, upper median and least degree, isolated papers and the mean, over all papers."""
    e = c3_candidate_edges(spark, sf)
    d = G.degrees(e, load(spark, sf).papers.select("paper_id")).select("degree")
    w = Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    median = d.groupBy("degree").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(Window.orderBy("degree"))).withColumn("total", F.sum("c").over(w))
    mid = median.where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("degree").alias("median"))
    total = d.agg(F.max("degree").alias("most"), F.min("degree").alias("least"), F.sum((F.col("degree") == 0).cast("int")).alias("isolated"), F.round(F.avg("degree"), 6).alias("mean"))
    return total.join(F.broadcast(mid))  # one row each

def el16_surfaces(spark: SparkSession, sf: str) -> DataFrame:
    o = latest(table(spark, sf, "occurrences"), ["occ_id"], "loaded_at", ["facet", "surface"])
    return o.groupBy("facet", "surface").agg(F.count("*").alias("n"))

def el27_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Papers with and without occurrences, by whether they have a card."""
    ix = load(spark, sf)
    has = ix.rows.select("paper_id").distinct().withColumn("has", F.lit(True))
    return ix.papers.join(has, "paper_id", "left").groupBy("has_card", F.coalesce("has", F.lit(False)).alias("has_elements")).agg(F.count("*").alias("papers"))

W = "with " + OCC
_NK = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_MAT = """, f as (select paper_id, element_id from used where element_id in (select element_id from el where facet = 'material')), n as (select count(*)::double n from pap),
 w as (select element_id, count(*) df, ln(n.n / count(*)) idf from f, n group by element_id, n.n)"""
_PAIR = """, {name} as (select a.paper_id a, b.paper_id b, round(sum(idf), 9) score, count(*) shared from f a join f b on a.element_id = b.element_id and a.paper_id < b.paper_id
 join w on w.element_id = a.element_id {cap} group by 1, 2)"""
_CAP = "and df <= greatest(5, floor((select n from n) * 0.3))"
_EDGES = _PAIR.format(name="s", cap=_CAP) + """, ends as (select *, unnest([a, b]) node from s where score > {least}),
 edges as (select distinct a, b, score, shared from (select *, row_number() over (partition by node order by score desc, a, b) r from ends) where r <= 8)"""
_TAG = ", t as (select distinct paper_id, facet, concept from (" + " union all ".join(f"select paper_id, '{c}' facet, {_NK.format('v')} concept from pap, unnest({c}) u(v)" for c in TAG_WEIGHTS) + ") where concept <> '')"
_C3 = _TAG + """, nn as (select count(distinct paper_id)::double n from t),
 d as (select facet, concept, case facet when 'domain_tags' then 0.6::double when 'methods' then 0.8::double else 1.0::double end * ln(nn.n / count(*)) w from t, nn group by facet, concept, nn.n),
 s as (select * from (select x.paper_id a, y.paper_id b, round(sum(w), 9) s, count(*) shared from t x join t y on x.facet = y.facet and x.concept = y.concept and x.paper_id < y.paper_id
   join d on d.facet = x.facet and d.concept = x.concept group by 1, 2) where s > 0),
 e as (select *, a me, b other from s union all select *, b me, a other from s),
 c3 as (select distinct a, b, round(s, 3) score, shared from (select *, row_number() over (partition by me order by s desc, other desc) r from e) where r <= 10)"""

SQL = {
    "g1_features": W + ", f as (select paper_id, count(*) c from used where element_id in (select element_id from el where facet in ('preparation', 'measurement', 'simulation', 'characterization', 'analysis')) group by 1) select paper_id, coalesce(c, 0) features from pap left join f using (paper_id)",
    "g2_idf": W + _MAT + "select element_id, df, round(idf, 9) idf from w",
    "g3_edges": W + _MAT + _EDGES.format(least=0) + "select * from edges",
    "g4_weak_edges": W + _MAT + _EDGES.format(least=6) + _PAIR.format(name="p", cap="") + """, lonely as (select distinct paper_id from f where paper_id not in (select a from edges union all select b from edges))
 select node, a, b, round(score * 0.5, 6) score from (select *, row_number() over (partition by node order by score desc, a, b) r from (select *, unnest([a, b]) node from p) where node in (select paper_id from lonely)) where r <= 2 and score > 0""",
    "g5_degrees": W + _MAT + _EDGES.format(least=0) + ", d as (select unnest([a, b]) paper_id, score from edges) select paper_id, count(score) degree, round(coalesce(sum(score), 0), 6) weight from pap left join d using (paper_id) group by 1",
    "g10_special": W + _MAT + """select paper_id, case when paper_id in (select paper_id from r) then '__nofacet__' else '__unbuilt__' end "group" from pap where paper_id not in (select paper_id from f)""",
    "g11_names": W + _MAT + """, gr as (select g, paper_id from jr where paper_id in (select paper_id from f)), sz as (select g, count(*) size from gr group by 1),
 c as (select g, element_id, df, idf, size, count(*) c from f join gr using (paper_id) join sz using (g) join w using (element_id) group by 1, 2, 3, 4, 5),
 sc as (select *, round(c / size * least(c / size / ((df - c + 0.5) / greatest((select n from n) - size, 1)), 50.0), 9) score, c / size >= 0.25 wide from c)
 select g journal_key, string_agg(display_name, ' · ' order by r) as name from (select *, row_number() over (partition by g order by wide desc, score desc, round(idf, 9) desc, element_id) r from sc) join el using (element_id) where r <= 2 group by 1""",
    "g14_sessions": """with l as (select loaded_at t, case when loaded_at < lag(loaded_at) over (order by loaded_at) + interval 30 minutes then 0 else 1 end b from papers where loaded_at is not null),
 s as (select t, sum(b) over (order by t rows unbounded preceding) g from l) select min(t) start, max(t) as "end", count(*) papers from s group by g""",
    "g16_years": W + "select y, count(*) papers from yr group by 1",
    "c2_document_frequency": W + _TAG + "select facet, concept, count(*) df from t group by 1, 2",
    "c3_candidate_edges": W + _C3 + "select * from c3",
    "c4_degree_report": W + _C3 + """, dd as (select unnest([a, b]) paper_id from c3), de as (select paper_id, count(dd.paper_id) degree from pap left join dd using (paper_id) group by 1),
 o as (select degree, row_number() over (order by degree) - 1 i, count(*) over () n from de)
 select max(degree) most, min(degree) least, sum((degree = 0)::int) isolated, round(avg(degree), 6) mean, (select degree from o where i = n // 2) median from de""",
    "el16_surfaces": W + "select facet, surface, count(*) n from occ group by 1, 2",
    "el27_coverage": W + "select has_card, paper_id in (select paper_id from r) has_elements, count(*) papers from pap group by 1, 2",
}
QUERIES = {k: globals()[k] for k in [*SQL, "g6_label_propagation", "g7_communities"]}
