"""Queries of clusters, lenses, layout, authors and institutions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.keys import norm_key, unaccented
from evispark.operators import clusters as C
from evispark.operators import graph as G
from evispark.operators import index as I
from evispark.operators import institutions as N
from evispark.operators import registry as R
from evispark.operators.evidence import author_key
from evispark.plans import evidence_queries as EQ
from evispark.plans.graph_queries import _CAP, _MAT, _PAIR, W, _material, g3_edges
from evispark.plans.index_queries import load
from evispark.session import cut
from evispark.tables import latest, table


def rule_labels(ix: I.Index, f: DataFrame) -> DataFrame:
    """Clusters by rule, for queries that take clusters as given: papers by the first eight letters of their least material; those without one are special."""
    l = f.groupBy("paper_id").agg(F.substring(F.min("element_id"), 15, 8).alias("label"))
    return ix.papers.select("paper_id").join(l, "paper_id", "left").withColumn("label", F.coalesce("label", F.lit("__unbuilt__")))


def swept(spark: SparkSession, sf: str):
    """(index, features, n, weights, edges, labels) of the material lens after label propagation."""
    ix, f, n, w = _material(spark, sf)
    edges = cut(G.best_edges(f, w, n))
    return ix, f, n, w, edges, cut(G.label_propagation(edges, f.select("paper_id").distinct()))


def g8_split(spark: SparkSession, sf: str) -> DataFrame:
    ix, f, n, w, edges, labels = swept(spark, sf)
    return C.split_oversized(labels, edges, f, w, n)


def g9_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters by rule after the tiny ones have joined others, at most 40 papers each."""
    ix, f, n, w = _material(spark, sf)
    edges = cut(G.best_edges(f, w, n))
    return C.merge_tiny(rule_labels(ix, f).where("label <> '__unbuilt__'"), edges, most=40)


def g11_cluster_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the clusters by rule."""
    ix, f, n, w = _material(spark, sf)
    groups = rule_labels(ix, f).where("label <> '__unbuilt__'").withColumnRenamed("label", "group")
    return G.name_groups(f, w, groups, ix.elements.select("element_id", "display_name"), n).withColumnRenamed("group", "label")


def g12_names(spark: SparkSession, sf: str) -> DataFrame:
    return G.element_names(table(spark, sf, "elements").where("element_id is not null"))


def g13_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    ix, f, _, w = _material(spark, sf)
    focus = f.groupBy(F.substring("paper_id", 1, 2).alias("p")).agg(F.min("paper_id").alias("paper_id")).select("paper_id")
    return G.neighbours(f, w, focus, names=ix.elements)


def g14_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Papers of the last import batch; the day and hour of loading stand for a batch id."""
    ix, f, n, w = _material(spark, sf)
    p = latest(table(spark, sf, "papers"), ["paper_id"], "loaded_at", ["paper_id", "loaded_at"]).where("paper_id is not null and loaded_at is not null")
    marks = p.select(F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("seq"), F.date_format("loaded_at", "yyyy-MM-dd").alias("batch_id"), "paper_id")
    return C.arrivals(C.latest_batch(marks), ix.papers, f, w, rule_labels(ix, f))


def g14_session(spark: SparkSession, sf: str) -> DataFrame:
    """Papers of the last session of loads, for a library without import marks."""
    return C.latest_session(latest(table(spark, sf, "papers"), ["paper_id"], "loaded_at", ["loaded_at"]))


def g15_route(spark: SparkSession, sf: str) -> DataFrame:
    """Reading route of each cluster by rule: reviews first, then the heaviest papers, the three to start with marked."""
    ix, f, n, w = _material(spark, sf)
    d = G.degrees(G.best_edges(f, w, n), ix.papers.select("paper_id"))
    p = rule_labels(ix, f).join(d, "paper_id").join(ix.papers.select("paper_id", F.coalesce(F.lower("paper_type").contains("review"), F.lit(False)).alias("review")), "paper_id")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("review"), F.desc("weight"), "paper_id"))
    return p.select("label", "paper_id", rank.alias("rank"), "review").withColumn("start", F.col("rank") <= 3)


def affiliations(spark: SparkSession, sf: str) -> DataFrame:
    """(paper_id, names): affiliations by rule, as the tables have none: a university of a nation by the paper's number, for even numbers a second one in another spelling; none for multiples of five."""
    k = F.expr("try_cast(regexp_extract(paper_id, '([0-9]+)$', 1) as bigint)")
    p = load(spark, sf).papers.select("paper_id", k.alias("k")).where("k is not null")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"), "n_name")
    e = p.where("k % 5 <> 0").select("paper_id", F.explode(F.array_compact(F.array(F.struct(F.lit(0).alias("i"), (F.col("k") % 25).alias("key")), F.when(F.col("k") % 2 == 0, F.struct(F.lit(1).alias("i"), (F.col("k") * 7 % 25).alias("key")))))).alias("x")).select("paper_id", "x.*").join(F.broadcast(n), "key")  # 25 nations
    name = F.when(F.col("i") == 0, F.concat(F.lit("University of "), "n_name")).otherwise(F.concat(F.lit("university  of "), F.lower("n_name")))
    g = e.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", name.alias("name")))), lambda x: x["name"]).alias("names"))
    return p.select("paper_id").join(g, "paper_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def _institutions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    none = spark.createDataFrame([], "element_id string, facet string, display_name string, aliases array<string>, redirect_to string, ordinal string")
    rows, new = N.resolve(affiliations(spark, sf).withColumnRenamed("paper_id", "row"), none, none.select("element_id", F.col("element_id").alias("final")))
    return cut(rows.withColumnRenamed("row", "paper_id")), new


def _lens(spark: SparkSession, sf: str) -> DataFrame:
    rows, new = _institutions(spark, sf)
    place = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey % 9 <> 4").select(norm_key(F.concat(F.lit("University of "), "n_name")).alias("key"), F.col("r_name").alias("continent"))
    places = new.select(F.col("element_id").alias("institution"), norm_key(F.col("display_name")).alias("key")).join(F.broadcast(place), "key")  # 25 nations
    return C.institution_lens(rows.select("paper_id", F.explode("institution_ids").alias("institution")), load(spark, sf).papers, places)


def g17_institutions(spark: SparkSession, sf: str) -> DataFrame:
    """Main institution and continent of each paper; nations 4, 13 and 22 have no known continent."""
    return _lens(spark, sf)


def g17_top(spark: SparkSession, sf: str) -> DataFrame:
    return C.top_institutions(_lens(spark, sf))


def q13_institution_elements(spark: SparkSession, sf: str) -> DataFrame:
    """The three elements of each facet that each institution's papers use most."""
    rows, _ = _institutions(spark, sf)
    return I.profile(load(spark, sf), rows.select(F.explode("institution_ids").alias("group"), "paper_id"), 3).withColumnRenamed("group", "institution")


def g18_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters after new papers came to an unchanged library: those with a number that 10 divides are new, and take the cluster of their nearest old paper."""
    ix, f, n, w = _material(spark, sf)
    now = C.fingerprints(f)
    fresh = F.col("paper_id").rlike("0$")
    labels = rule_labels(ix, f).where("label <> '__unbuilt__'").where(~fresh)
    state, placed = C.place_incrementally(now.where(~fresh), now, f, w, labels)
    return placed.withColumn("state", F.lit(state))


def g19_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Names given by hand to clusters by rule: one snapshot as it is now, one that lacks the last paper, for every cluster of two or more."""
    ix, f, n, w = _material(spark, sf)
    l = cut(rule_labels(ix, f))
    m = l.groupBy("label").agg(F.array_sort(F.collect_set("paper_id")).alias("members")).where("size(members) > 1")
    short = F.slice("members", F.lit(1), F.size("members") - 1)
    hashed = lambda x: F.left(F.sha2(F.array_join(x, "|"), 256), F.lit(16))
    whole = F.length("label") % 2 == 0
    meta = m.select(hashed(F.when(whole, F.col("members")).otherwise(short)).alias("key"), F.when(whole, F.col("members")).otherwise(short).alias("members"), F.upper("label").alias("label_by_hand"), F.col("label").alias("seq"))
    return C.overlay(l, meta)


def g20_todo(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters by rule that await a description: those of an odd number of letters have none."""
    ix, f, n, w = _material(spark, sf)
    l = cut(rule_labels(ix, f))
    return C.to_describe(l, ix.papers, l.where("length(label) % 2 = 0").select("label"))


def g21_layout(spark: SparkSession, sf: str) -> DataFrame:
    ix, f, n, w = _material(spark, sf)
    years = ix.papers.select("paper_id", I.year_of(F.col("year")).alias("year"))
    p = C.radial_layout(rule_labels(ix, f), years)
    return p.select("paper_id", "label", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    ix, f, n, w = _material(spark, sf)
    fresh = F.col("paper_id").rlike("0$")
    pos = cut(C.radial_layout(rule_labels(ix, f).where(~fresh), ix.papers.select("paper_id", I.year_of(F.col("year")).alias("year"))))
    new = ix.papers.select("paper_id").where(fresh)
    near = G.nearest(f.join(w.select("element_id", "idf"), "element_id"), new, 3, pos).select(F.col("me").alias("paper_id"), "other", "score")
    return C.place_new(pos, near, new)


def g22_placed(spark: SparkSession, sf: str) -> DataFrame:
    """First places of new papers (a number that 10 divides) on the map of the others."""
    return _placed(spark, sf).select("paper_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def g22_relaxed(spark: SparkSession, sf: str) -> DataFrame:
    return C.relax(_placed(spark, sf)).select("paper_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def g25_closeup(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of ten papers: typed by rule from the edges of the lens (by score: supports, complements), and the most similar ones."""
    ix, f, n, w = _material(spark, sf)
    focus = cut(f.groupBy(F.substring("paper_id", 1, 2).alias("p")).agg(F.min("paper_id").alias("focus")).select("focus"))
    e = G.best_edges(f, w, n, 4)
    typed = e.select("a", "b", F.when(F.col("score") > 6, "supports").otherwise("complements").alias("relation"), F.concat("a", F.lit("|"), "b").alias("seq"))
    near = G.neighbours(f, w, focus.withColumnRenamed("focus", "paper_id"), 20).select("focus", "paper_id", "rank")
    return C.closeup(focus, typed, near)


def a1_senior_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Papers by the identity of their last author; DOIs and names without one are left out."""
    a = latest(table(spark, sf, "authors").where("trim(doi) <> ''").withColumn("key", F.lower(F.trim("doi"))), ["key"], "fetched_at", ["authors"])
    p = load(spark, sf).papers.select("paper_id", F.lower(F.trim("doi")).alias("key"))
    j = p.join(a, "key").withColumn("anchor", F.try_element_at("authors", F.lit(-1))).withColumn("identity", author_key(unaccented(F.col("anchor")))).where("identity <> ''")
    return j.groupBy("identity").agg(F.count("*").alias("papers"), F.min_by("anchor", "paper_id").alias("name"), F.min("paper_id").alias("first_paper"))


def a3_institutions(spark: SparkSession, sf: str) -> DataFrame:
    return _institutions(spark, sf)[0].select("paper_id", F.array_join("institution_ids", ",").alias("ids"))


def front_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks with a line of affiliation before every third one, as the tables' first pages have none."""
    b = EQ.blocks(spark, sf)
    line = F.concat(F.lit("  Department, University of "), "section_kind", F.lit("\n"))
    return b.select("paper_id", F.col("id").alias("place"), "page_start", F.when(F.col("block_order") % 3 == 0, F.concat(F.coalesce(line, F.lit("")), F.coalesce("text", F.lit("")))).otherwise(F.col("text")).alias("text"))


def a4_front_page(spark: SparkSession, sf: str) -> DataFrame:
    return N.front_page(front_blocks(spark, sf)).select("paper_id", F.array_join("affiliations", "|").alias("affiliations"))


def a5_population(spark: SparkSession, sf: str) -> DataFrame:
    """Papers by how their authorship was found; those with a number that 9 divides have one already."""
    p = load(spark, sf).papers
    got = table(spark, sf, "authors").where("trim(doi) <> '' and size(authors) > 0").select(F.lower(F.trim("doi")).alias("doi_key"))
    front = N.front_page(front_blocks(spark, sf).where("place rlike '[13579]$'"))
    s = N.population(p, got, front, p.where("try_cast(regexp_extract(paper_id, '([0-9]+)$', 1) as bigint) % 9 = 0"))
    return s.groupBy("status").agg(F.count("*").alias("papers"))


def _cards(spark: SparkSession, sf: str) -> DataFrame:
    """(paper_id, authors): card authors by rule: one per affiliation."""
    a = affiliations(spark, sf).where("size(names) > 0")
    return a.select("paper_id", F.transform("names", lambda x, i: F.struct(F.concat(F.lit(" Author "), i.cast("string")).alias("name"), F.array(x, F.lit(""), F.lit("Odd & Place")).alias("affiliations"))).alias("authors"))


def a6_card_authors(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("elem:institution/n"), F.col("n_nationkey").cast("string")).alias("element_id"), F.concat(F.lit("University of "), "n_name").alias("display_name"))
    old = load(spark, sf).papers.where("paper_id rlike '3$'")
    return N.card_authors(_cards(spark, sf), old, known).select("paper_id", "position", "name", F.array_join("institution_ids", ",").alias("ids"))


def a7_countries(spark: SparkSession, sf: str) -> DataFrame:
    _, new = _institutions(spark, sf)
    found = table(spark, sf, "nation").where("n_nationkey % 4 <> 3").select(F.concat(F.lit("University of "), "n_name").alias("name"), F.when(F.col("n_nationkey") % 4 != 2, F.lower(F.left("n_name", F.lit(2)))).alias("country"))
    i = new.select("element_id", "display_name", F.when(F.length("display_name") % 6 == 0, "XX").alias("country"), F.lit(None).cast("string").alias("redirect_to"))
    return N.countries(i, found)


def a8_view(spark: SparkSession, sf: str) -> DataFrame:
    """The single-paper view of all papers; those with a number that 7 divides have no elements and show their atoms."""
    o = latest(table(spark, sf, "occurrences"), ["occ_id"], "loaded_at", ["paper_id", "facet", "surface", "role"]).where("occ_id is not null and paper_id is not null")
    rows = o.where("try_cast(regexp_extract(paper_id, '([0-9]+)$', 1) as bigint) % 7 <> 0").select("paper_id", F.col("occ_id").alias("place"), I.clean_role(F.col("role")).alias("role"), "facet", "surface")
    return N.decomposition(rows, EQ.atoms(spark, sf), EQ.load_papers(spark, sf))


def a9_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Papers whose authorship must be read from their first page."""
    b = front_blocks(spark, sf)
    first = b.groupBy("paper_id").agg(F.min("page_start").alias("first"))
    pages = b.join(first, "paper_id").select("paper_id", "place", (F.col("page_start") - F.col("first") + 1).alias("page"), "text")
    a = _institutions(spark, sf)[0].where("paper_id rlike '[0-7]$'")
    t = N.backfill_targets(load(spark, sf).papers, a, pages)
    return t.select("paper_id", "reason", F.sha2("text", 256).alias("text"), F.length("text").alias("chars"))


_EDGE = _MAT + _PAIR.format(name="s", cap=_CAP) + """, ends as (select *, unnest([a, b]) node from s where score > 0), edges as (select distinct a, b, score, shared from (select *, row_number() over (partition by node order by score desc, a, b) r from ends) where r <= {k}),
 rl as (select pap.paper_id, coalesce(l, '__unbuilt__') label from pap left join (select paper_id, substring(min(element_id), 15, 8) l from f group by 1) q using (paper_id))"""
_K8 = _EDGE.format(k=8)
_SLUG = r"coalesce(nullif(regexp_replace(regexp_replace(lower(trim({})), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unnamed')"
_NK = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_AFF = rf""", pk as (select paper_id, try_cast(nullif(regexp_extract(paper_id, '([0-9]+)$', 1), '') as bigint) k from pap), af0 as (select paper_id, 0 i, 'University of ' || n_name nm from pk join nation on n_nationkey = k % 25 where k % 5 <> 0 union all select paper_id, 1, 'university  of ' || lower(n_name) from pk join nation on n_nationkey = k * 7 % 25 where k % 5 <> 0 and k % 2 = 0),
 ik as (select *, {_NK.format('nm')} as key from af0), ent as (select key, 'elem:institution/' || {_SLUG.format('arg_min(nm, (paper_id, i))')} id, arg_min(nm, (paper_id, i)) display_name from ik group by 1),
 ii as (select paper_id, id, min(i) i from ik join ent using (key) group by 1, 2), ins as (select pk.paper_id, coalesce(l, []) ids from pk left join (select paper_id, list(id order by i) l from ii group by 1) q using (paper_id) where k is not null)"""
_INST = _AFF + f""", ic as (select id, count(*) n from ii group by 1), mn as (select paper_id, id institution, n size from (select paper_id, id, n, row_number() over (partition by paper_id order by n desc, id) r from ii join ic using (id)) where r = 1),
 plc as (select ent.id, r_name from ent join nation on {_NK.format("'University of ' || n_name")} = ent.key join region on n_regionkey = r_regionkey where n_nationkey % 9 <> 4),
 lens as (select pap.paper_id, institution, coalesce(size, 0) size, coalesce('cont:' || r_name, '__unknown__') cluster from pap left join mn using (paper_id) left join plc on plc.id = institution)"""
_FRONT = """, fb as (select paper_id, id place, page_start, case when block_order % 3 = 0 then coalesce('  Department, University of ' || section_kind || chr(10), '') || coalesce(text, '') else text end text from bt)"""
_LINES = """, fr as (select *, row_number() over (partition by paper_id order by place) r from fb{w}), fl as (select paper_id, r, trim(unnest(string_split(replace(coalesce(text, ''), chr(13), chr(10)), chr(10)))) line, unnest(range(0, 1 + length(replace(coalesce(text, ''), chr(13), chr(10))) - length(replace(replace(coalesce(text, ''), chr(13), chr(10)), chr(10), '')))) k from fr where r <= 12),
 ff as (select paper_id, line, min((r, k)) w from fl where regexp_matches(line, 'University|Institute|Laboratory|College|Academy|School of') group by 1, 2), fp as (select paper_id, string_agg(line, '|' order by w) affiliations from (select *, row_number() over (partition by paper_id order by w) n from ff) where n <= 6 group by 1)"""
_RING = """, disc as (select label, n, (label in ('__misc__', '__unbuilt__'))::int pin, 0.05::double + 0.22::double * sqrt(n / sum(n) over ()) r, row_number() over (order by (label in ('__misc__', '__unbuilt__'))::int, n desc, label) i from (select label, count(*) n from {src} group by 1)),
 ring(i, label, r, x, y, reach, no, d, first, angle, widest, mixed) as (select i, label, r, 0.0::double, 0.0::double, r, 0, -1.0::double, 0.0::double, 0.0::double, 0.0::double, false from disc where i = 1
  union all select i, label, r, d * cos(angle + half), d * sin(angle + half), reach, no, d, first, angle + 2 * half, greatest(widest, r), mixed or pin = 0 from (select *, case when (r + 0.0075) / d >= 0.9 then pi() else asin((r + 0.0075) / d) end half from (
   select t.i, t.label, t.r, t.pin, case when nw then p.no + 1 else p.no end no, case when nw then rc + 0.015 + t.r else p.d end d, case when nw then (p.no + 1) * 0.7 else p.first end first, case when nw then (p.no + 1) * 0.7 else p.angle end angle, case when nw then 0.0 else p.widest end widest, case when nw then false else p.mixed end mixed, case when nw then rc else p.reach end reach
   from (select p0.*, t0.i ti, case when p0.d < 0 then p0.reach else p0.d + p0.widest end rc, p0.d < 0 or (t0.pin = 1 and p0.mixed) or ((t0.r + 0.0075) / p0.d >= 0.9 and p0.widest > 0) or (case when (t0.r + 0.0075) / p0.d >= 0.9 then p0.angle + 2 * pi() else p0.angle + 2 * asin(least(1.0, (t0.r + 0.0075) / p0.d)) end) > p0.first + 2 * pi() + 1e-9 nw from ring p0 join disc t0 on t0.i = p0.i + 1) p join disc t on t.i = p.ti))),
 pts as (select q.paper_id, q.label, ring.x + case when n = 1 then 0 else r * 0.85 * sqrt((k + 0.5) / n) end * cos(phase + k * (pi() * (3 - sqrt(5)))) x, ring.y + case when n = 1 then 0 else r * 0.85 * sqrt((k + 0.5) / n) end * sin(phase + k * (pi() * (3 - sqrt(5)))) y
  from (select l.paper_id, l.label, row_number() over (partition by l.label order by coalesce(yr.y, 9999), l.paper_id) - 1 k, count(*) over (partition by l.label) n, (('0x' || left(sha256(l.label), 8))::bigint % 6283) / 1000.0 phase from {src} l left join yr using (paper_id)) q join ring using (label)),
 box as (select (max(x) + min(x)) / 2 cx, (max(y) + min(y)) / 2 cy, coalesce(nullif(greatest(max(x) - min(x), max(y) - min(y)), 0), 1.0) span from pts), lay as (select paper_id, label, 0.5 + (x - cx) * 0.9 / span x, 0.5 + (y - cy) * 0.9 / span y from pts, box)"""
_WR = W.replace("with ", "with recursive ", 1)
_NAME = r"trim(regexp_replace(strip_accents(a[len(a)]), '\s+', ' ', 'g'))"
SQL = {
    "g9_merged": _WR + _K8 + """, lb as (select * from rl where label <> '__unbuilt__'), sz as (select label, count(*) n from lb group by 1), cw as (select t, o, round(sum(score), 9) w from (select x.label t, y.label o, score from edges join lb x on x.paper_id = a join lb y on y.paper_id = b union all select y.label, x.label, score from edges join lb x on x.paper_id = a join lb y on y.paper_id = b) where t <> o group by 1, 2),
 tiny as (select label, n, row_number() over (order by label) i from sz where n < 3), of_ as (select t label, list(o order by w desc, o) os from cw where t in (select label from tiny) and o in (select label from sz where n >= 3) group by 1),
 st(i, label, dest, now) as (select 0, ''::varchar, ''::varchar, (select map_from_entries(list((label, n::bigint))) from sz where n >= 3) union all
  select tn.i, tn.label, d, case when d = '__misc__' then now else map_from_entries(list_transform(map_entries(now), lambda e: {'key': e.key, 'value': case when e.key = d then e.value + tn.n else e.value end})) end from (select st.now, tiny.*, coalesce(list_filter(coalesce(os, []), lambda c: element_at(st.now, c)[1] + tiny.n <= case when tiny.n = 1 then 42 else 40 end)[1], '__misc__') d from st join tiny on tiny.i = st.i + 1 left join of_ on of_.label = tiny.label) tn)
 select lb.paper_id, coalesce(dest, lb.label) label from lb left join st using (label)""",
    "g11_cluster_names": W + _K8 + """, gr as (select label g, paper_id from rl where label <> '__unbuilt__'), sz as (select g, count(*) size from gr group by 1), c as (select g, element_id, df, idf, size, count(*) c from f join gr using (paper_id) join sz using (g) join w using (element_id) group by 1, 2, 3, 4, 5),
 sc as (select *, round(c / size * least(c / size / ((df - c + 0.5) / greatest((select n from n) - size, 1)), 50.0), 9) score, c / size >= 0.25 wide from c)
 select g as label, string_agg(display_name, ' · ' order by r) as name from (select *, row_number() over (partition by g order by wide desc, score desc, round(idf, 9) desc, element_id) r from sc) join el using (element_id) where r <= 2 group by 1""",
    "g12_names": "select element_id, coalesce(nullif(trim(max(display_name)), ''), string_split(element_id, '/')[-1]) display_name from elements where element_id is not null group by 1",
    "g13_neighbours": W + _MAT + """, fo as (select min(paper_id) focus from f group by left(paper_id, 2)), m as (select f.element_id, idf, paper_id focus from f join w using (element_id) where paper_id in (select focus from fo)),
 s as (select focus, paper_id, round(sum(idf), 9) raw, count(*) shared, (list(element_id order by round(idf, 9) desc, element_id))[1:3] best from f join m using (element_id) where paper_id <> focus group by 1, 2),
 k as (select *, row_number() over (partition by focus order by raw desc, paper_id) rank from s where raw > 0)
 select focus, paper_id, round(raw, 3) score, shared, rank, (select string_agg(display_name, ' · ' order by i) from (select unnest(best) e, generate_subscripts(best, 1) i) u join el on el.element_id = u.e) as names from k where rank <= 10""",
    "g14_arrivals": W + _K8 + """, ld as (select paper_id, loaded_at t, strftime(loaded_at, '%Y-%m-%d') bid from pap where loaded_at is not null), last as (select arg_max(bid, t) l from ld), stt as (select coalesce(max(t), timestamp '1970-01-01') s from ld, last where bid <> l), bat as (select paper_id from ld, last, stt where bid = l and t > s),
 sc as (select x.paper_id me, y.paper_id o, round(sum(idf), 9) s from f x join f y using (element_id) join w using (element_id) where x.paper_id in (select paper_id from bat) and y.paper_id not in (select paper_id from bat) group by 1, 2), rk as (select *, row_number() over (partition by me order by s desc, o) k from sc where s > 0), nb as (select me, string_agg(o, ',' order by k) l from rk where k <= 3 group by 1)
 select bat.paper_id, label as cluster, coalesce(l, '') neighbours, l is null isolated from bat join rl using (paper_id) left join nb on me = bat.paper_id""",
    "g14_session": W + """, ld as (select paper_id, loaded_at t, case when loaded_at < lag(loaded_at) over (order by loaded_at) + interval 30 minutes then 0 else 1 end b from pap where loaded_at is not null), s as (select *, sum(b) over (order by t rows unbounded preceding) g from ld) select paper_id from s where g = (select max(g) from s)""",
    "g15_route": W + _K8 + """, dd as (select unnest([a, b]) paper_id, score from edges), de as (select pap.paper_id, round(coalesce(sum(score), 0), 6) weight, coalesce(contains(lower(paper_type), 'review'), false) review from pap left join dd using (paper_id) group by pap.paper_id, paper_type),
 o as (select label, paper_id, row_number() over (partition by label order by review desc, weight desc, paper_id) rank, review from rl join de using (paper_id)) select *, rank <= 3 as start from o""",
    "g17_institutions": W + _INST + " select paper_id, institution, size, cluster from lens",
    "g17_top": W + _INST + ", c as (select cluster, institution, count(*) papers from lens where institution is not null and cluster <> '__unknown__' group by 1, 2) select * from (select *, row_number() over (partition by cluster order by papers desc, institution) rank from c) where rank <= 5",
    "q13_institution_elements": W + _AFF + ", n as (select id institution, facet, element_id, display_name, count(*) n from used join ii using (paper_id) join el using (element_id) group by 1, 2, 3, 4) select * from (select *, row_number() over (partition by institution, facet order by n desc, display_name, element_id) rank from n) where rank <= 3",
    "g18_incremental": W + _K8 + """, ol as (select * from rl where label <> '__unbuilt__' and paper_id not like '%0'), sc as (select x.paper_id me, y.paper_id o, round(sum(idf), 9) s from f x join f y using (element_id) join w using (element_id) where x.paper_id like '%0' and y.paper_id not like '%0' group by 1, 2), rk as (select *, row_number() over (partition by me order by s desc, o) k from sc where s > 0)
 select paper_id, label, 'grown' state from ol union all select p.paper_id, coalesce(label, '__misc__'), 'grown' from (select distinct paper_id from f where paper_id like '%0') p left join rk on me = p.paper_id and k = 1 left join rl on rl.paper_id = rk.o""",
    "g19_overlay": W + _K8 + """, m as (select label, list(paper_id order by paper_id) mem from rl group by 1), mt as (select left(sha256(array_to_string(ms, '|')), 16) as key, ms, upper(label) hand, label seq from (select label, case when length(label) % 2 = 0 then mem else mem[1:-2] end ms from m where len(mem) > 1)),
 own as (select label, mem, left(sha256(array_to_string(mem, '|')), 16) members_key from m), sim as (select own.label, mt.hand, mt.seq, len(list_intersect(mem, ms)) / (len(mem) + len(ms) - len(list_intersect(mem, ms))) j from own, mt where own.label not in ('__misc__', '__unbuilt__', '__nofacet__', '__unknown__')),
 best as (select label, arg_max(hand, (j, seq)) hand from sim where j >= 0.5 group by 1)
 select own.label, members_key, case when x.key is not null then x.hand else best.hand end shown, case when x.key is not null then 'exact' when best.hand is not null then 'similar' end how from own left join mt x on x.key = members_key left join best on best.label = own.label""",
    "g20_todo": W + _K8 + """, t as (select label, paper_id, title, row_number() over (partition by label order by paper_id) r, count(*) over (partition by label) papers from rl join pap using (paper_id) where label not in ('__misc__', '__unbuilt__', '__nofacet__', '__unknown__') and length(label) % 2 = 1)
 select label, papers, coalesce(string_agg(nullif(title, ''), ' | ' order by r), '') titles from t where r <= 12 group by 1, 2""",
    "g21_layout": _WR + _K8 + _RING.format(src="rl") + " select paper_id, label, round(x, 6) x, round(y, 6) y from lay",
    "g22_placed": _WR + _K8 + ", ro as (select * from rl where paper_id not like '%0')" + _RING.format(src="ro") + """, sc as (select x.paper_id me, y.paper_id o, round(sum(idf), 9) s from f x join f y using (element_id) join w using (element_id) where x.paper_id like '%0' and y.paper_id not like '%0' group by 1, 2), rk as (select *, row_number() over (partition by me order by s desc, o) k from sc),
 ce as (select me, case when sum(s) = 0 then 1.0 else sum(s) end w, sum(lay.x * s) sx, sum(lay.y * s) sy from rk join lay on lay.paper_id = o where k <= 3 group by 1), b as (select paper_id, ('0x' || substring(sha256(paper_id), 1, 2))::int / 255.0::double b0, ('0x' || substring(sha256(paper_id), 3, 2))::int / 255.0::double b1, ('0x' || substring(sha256(paper_id), 5, 2))::int / 255.0::double b2 from pap where paper_id like '%0')
 select paper_id, round(greatest(0.0, least(1.0, coalesce(sx / w, 0.5 + 0.45 * cos(b2 * 2 * pi())) + (b0 - 0.5) * 0.04)), 6) x, round(greatest(0.0, least(1.0, coalesce(sy / w, 0.5 + 0.45 * sin(b2 * 2 * pi())) + (b1 - 0.5) * 0.04)), 6) y from b left join ce on me = paper_id""",
    "g25_closeup": W + _EDGE.format(k=4) + """, fo as (select min(paper_id) focus from f group by left(paper_id, 2)), ty as (select a, b, case when score > 6 then 'supports' else 'complements' end relation, a || '|' || b seq from edges), en as (select a focus, b paper_id, relation, seq from ty union all select b, a, relation, seq from ty),
 fi as (select focus, paper_id, arg_min(relation, seq) relation, min(seq) seq from en where focus in (select focus from fo) group by 1, 2), inn as (select focus, paper_id, 'inner' ring, relation, row_number() over (partition by focus order by seq, paper_id) rank from fi),
 sc as (select x.paper_id focus, y.paper_id, round(sum(idf), 9) s from f x join f y using (element_id) join w using (element_id) where x.paper_id in (select focus from fo) and y.paper_id <> x.paper_id group by 1, 2), nr as (select *, row_number() over (partition by focus order by s desc, paper_id) r from sc where s > 0),
 ou as (select focus, paper_id, 'outer' ring, null::varchar relation, row_number() over (partition by focus order by r) rank from nr where r <= 20 and (focus, paper_id) not in (select (focus, paper_id) from inn where rank <= 12))
 select * from inn where rank <= 12 union all select * from ou where rank <= 8""",
    "a1_senior_groups": W + rf""", l as (select lower(trim(doi)) as key, arg_max(struct_pack(x := authors), fetched_at).x a from authors where trim(doi) <> '' group by 1), k as (select paper_id, a[len(a)] anchor, regexp_replace(lower(case when contains({_NAME}, ',') then split_part({_NAME}, ',', 1) else regexp_extract({_NAME}, '(\S+)$', 1) end), '[^a-z]', '', 'g') f,
 left(regexp_replace(lower(case when contains({_NAME}, ',') then regexp_replace({_NAME}, '^[^,]*,', '') else regexp_replace({_NAME}, '\s*\S+$', '') end), '[^a-z]', '', 'g'), 1) g from pap join l on l.key = lower(trim(pap.doi)))
 select case when g = '' then f else f || '_' || g end identity, count(*) papers, arg_min(anchor, paper_id) as name, min(paper_id) first_paper from k where f <> '' group by 1""",
    "a3_institutions": W + _AFF + " select paper_id, array_to_string(ids, ',') ids from ins",
    "a4_front_page": EQ._BT + _FRONT + _LINES.format(w="") + " select * from fp",
    "a5_population": EQ._BT + "," + W.removeprefix("with") + _FRONT + _LINES.format(w=" where regexp_matches(place, '[13579]$')") + """, got as (select distinct lower(trim(doi)) k from authors where trim(doi) <> '' and len(authors) > 0)
 select case when coalesce(try_cast(nullif(regexp_extract(paper_id, '([0-9]+)$', 1), '') as bigint) % 9 = 0, false) then 'skipped_existing' when coalesce(trim(doi), '') = '' then 'skipped_no_doi' when lower(trim(doi)) in (select k from got) then 'populated' when paper_id in (select paper_id from fp) then 'pdf_fallback' else 'failed' end status, count(*) papers from pap group by 1""",
    "a6_card_authors": W + _AFF + r""", c as (select paper_id, i, nm from af0 where not regexp_matches(paper_id, '3$')), cr as (select *, row_number() over (partition by paper_id order by i) p from c),
 kn as (select lower(trim('University of ' || n_name)) as key, 'elem:institution/n' || n_nationkey id from nation where n_nationkey % 2 = 0)
 select paper_id, p as position, 'Author ' || (p - 1) as name, coalesce(kn.id, 'elem:institution/' || trim(regexp_replace(lower(nm), '[^a-z0-9]+', '-', 'g'), '-')) || ',elem:institution/odd-place' ids from cr left join kn on kn.key = lower(trim(nm))""",
    "a7_countries": W + _AFF + """, i as (select id element_id, display_name, case when length(display_name) % 6 = 0 then 'XX' end country from ent), fd as (select 'University of ' || n_name display_name, case when n_nationkey % 4 <> 2 then lower(left(n_name, 2)) end found from nation where n_nationkey % 4 <> 3),
 s as (select i.*, found, case when coalesce(country, '') <> '' then 'skipped' when fd.display_name is null then 'no_hit' when coalesce(found, '') = '' then 'no_country' else 'matched' end state from i left join fd using (display_name)) select element_id, case when state = 'matched' then upper(found) else country end country, state from s""",
    "a8_view": EQ._ATOM + "," + W.removeprefix("with") + """, o2 as (select paper_id, occ_id, facet, surface, case when facet in ('analysis', 'simulation', 'measurement', 'characterization', 'preparation') then 'analysis' when facet = 'finding' then 'result' when facet = 'condition' then 'condition' end part from occ where role = 'used' and occ_id is not null and try_cast(nullif(regexp_extract(paper_id, '([0-9]+)$', 1), '') as bigint) % 7 <> 0),
 o3 as (select *, row_number() over (partition by paper_id order by occ_id) - 1 n from o2 where part is not null), wh as (select distinct paper_id from o3 where part <> 'condition')
 select paper_id, 'elements' source, part, 'EL-' || lpad(n::varchar, 4, '0') id, facet kind, surface claim from o3 where paper_id in (select paper_id from wh)
 union all select paper_id, 'legacy', case when atom_type in ('method', 'variable', 'mechanism') then 'analysis' else 'result' end, atom_id, atom_type, minimal_claim from atoms where atom_type in ('method', 'variable', 'mechanism', 'result', 'quantitative_result') and paper_id not in (select paper_id from wh)
 union all select paper_id, 'elements', 'relation', 'MF-' || lpad(i::varchar, 2, '0'), 'main_finding', c from (select paper_id, unnest(main_findings) c, unnest(range(0, len(main_findings))) i from pap) where paper_id in (select paper_id from wh)""",
    "a9_backfill": EQ._BT + "," + W.removeprefix("with") + _AFF + _FRONT + """, p1 as (select *, page_start - min(page_start) over (partition by paper_id) + 1 page from fb), p2 as (select *, row_number() over (partition by paper_id order by place) r from p1 where page = 1 and text <> ''), tx as (select paper_id, left(string_agg(text, chr(10) order by r), 6000) t from p2 where r <= 30 group by 1),
 au as (select paper_id, max((len(ids) > 0)::int) has from ins where regexp_matches(paper_id, '[0-7]$') group by 1) select pap.paper_id, case when has is null then 'missing' else 'no_institution' end reason, sha256(coalesce(t, '')) text, length(coalesce(t, '')) chars from pap left join au using (paper_id) left join tx using (paper_id) where coalesce(has, 0) = 0""",
}
QUERIES = {k: globals()[k] for k in [*SQL, "g8_split", "g22_relaxed"]}
