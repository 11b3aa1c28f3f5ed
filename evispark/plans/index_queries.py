"""Queries over the element index and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.operators import index as I
from evispark.session import ranked
from evispark.tables import latest, table


def load(spark: SparkSession, sf: str) -> I.Index:
    """The index of one data folder; repeated deliveries count once."""
    occ = latest(table(spark, sf, "occurrences"), ["occ_id"], "loaded_at", ["paper_id", "element_id", "facet", "surface", "role", "values_json"])
    rows = occ.where("element_id is not null and paper_id is not null").withColumn("role", I.clean_role(F.col("role"))).withColumnRenamed("facet", "occ_facet")
    fields = ["title", "year", "journal", "doi", "paper_type", "domain_tags", "methods", "research_objects", "main_findings", "has_card"]
    papers = latest(table(spark, sf, "papers"), ["paper_id"], "loaded_at", fields)
    elements = table(spark, sf, "elements").select("element_id", "facet", "slug", "display_name", "aliases_json", "human_locked").dropDuplicates(["element_id"])
    return I.Index(elements, rows, papers)


def top_elements(ix: I.Index, k: int) -> DataFrame:
    """The k elements used in most papers: k rows."""
    n = I.by_role(ix.rows, "used").join(ix.elements.select("element_id"), "element_id", "left_semi").groupBy("element_id").agg(F.countDistinct("paper_id").alias("n"))
    return n.orderBy(F.desc("n"), "element_id").limit(k).select("element_id")


def journals(ix: I.Index) -> DataFrame:
    """(group, paper_id) by journal, the grouping that stands for institutions and clusters here."""
    return ix.papers.where(F.trim("journal") != "").select(F.lower(F.trim("journal")).alias("group"), "paper_id")


OCC = r"""
 occ as (select * exclude(rn, role), nullif(lower(trim(role)), '') as role from (select *, row_number() over (partition by occ_id order by loaded_at desc) rn from occurrences) where rn = 1),
 r as (select * from occ where element_id is not null and paper_id is not null),
 pap as (select * exclude rn from (select *, row_number() over (partition by paper_id order by loaded_at desc) rn from papers) where rn = 1),
 el as (select distinct element_id, facet, slug, display_name, aliases_json from elements),
 used as (select distinct paper_id, element_id from r where role = 'used'),
 ranked as (select element_id, row_number() over (order by count(*) desc, element_id) k from used where element_id in (select element_id from el) group by 1),
 jr as (select lower(trim(journal)) g, paper_id from pap where trim(journal) <> ''),
 yr as (select paper_id, try_cast(nullif(regexp_extract(coalesce(year, ''), '((?:18|19|20)[0-9]{2})', 1), '') as int) y from pap)
"""
W = "with " + OCC
SLUG = r"coalesce(nullif(regexp_replace(regexp_replace(lower(trim(t)), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unnamed')"


def q0_index(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per facet of the built index, topics included."""
    ix = load(spark, sf)
    rows = ix.rows.join(ix.elements.select("element_id"), "element_id", "left_semi").select("paper_id", "element_id", "role", "surface")
    both = rows.unionByName(I.topic_rows(ix.papers, ix.rows))
    facet = F.regexp_extract("element_id", "^[^:]*:([^/]*)/", 1)
    return both.groupBy(facet.alias("facet")).agg(F.count("*").alias("n_rows"), F.countDistinct("element_id").alias("elements"), F.countDistinct("paper_id").alias("papers"))


def q1_facet_stats(spark: SparkSession, sf: str) -> DataFrame:
    return I.facet_stats(load(spark, sf), "material", "used").drop("slug")


def q2_overview(spark: SparkSession, sf: str) -> DataFrame:
    return I.overview(load(spark, sf), None)


def q3_search(spark: SparkSession, sf: str) -> DataFrame:
    return I.search(load(spark, sf), "pore")


def q4_detail(spark: SparkSession, sf: str) -> DataFrame:
    ix = load(spark, sf)
    return I.detail(ix, top_elements(ix, 2))


def q5_cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    ix = load(spark, sf)
    return I.cooccurrence(ix, top_elements(ix, 1))


def q6_combination(spark: SparkSession, sf: str) -> DataFrame:
    ix = load(spark, sf)
    return I.combination(ix, top_elements(ix, 2), 2)


def q7_paper_elements(spark: SparkSession, sf: str) -> DataFrame:
    return I.paper_elements(load(spark, sf))


def q8_linked_counts(spark: SparkSession, sf: str) -> DataFrame:
    ix = load(spark, sf)
    return I.linked_counts(ix, top_elements(ix, 2), 2)


def q9_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct papers by role filter; `all` is no filter."""
    ix = load(spark, sf)
    count = lambda role: I.by_role(ix.rows, role).agg(F.lit(role).alias("role"), F.countDistinct("paper_id").alias("papers"), F.count("*").alias("n_rows"))
    return count("all").unionAll(count("used")).unionAll(count("mentioned")).unionAll(count("nonsense"))


def q10_profile(spark: SparkSession, sf: str) -> DataFrame:
    ix = load(spark, sf)
    return I.profile(ix, I.with_all(ix.rows, top_elements(ix, 1), 1).withColumn("group", F.lit("with top element"))).drop("group")


def q11_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return I.first_seen(load(spark, sf))


def q12_first_seen_range(spark: SparkSession, sf: str) -> DataFrame:
    """Elements first used from 2000 to 2010, and whether a paper of the top element's set has them."""
    ix = load(spark, sf)
    seen = I.first_seen(ix, "used").where(F.col("first_year").between(2000, 2010))
    scope = I.by_role(ix.rows, "used").join(I.with_all(ix.rows, top_elements(ix, 1), 1), "paper_id", "left_semi").select("element_id").distinct().withColumn("s", F.lit(True))
    return seen.join(scope, "element_id", "left").withColumn("in_scope", F.coalesce("s", F.lit(False))).drop("s")


def q13_journal_elements(spark: SparkSession, sf: str) -> DataFrame:
    ix = load(spark, sf)
    return I.profile(ix, journals(ix), 3).withColumnRenamed("group", "journal_key")


def q14_cluster_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Top 5 elements per journal without conditions and findings; journals of 3 papers or more keep those in 2 or more."""
    ix = load(spark, sf)
    groups = journals(ix)
    size = groups.groupBy("group").agg(F.count("*").alias("size"))
    slim = I.Index(ix.elements.where("facet not in ('condition', 'finding')"), ix.rows, ix.papers)
    r = I.by_role(slim.rows, "used").select("paper_id", "element_id").distinct().join(groups, "paper_id").join(slim.elements.select("element_id", "display_name"), "element_id")
    n = r.groupBy("group", "element_id", "display_name").agg(F.count("*").alias("n")).join(size, "group")
    w = Window.partitionBy("group")
    kept = n.withColumn("singles", F.sum(((F.col("size") >= 3) & (F.col("n") < 2)).cast("int")).over(w)).where("size < 3 or n >= 2")
    return kept.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "display_name", "element_id"))).where("rank <= 5").withColumnRenamed("group", "journal_key")


def q15_papers(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf).papers
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    return p.select("paper_id", "title", "journal", "paper_type", size("domain_tags").alias("n_tags"), size("methods").alias("n_methods"), size("main_findings").alias("n_findings"))


def q16_authors(spark: SparkSession, sf: str) -> DataFrame:
    """Author lists by position, DOI case ignored, latest fetch."""
    a = table(spark, sf, "authors").where("doi is not null").withColumn("key", F.lower(F.trim("doi")))
    last = latest(a, ["key"], "fetched_at", ["authors"])
    return last.select("key", F.posexplode("authors").alias("position", "name")).where("trim(name) <> ''")


def q17_paper_list(spark: SparkSession, sf: str) -> DataFrame:
    """Papers that have `pore` in title or journal, newest first, undated last, with the review flag."""
    p = load(spark, sf).papers.select("paper_id", "title", "journal", I.year_of(F.col("year")).alias("y"))
    hit = p.where(F.lower(F.coalesce("title", F.lit(""))).contains("pore") | F.lower(F.coalesce("journal", F.lit(""))).contains("pore"))
    hit = hit.withColumn("is_review", F.coalesce(F.lower("title").rlike("review|overview|survey"), F.lit(False)))
    return ranked(hit, "at", F.col("y").desc_nulls_last(), F.lower("title").asc_nulls_last(), "paper_id")


def q18_facet_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Elements per facet and bucket of the linked counts: selected, several, one, none."""
    ix = load(spark, sf)
    chosen = top_elements(ix, 1)
    n = I.linked_counts(ix, chosen, 1).join(F.broadcast(chosen.withColumn("sel", F.lit(True))), "element_id", "left")
    bucket = F.when(F.col("sel"), "selected").when(F.col("n") >= 2, "several").when(F.col("n") == 1, "one").otherwise("none")
    return n.groupBy("facet", bucket.alias("bucket")).agg(F.count("*").alias("elements"), F.sum("n").alias("papers"))


def q19_element_table(spark: SparkSession, sf: str) -> DataFrame:
    """Papers by the three top elements: first surface of each, a dash where there is none."""
    ix = load(spark, sf)
    w = Window.orderBy(F.desc("n"), "element_id")
    n = I.by_role(ix.rows, "used").join(ix.elements.select("element_id"), "element_id", "left_semi").groupBy("element_id").agg(F.countDistinct("paper_id").alias("n")).orderBy(F.desc("n"), "element_id").limit(3)
    top = F.broadcast(n.withColumn("k", F.concat(F.lit("e"), F.row_number().over(w))).select("element_id", "k"))
    cells = I.by_role(ix.rows, "used").join(top, "element_id").groupBy("paper_id").pivot("k", ["e1", "e2", "e3"]).agg(F.min("surface"))
    return cells.na.fill("—", ["e1", "e2", "e3"])


def q20_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Top 5 co-occurring elements per facet with their share of the anchor's papers."""
    ix = load(spark, sf)
    n = I.cooccurrence(ix, top_elements(ix, 1))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("papers"), "display_name", "element_id"))
    return n.withColumn("rank", rank).where("rank <= 5").withColumn("ratio", F.col("papers") / F.col("anchor_papers"))


def q21_bars(spark: SparkSession, sf: str) -> DataFrame:
    n = I.facet_stats(load(spark, sf), "simulation", None).select("element_id", "papers")
    return n.withColumn("percent", F.col("papers") * 100.0 / F.max("papers").over(Window.partitionBy()))


def q22_chips(spark: SparkSession, sf: str) -> DataFrame:
    return I.chips(load(spark, sf))


_CO = """, a as (select element_id from ranked where k = 1), ap as (select paper_id from used where element_id in (select element_id from a)),
 co as (select u.element_id, count(*) papers from used u where paper_id in (select paper_id from ap) and element_id not in (select element_id from a) group by 1)"""
_BOTH = ", b as (select element_id from ranked where k <= 2), bp as (select paper_id from used where element_id in (select element_id from b) group by 1 having count(*) = 2)"
_SEEN = """select element_id, facet, display_name, min(case when y is not null then struct_pack(y := y, p := paper_id) end) f, count(*) papers_total
 from (select distinct paper_id, element_id from r {where}) x join el using (element_id) left join yr using (paper_id) group by 1, 2, 3"""

SQL = {
    "q0_index": W + f""", tp as (select distinct paper_id, 'elem:topic/' || {SLUG} element_id from pap, unnest(domain_tags) u(t) where trim(t) <> '' and paper_id in (select paper_id from r)),
 x as (select paper_id, element_id from r where element_id in (select element_id from el) union all select * from tp)
 select regexp_extract(element_id, '^[^:]*:([^/]*)/', 1) facet, count(*) n_rows, count(distinct element_id) elements, count(distinct paper_id) papers from x group by 1""",
    "q1_facet_stats": W + "select element_id, display_name, count(*) papers from used join el using (element_id) where facet = 'material' group by 1, 2",
    "q2_overview": W + """, n as (select facet, element_id, display_name, count(distinct paper_id) papers from (select paper_id, element_id from r) x join el using (element_id) group by 1, 2, 3)
 select * from (select *, count(*) over (partition by facet) elements, row_number() over (partition by facet order by papers desc, display_name, element_id) rank from n) where rank <= 5""",
    "q3_search": W + """select element_id, facet, display_name, (select count(*) from used u where u.element_id = el.element_id) papers from el
 where lower(display_name) like '%pore%' or lower(coalesce(aliases_json, '')) like '%pore%' order by papers desc, element_id limit 50""",
    "q4_detail": W + "select element_id, paper_id, count(*) occurrences, min(surface) first_surface, count(distinct surface) surfaces from r where element_id in (select element_id from ranked where k <= 2) group by 1, 2",
    "q5_cooccurrence": W + _CO + "select element_id, papers, facet, display_name, (select count(*) from ap) anchor_papers from co join el using (element_id)",
    "q6_combination": W + _BOTH + "select paper_id, element_id, count(*) occurrences, min(surface) surface from r where role = 'used' and paper_id in (select paper_id from bp) and element_id in (select element_id from b) group by 1, 2",
    "q7_paper_elements": W + "select paper_id, el.facet, element_id, display_name, count(*) occurrences from (select paper_id, element_id from r) x join el using (element_id) group by 1, 2, 3, 4",
    "q8_linked_counts": W + _BOTH + "select element_id, facet, display_name, (select count(*) from used u where u.element_id = el.element_id and u.paper_id in (select paper_id from bp)) n from el",
    "q9_roles": W + """select 'all' as role, count(distinct paper_id) papers, count(*) n_rows from r union all select 'used', count(distinct paper_id), count(*) from r where role = 'used'
 union all select 'mentioned', count(distinct paper_id), count(*) from r where role = 'mentioned' union all select 'nonsense', count(distinct paper_id), count(*) from r where role = 'nonsense'""",
    "q10_profile": W + _CO + """, n as (select facet, element_id, display_name, count(*) n from used join el using (element_id) where paper_id in (select paper_id from ap) group by 1, 2, 3)
 select * from (select *, row_number() over (partition by facet order by n desc, display_name, element_id) rank from n) where rank <= 5""",
    "q11_first_seen": W + ", s as (" + _SEEN.format(where="") + ") select element_id, facet, display_name, f.y first_year, f.p first_paper, papers_total from s",
    "q12_first_seen_range": W + _CO + ", s as (" + _SEEN.format(where="where role = 'used'") + """) select element_id, facet, display_name, f.y first_year, f.p first_paper, papers_total,
 element_id in (select element_id from used where paper_id in (select paper_id from ap)) in_scope from s where f.y between 2000 and 2010""",
    "q13_journal_elements": W + """, n as (select g journal_key, facet, element_id, display_name, count(*) n from used join jr using (paper_id) join el using (element_id) group by 1, 2, 3, 4)
 select * from (select *, row_number() over (partition by journal_key, facet order by n desc, display_name, element_id) rank from n) where rank <= 3""",
    "q14_cluster_elements": W + """, sz as (select g, count(*) size from jr group by 1), n as (select g journal_key, element_id, display_name, size, count(*) n from used join jr using (paper_id) join sz using (g) join el using (element_id)
 where facet not in ('condition', 'finding') group by 1, 2, 3, 4), m as (select *, sum((size >= 3 and n < 2)::int) over (partition by journal_key) singles from n)
 select * from (select *, row_number() over (partition by journal_key order by n desc, display_name, element_id) rank from m where size < 3 or n >= 2) where rank <= 5""",
    "q15_papers": W + "select paper_id, title, journal, paper_type, coalesce(len(domain_tags), 0) n_tags, coalesce(len(methods), 0) n_methods, coalesce(len(main_findings), 0) n_findings from pap",
    "q16_authors": """with l as (select lower(trim(doi)) as key, arg_max(authors, fetched_at) a from authors where doi is not null group by 1),
 x as (select key, unnest(a) as name, generate_subscripts(a, 1) - 1 as position from l) select * from x where trim(name) <> ''""",
    "q17_paper_list": W + """, h as (select paper_id, title, journal, y from pap join yr using (paper_id) where contains(lower(coalesce(title, '')), 'pore') or contains(lower(coalesce(journal, '')), 'pore'))
 select *, coalesce(regexp_matches(lower(title), 'review|overview|survey'), false) is_review, row_number() over (order by y desc nulls last, lower(title) nulls last, paper_id) as at from h""",
    "q18_facet_tree": W + _CO + """, n as (select element_id, facet, (select count(*) from used u where u.element_id = el.element_id and u.paper_id in (select paper_id from ap)) n from el)
 select facet, case when element_id in (select element_id from a) then 'selected' when n >= 2 then 'several' when n = 1 then 'one' else 'none' end bucket, count(*) elements, sum(n) papers from n group by 1, 2""",
    "q19_element_table": W + """select paper_id, coalesce(min(case when k = 1 then surface end), '—') e1, coalesce(min(case when k = 2 then surface end), '—') e2, coalesce(min(case when k = 3 then surface end), '—') e3
 from r join ranked using (element_id) where role = 'used' and k <= 3 group by 1""",
    "q20_panel": W + _CO + """, n as (select element_id, papers, facet, display_name, (select count(*) from ap) anchor_papers from co join el using (element_id))
 select *, papers / anchor_papers ratio from (select *, row_number() over (partition by facet order by papers desc, display_name, element_id) rank from n) where rank <= 5""",
    "q21_bars": W + ", n as (select element_id, count(distinct paper_id) papers from (select paper_id, element_id from r) x join el using (element_id) where facet = 'simulation' group by 1) select *, papers * 100.0 / max(papers) over () percent from n",
    "q22_chips": W + """, v as (select paper_id, el.facet, element_id, display_name, json_extract_string(j, '$.raw') raw from (select paper_id, element_id, values_json from r) x join el using (element_id)
   left join lateral (select unnest(case when json_valid(values_json) then json_extract(values_json, '$[*]') else [] end) j) l on true)
 select paper_id, facet, element_id, display_name, coalesce(array_to_string(list_sort(list(distinct raw) filter (where raw <> '' and not contains(display_name, raw))), ', '), '') shown from v group by 1, 2, 3, 4""",
}
QUERIES = {k: globals()[k] for k in SQL}
