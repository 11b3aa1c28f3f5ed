"""Further queries of the survey: intake, validation, connections, portfolio inputs, stage reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.operators import index as I
from evispark.operators import intake as N
from evispark.plans.graph_queries import _C3, _tags, c3_candidate_edges
from evispark.plans.index_queries import OCC, journals, load
from evispark.plans.text_queries import B, blocks
from evispark.session import cut
from evispark.tables import latest, table


def in14_profile(spark: SparkSession, sf: str) -> DataFrame:
    a = latest(table(spark, sf, "articles"), ["article_id"], "exported_at", ["title"])
    return a.groupBy(N.profile(F.col("title")).alias("profile")).agg(F.count("*").alias("n"))


def in17_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text")
    h = F.when(F.trim("text") != "", F.sha2("text", 256))
    return N.first_of_each(d, h, "doc_id").groupBy("status").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def in20_next_id(spark: SparkSession, sf: str) -> DataFrame:
    return N.next_id(table(spark, sf, "papers"), "paper_id")


def el1_prompt_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks for extraction: included, with text or caption, cut at 700 characters for the prompt."""
    b = blocks(spark, sf).where("coalesce(include, false)")
    t = F.coalesce(F.expr("nullif(trim(text), '')"), F.trim("caption"))
    return b.withColumn("t", t).where("t <> ''").select("id", F.substring("t", 1, 700).alias("prompt"))


def g18_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint of each paper's used elements: equal fingerprints need no new placing."""
    r = I.by_role(load(spark, sf).rows, "used").groupBy("paper_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("element_id")), "|"), 256).alias("fingerprint"))
    return r


def c17_freshness(spark: SparkSession, sf: str) -> DataFrame:
    """Papers whose occurrences are missing or older than their blocks."""
    s = N.stale(table(spark, sf, "reading_blocks").select("paper_id", "loaded_at"), table(spark, sf, "occurrences").select("paper_id", "loaded_at"), "paper_id", "loaded_at")
    return s.groupBy("state").agg(F.count("*").alias("papers"))


def a2_population(spark: SparkSession, sf: str) -> DataFrame:
    """Papers with a listed, an empty or no author list, or no DOI."""
    a = latest(table(spark, sf, "authors").where("trim(doi) <> ''").withColumn("key", F.lower(F.trim("doi"))), ["key"], "fetched_at", ["authors"]).withColumn("hit", F.lit(True))
    p = load(spark, sf).papers.select("paper_id", F.expr("nullif(lower(trim(doi)), '')").alias("key"))
    some = F.when(F.col("authors").isNull(), 0).otherwise(F.size("authors")) > 0
    status = F.when(F.col("key").isNull(), "no_doi").when(F.col("hit").isNull(), "not_found").when(some, "found").otherwise("empty")
    return p.join(a, "key", "left").groupBy(status.alias("status")).agg(F.count("*").alias("papers"))


def pf10_paper_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct paper ids that the document table names, with their documents."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "paper_id", "text"), F.lit(r"\b(S[0-9]+)\b"), F.lit(1)))).alias("paper"))
    return d.groupBy("paper").agg(F.count("*").alias("documents"))


def o3_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """Stages that papers lack: card, blocks, elements."""
    ix = load(spark, sf)
    has = lambda df, c: df.select("paper_id").distinct().withColumn(c, F.lit(True))
    j = ix.papers.select("paper_id", "has_card").join(has(table(spark, sf, "reading_blocks"), "b"), "paper_id", "left").join(has(ix.rows, "e"), "paper_id", "left")
    stages = F.array(F.when(F.coalesce("has_card", F.lit(0)) == 0, "card"), F.when(F.col("b").isNull(), "blocks"), F.when(F.col("e").isNull(), "elements"))
    return j.select("paper_id", F.explode(F.array_compact(stages)).alias("stage"))


W = "with " + OCC
_WS = "list_filter(list_distinct(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda x: x <> '')"
_PF1 = W + """, u as (select paper_id, sum((facet in ('finding', 'analysis'))::int) atoms, count(distinct case when facet = 'material' then element_id end) materials from r where role = 'used' group by 1),
 pf as (select paper_id, coalesce(atoms, 0) atoms, coalesce(len(main_findings), 0) syntheses, coalesce(materials, 0) materials from pap left join u using (paper_id))"""
_ART = "with a as (select article_id, arg_max(struct_pack(t := title), exported_at).t title from articles group by 1)"
SQL = {
    "in14_profile": _ART + r""", t as (select coalesce(title, '') t from a), w as (select t, lower(t) l, len(list_filter(regexp_extract_all(t, '[A-Za-z]{3,}'), lambda x: lower(x) not in ('pdf', 'zot', 'doi', 'tokens', 's0066', 'index'))) n, length(regexp_replace(t, '[\x00-\x7F]', '', 'g')) / greatest(1, length(t)) s from t)
 select case when regexp_matches(l, '(?:^|[^a-z0-9])subject[\s_.-]*index(?:$|[^a-z0-9])') then 'subject_index' when regexp_matches(l, 'b97[89][\d.\-]') and regexp_matches(l, '(?:^|[^a-z0-9])index(?:$|[^a-z0-9])') then 'book_index' when regexp_matches(t, '[㐀-鿿]') then 'cjk_filename'
  when s >= 0.15 and n < 4 then 'mostly_non_ascii_filename' when n >= 4 then 'english_title_tokens' else 'no_defer_signal' end profile, count(*) n from w group by 1""",
    "in17_dedupe": "with f as (select text, min(doc_id) first from documents where trim(text) <> '' group by 1) select case when f.text is null then 'no_full_text' when doc_id = first then 'kept' else 'duplicate' end status, count(*) n, min(doc_id) first from documents d left join f on d.text = f.text group by 1",
    "in20_next_id": "select coalesce(max(try_cast(nullif(regexp_extract(paper_id, '^S([0-9]+)$', 1), '') as bigint)), 0) + 1 as next from papers",
    "el1_prompt_blocks": B + ", t as (select id, coalesce(nullif(trim(text), ''), trim(caption)) t from b where coalesce(include_in_reading, false)) select id, substring(t, 1, 700) prompt from t where t <> ''",
    "g18_fingerprints": W + "select paper_id, sha256(string_agg(element_id, '|' order by element_id)) fingerprint from used group by 1",
    "c17_freshness": """with u as (select paper_id, max(loaded_at) u from reading_blocks where paper_id is not null group by 1), d as (select paper_id, max(loaded_at) d from occurrences group by 1)
 select case when d is null then 'missing' when d < u then 'stale' else 'fresh' end state, count(*) papers from u left join d using (paper_id) group by 1""",
    "a2_population": W + """, l as (select lower(trim(doi)) as key, arg_max(struct_pack(x := authors), fetched_at).x a, true hit from authors where trim(doi) <> '' group by 1)
 select case when p.key is null then 'no_doi' when hit is null then 'not_found' when coalesce(len(a), 0) > 0 then 'found' else 'empty' end status, count(*) papers from (select nullif(lower(trim(doi)), '') as key from pap) p left join l on l.key = p.key group by 1""",
    "pf10_paper_ids": r"select paper, count(*) documents from (select doc_id, unnest(list_distinct(regexp_extract_all(concat_ws(' ', paper_id, text), '\bS[0-9]+\b'))) paper from documents) group by 1",
    "o3_recovery": W + """, x as (select paper_id, [case when coalesce(has_card, 0) = 0 then 'card' end, case when paper_id not in (select paper_id from reading_blocks where paper_id is not null) then 'blocks' end, case when paper_id not in (select paper_id from r) then 'elements' end] s from pap)
 select paper_id, stage from (select paper_id, unnest(s) stage from x) where stage is not null""",
}
QUERIES = {k: globals()[k] for k in SQL}
