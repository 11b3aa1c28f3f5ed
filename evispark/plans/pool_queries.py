"""Queries of the pool, of ingest, of sources and of stages, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.operators import intake as N
from evispark.operators import pool as P
from evispark.operators import stages as S
from evispark.plans import evidence_queries as EQ
from evispark.plans.index_queries import load
from evispark.session import cut
from evispark.sources import documents as D
from evispark.tables import latest, table

STOP = ["the", "and", "for", "with", "from", "pdf"]


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files: name from source, section and id, size from the characters; by rule every 17th lacks the magic bytes, every 23rd is encrypted, every 29th is gone, every 31st is a supplement; two thirds name a publisher's article number."""
    d = table(spark, sf, "documents").where("doc_id is not null")
    at = lambda k: F.col("doc_id") % k == 0
    stem = F.concat_ws("_", F.coalesce("section_kind", F.lit("x")), F.when(at(31), "Supplementary"), F.col("doc_id").cast("string"))
    name = F.concat(stem, F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("_j.fuel.2016."), (F.col("doc_id") % 40).cast("string"))).otherwise(""), F.lit(".pdf"))
    text = F.coalesce("text", F.lit(""))
    parent = F.concat(F.lit("P"), (F.col("doc_id") % 300).cast("string"))
    doi = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("10.1016/j.fuel.2016."), (F.col("doc_id") % 39).cast("string"))).otherwise("")
    return d.select("doc_id", name.alias("name"), (~at(29)).alias("exists"), F.length(text).alias("size"), (~at(17)).alias("magic"), at(23).alias("encrypted"), F.ceil(F.length(text) / 900).cast("int").alias("pages"), "text", F.sha2(text, 256).alias("sha"), parent.alias("parent"), doi.alias("parent_doi"), F.concat(F.lit("Title "), (F.col("doc_id") % 7).cast("string")).alias("parent_title"))


def _probed(spark: SparkSession, sf: str) -> DataFrame:
    f = files(spark, sf)
    n = f.groupBy("parent").agg(F.count("*").alias("parent_count"))
    return P.probe(f.join(n, "parent"))


def in2_probe(spark: SparkSession, sf: str) -> DataFrame:
    return _probed(spark, sf).select("doc_id", "decision", "document_class", "reason", F.size("warnings").alias("warnings"))


def in3_audit(spark: SparkSession, sf: str) -> DataFrame:
    return P.audit(_probed(spark, sf))


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    p = _probed(spark, sf)
    return cut(P.candidates(p, p.where("doc_id % 10 = 0").select("sha")))


def in4_candidates(spark: SparkSession, sf: str) -> DataFrame:
    c = _candidates(spark, sf)
    return c.select("candidate_id", "status", "files", F.array_join("names", "|").alias("names"), F.array_join("dois", "|").alias("dois"), "in_pool", "conflict", "overloaded", F.array_join("warnings", "|").alias("warnings"))


def in5_overloaded(spark: SparkSession, sf: str) -> DataFrame:
    return P.overloaded_parents(_probed(spark, sf), 3)


def in6_eligible(spark: SparkSession, sf: str) -> DataFrame:
    return P.eligible(_candidates(spark, sf), manual=True).select("candidate_id", "status")


def in7_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Promotion of all candidates under names of one digit, so that many collide."""
    c = _candidates(spark, sf)
    r = P.eligible(c).select("candidate_id", "sha", F.concat(F.lit("Paper "), F.substring("sha", 1, 1), F.lit(".pdf")).alias("target"), F.col("sha").alias("arrival"))
    pool = c.where("in_pool").select("sha", F.concat(F.lit("paper "), F.substring("sha", 2, 1), F.lit(".PDF")).alias("name"))
    return P.promotion_plan(r, pool, r.where("sha like '%0'").select("candidate_id"))


def in9_names(spark: SparkSession, sf: str) -> DataFrame:
    """Year, author and title from file names in three grammars made of articles."""
    a = latest(table(spark, sf, "articles"), ["article_id"], "exported_at", ["title", "year", "authors"]).where("title is not null")
    y = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("year", F.lit("")), "((?:19|20)[0-9]{2})", 1), F.lit("")), F.lit("1999"))
    who = F.coalesce(F.try_element_at("authors", F.lit(1)), F.lit("Lee et al."))
    k = F.col("article_id") % 4
    name = F.when(k == 0, F.concat(who, F.lit(" - "), y, F.lit(" - "), "title")).when(k == 1, F.concat(y, F.lit("-"), "title", F.lit("_"), who)).when(k == 2, F.concat("title", F.lit("_"), F.left(who, F.lit(12)))).otherwise(F.col("title"))
    return a.select("article_id", P.name_parts(F.concat(name, F.lit(".pdf"))).alias("p")).select("article_id", "p.year", "p.author", "p.title")


def in10_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """New files against the manifest (every 3rd file is in it) and the library (every 5th)."""
    f = files(spark, sf).withColumn("identity", P.identity(F.col("name"), STOP))
    pid = F.format_string("S%02d", "doc_id")
    m, l = f.where("doc_id % 3 = 0").select(pid.alias("paper_id"), "sha", "identity"), f.where("doc_id % 5 = 0").select(pid.alias("paper_id"), "sha")
    top = f.agg((F.max("doc_id") + 3).alias("k")).select(F.concat(F.lit("S"), F.col("k").cast("string")).alias("paper_id"))
    return P.ingest(f.select(F.col("name").alias("file"), "sha", "identity", F.col("doc_id").alias("arrival")), m, l, top)


def in11_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Duplicate candidates by the best overlap of title, URL and authors."""
    a = latest(table(spark, sf, "articles"), ["article_id"], "exported_at", ["title", "url", "authors"])
    return N.best_overlap(a, "article_id", {"title": F.col("title"), "url": F.col("url"), "authors": F.array_join("authors", " ")})


def in12_refresh(spark: SparkSession, sf: str) -> DataFrame:
    f = files(spark, sf).select(F.col("doc_id").cast("string").alias("paper_id"), P.identity(F.col("name"), STOP).alias("identity"), F.array((F.col("doc_id") + 1).cast("string"), F.col("doc_id").cast("string")).alias("old"))
    return P.refreshed(f, f).select("paper_id", "identity", F.array_join("possible_duplicates", ",").alias("possible"))


def in13_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Files of articles found by name: every 4th is named exactly, the rest have a word more."""
    a = latest(table(spark, sf, "articles"), ["article_id"], "exported_at", ["title"]).where("title <> ''").select(F.col("article_id").cast("string").alias("paper_id"), F.concat(F.regexp_replace("title", "[^A-Za-z0-9]+", " "), F.lit(".pdf")).alias("name"))
    f = a.select(F.when(F.col("paper_id") % 4 == 0, F.col("name")).otherwise(F.concat(F.lit("copy "), "name")).alias("file")).distinct()
    return P.resolve_sources(a, f, STOP)


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    a = latest(table(spark, sf, "articles"), ["article_id"], "exported_at", ["title", "authors", "year", "doi", "pii"])
    return a.select(F.col("article_id").alias("index"), P.target_name(F.col("title"), F.col("authors"), F.col("year"), F.col("doi"), F.col("pii"), F.col("article_id")).alias("target"))


def in18_report(spark: SparkSession, sf: str) -> DataFrame:
    """State of each article: every 3rd has its file under another case, the log says failed for every 4th."""
    t = _targets(spark, sf)
    chosen, report = P.to_fetch(t, t.where("index % 3 = 0").select(F.upper("target").alias("file")), t.where("index % 4 = 0").select("index", F.lit("failed").alias("status")), start=5)
    return report.join(chosen.select("index", F.lit(True).alias("chosen")), "index", "left").select("index", "status", F.coalesce("chosen", F.lit(False)).alias("chosen"))


def in21_targets(spark: SparkSession, sf: str) -> DataFrame:
    return _targets(spark, sf)


def in22_state(spark: SparkSession, sf: str) -> DataFrame:
    """Last state of each citation over its deliveries, with attempts and times: `ok` with a PDF address, `no_pdf` without."""
    c = table(spark, sf, "citations")
    return c.groupBy("citation_id").agg(F.max_by(F.when(F.coalesce("pdf_url", F.lit("")) != "", "ok").otherwise("no_pdf"), F.struct("harvested_at", "pdf_url")).alias("status"), F.max_by("source", F.struct("harvested_at", "pdf_url")).alias("last_source"), F.count("*").alias("attempts"), F.min("harvested_at").alias("first"), F.max("harvested_at").alias("last"))


def io17_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return D.reading_markdown(EQ.blocks(spark, sf)).select("paper_id", F.sha2("markdown", 256).alias("markdown"), F.length("markdown").alias("chars"))


def _done(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(papers, outputs by stage): reading from blocks, clean and sections with them, cards, elements, tags."""
    ix = load(spark, sf)
    one = lambda d, s: d.select("paper_id").distinct().withColumn("stage", F.lit(s))
    b = EQ.blocks(spark, sf)
    parts = [one(b, "clean"), one(b, "sections"), one(b, "reading"), one(ix.papers.where("has_card = 1"), "card"), one(ix.rows, "elements"), one(ix.papers.where("size(methods) > 2"), "card_tags")]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    return ix.papers, every


def o1_stages(spark: SparkSession, sf: str) -> DataFrame:
    """The next stage of each paper; tagging has failed for ids that end in 3, the gate holds those that end in 7."""
    p, d = _done(spark, sf)
    return S.next_stage(p, d, p.where("paper_id like '%3'").select("paper_id", F.lit("card_tags").alias("stage")), p.where("paper_id like '%7'"))


def o2_summary(spark: SparkSession, sf: str) -> DataFrame:
    p, d = _done(spark, sf)
    return S.run_summary(d.where("stage = 'elements'"), p.where("paper_id like '%3'"))


def o4_work(spark: SparkSession, sf: str) -> DataFrame:
    """All active and deferred papers: untitled ones are deferred, those with the title of a lesser id are possible duplicates, reviews are out."""
    p = load(spark, sf).papers
    first = p.where("title <> ''").groupBy("title").agg(F.min("paper_id").alias("first"))
    m = p.join(first, "title", "left").select("paper_id", F.when(F.col("paper_type") == "review", "done").otherwise("active").alias("status"), (F.coalesce("title", F.lit("")) == "").alias("deferred"), F.when(F.col("first") < F.col("paper_id"), F.array("first")).alias("possible_duplicate_of"))
    return S.select_work(m, everything=True)


def o5_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Cache hits of the card stage: the fingerprint is the objective; it has changed for ids that end in 1; blocks and elements must be there."""
    p, d = _done(spark, sf)
    p = EQ.load_papers(spark, sf)
    run = p.select("paper_id", F.lit("card").alias("stage"), F.sha2(F.coalesce("objective", F.lit("")), 256).alias("fingerprint"), F.array(F.lit("reading"), F.lit("elements")).alias("needs"))
    was = run.select("paper_id", "stage", F.when(F.col("paper_id").like("%1"), "old").otherwise(F.col("fingerprint")).alias("fingerprint"))
    return S.cache_hits(run, was, d.select("paper_id", F.col("stage").alias("name")))


_SQ = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_F = """with f as (select doc_id, coalesce(section_kind, 'x') || case when doc_id % 31 = 0 then '_Supplementary' else '' end || '_' || doc_id || case when doc_id % 3 > 0 then '_j.fuel.2016.' || (doc_id % 40) else '' end || '.pdf' as name, doc_id % 29 <> 0 ex, length(coalesce(text, '')) size, doc_id % 17 <> 0 magic, doc_id % 23 = 0 enc, ceil(length(coalesce(text, '')) / 900)::int pages, coalesce(text, '') text, sha256(coalesce(text, '')) sha,
  'P' || (doc_id % 300) parent, case when doc_id % 4 = 0 then '10.1016/j.fuel.2016.' || (doc_id % 39) else '' end parent_doi, 'Title ' || (doc_id % 7) parent_title, count(*) over (partition by doc_id % 300) parent_count from documents where doc_id is not null)"""
_CASE = lambda pats, c: "case " + " ".join(f"when regexp_matches(lower({c}), '{p}') then '{k}'" for _, k, p in pats) + " end"
_P = _F + f""", g as (select *, left({_SQ.format('text')}, 4000) t from f), h as (select *, {_CASE(P.NAME_FLAGS, 'name')} nf, {_CASE(P.TEXT_FLAGS, 'left(t, 1500)')} tf, {_CASE([('', k, p) for k, p in P.BODY_CLASSES], "name || ' ' || left(t, 1200)")} bc from g),
 pr as (select *, case when not ex or size <= 0 or not magic or enc or pages <= 0 then 'reject_broken_pdf' when nf is not null or (tf is not null and pages <= 2) then 'reject_non_literature_body' when (pages <= 1 and length(t) < 500) or length(t) < 300 then 'needs_manual_review' else 'candidate_for_pool' end decision,
  case when not ex then 'file_missing' when size <= 0 then 'empty_file' when not magic then 'missing_pdf_magic' when enc then 'encrypted_pdf' when pages <= 0 then 'no_pages' when nf is not null then 'filename_indicates_' || nf when tf is not null and pages <= 2 then 'short_pdf_text_indicates_' || tf when pages <= 1 and length(t) < 500 then 'single_page_low_text' when length(t) < 300 then 'low_extractable_text' else 'pdf_looks_like_literature_body' end reason,
  case when not ex or size <= 0 or not magic or enc or pages <= 0 then 'unknown' when nf is not null then nf when tf is not null and pages <= 2 then tf when (pages <= 1 and length(t) < 500) or length(t) < 300 then 'unknown' else coalesce(bc, 'main_article') end document_class, (size > 0 and size < 51200)::int warnings from h)"""
_C = _P + r""", k as (select *, case when doc_id % 3 > 0 then 'fuel2016' || (doc_id % 40) else '' end fk, case when doc_id % 4 = 0 then 'fuel2016' || (doc_id % 39) else '' end pk from pr),
 c0 as (select sha, count(*) files, list_sort(list(distinct name)) names, list_sort(list(distinct parent_doi) filter (parent_doi <> '')) dois, coalesce(list(distinct fk) filter (fk <> ''), []) fks, coalesce(list(distinct pk) filter (pk <> ''), []) pks, bool_or(parent_count > 3) overloaded, arg_min(decision, name) decision, bool_or(doc_id % 10 = 0) in_pool from k group by 1),
 ca as (select *, len(fks) > 0 and len(pks) > 0 and len(list_intersect(fks, pks)) = 0 conflict, case when in_pool then 'exact_duplicate_in_pool' else decision end status from c0)"""
_TN = r"""with a as (select * from (select *, row_number() over (partition by article_id order by exported_at desc) rn from articles) where rn = 1)"""
_CN = lambda c, n: f"coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '[<>:\"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '\\s+', ' ', 'g'), '^[ ._]+|[ ._]+$', '', 'g'), {n}), '[ ._]+$', ''), ''), 'untitled')"
_TG = _TN + f""", b as (select *, trim(coalesce(authors[1], '')) au from a), tg as (select article_id as idx, {_CN(_CN("case when coalesce(year, '') = '' then 'unknown-year' else year end", 120) + " || '_' || " + _CN("case when au = '' then 'unknown' when contains(au, ',') then coalesce(nullif(trim(split_part(au, ',', 1)), ''), 'unknown') else regexp_split_to_array(au, '\\s+')[1] end", 120) + " || '_' || " + _CN("case when coalesce(title, '') = '' then 'untitled' else title end", 80) + " || '_' || " + _CN("coalesce(nullif(string_split(doi, '/')[-1], ''), nullif(pii, ''), article_id::varchar)", 120) + " || '.pdf'", 220)} target from b)"""
_ID = ", idn as (select *, case when doc_id % 3 > 0 then 'doi:fuel2016' || (doc_id % 40) else '' end did from f), idt as (select *, list_sort(list_filter(list_distinct(string_split(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda w: length(w) >= 3 and w not in ('the', 'and', 'for', 'with', 'from', 'pdf'))) tk from idn), idf as (select *, case when did <> '' then did when len(tk) >= 4 then 'tokens:' || array_to_string(tk[1:16], '-') else '' end as ident from idt)"
_WSET = "list_filter(list_distinct(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda x: x <> '')"
_DONE = EQ._BT + ", " + EQ._PAP + ", ro as (select distinct paper_id from (select *, row_number() over (partition by occ_id order by loaded_at desc) rn from occurrences) where rn = 1 and element_id is not null and paper_id is not null), bp as (select distinct paper_id from bt)"
SQL = {
    "in2_probe": _P + " select doc_id, decision, document_class, reason, warnings from pr",
    "in3_audit": _P + " select 'decision' kind, decision as value, count(*) n from pr group by 2 union all select 'class', document_class, count(*) from pr group by 2 union all select 'warning', 'small_pdf_file', count(*) from pr where warnings = 1 having count(*) > 0 union all (with d as (select count(*) c from pr group by sha having count(*) > 1) select 'duplicate', 'groups', count(*) from d union all select 'duplicate', 'files', coalesce(sum(c), 0)::bigint from d)",
    "in4_candidates": _C + " select 'ZOT-' || left(sha, 12) candidate_id, status, files, array_to_string(names, '|') as names, coalesce(array_to_string(dois, '|'), '') dois, in_pool, conflict, overloaded, array_to_string(list_filter([case when files > 1 then 'internal_duplicates' end, case when overloaded then 'parent_attachment_overload' end, case when conflict then 'filename_parent_doi_conflict' end, case when len(fks) = 0 then 'no_filename_doi_key' end], lambda x: x is not null), '|') warnings from ca",
    "in5_overloaded": _F + " select parent, max(parent_count) attachments, count(distinct sha) contents from f group by 1 having max(parent_count) > 3",
    "in6_eligible": _C + " select 'ZOT-' || left(sha, 12) candidate_id, status from ca where not in_pool and status in ('candidate_for_pool', 'needs_manual_review')",
    "in7_plan": _C + """, r as (select 'ZOT-' || left(sha, 12) candidate_id, sha, 'Paper ' || left(sha, 1) || '.pdf' target, sha like '%0' gone from ca where not in_pool and status = 'candidate_for_pool'), pl as (select distinct lower('paper ' || substring(sha, 2, 1) || '.PDF') low from ca where in_pool),
 n as (select *, case when gone then 0 else row_number() over (partition by target, gone order by sha) end + (lower(target) in (select low from pl))::int n from r)
 select candidate_id, case when gone then 'skip_missing_source' else 'ready' end as action, case when not gone and n > 1 then replace(target, '.pdf', '') || '_' || left(sha, 12) || '.pdf' else target end target from n""",
    "in10_manifest": _F + _ID + """, pid as (select *, 'S' || case when doc_id < 10 then '0' else '' end || doc_id p from idf), m as (select sha, min(p) m from pid where doc_id % 3 = 0 group by 1), l as (select sha, min(p) l from pid where doc_id % 5 = 0 group by 1), sm as (select ident, string_agg(distinct p, ',' order by p) same from pid where doc_id % 3 = 0 and ident <> '' group by 1),
 j as (select pid.*, m, l, row_number() over (partition by pid.sha, m is null and l is null order by doc_id) tw from pid left join m using (sha) left join l using (sha)), top as (select max(doc_id) + 3 rsv, (select max(doc_id) from pid where doc_id % 3 = 0 or doc_id % 5 = 0) t from pid),
 nw as (select sha, row_number() over (order by doc_id) r from j where m is null and l is null and tw = 1), nu as (select sha, case when t + r >= rsv then t + r + 1 else t + r end k from nw, top)
 select name as file, coalesce(m, l, 'S' || case when k < 10 then '0' else '' end || k) paper_id, case when m is not null then 'duplicate_manifest' when l is not null then 'duplicate_library' when tw > 1 then 'duplicate_manifest' else 'active' end status, case when m is null and l is null and tw = 1 then coalesce(same, '') else '' end possible_duplicates from j left join nu using (sha) left join sm using (ident)""",
    "in11_overlap": _TN + ", w as (" + " union all ".join(f"select article_id id, {k} f, {_WSET.format(c)} w from a where {c} is not null" for k, c in enumerate(("title", "url", "array_to_string(authors, ' ')"))) + "), x as (select id, f, len(w) n, unnest(w) t from w where len(w) > 0), s as (select p.f, p.id a, q.id b, count(*) shared, least(p.n, q.n) smaller from x p join x q on p.f = q.f and p.t = q.t and p.id < q.id group by p.f, p.id, q.id, p.n, q.n) select a, b, round(max(shared / smaller), 6) best from s where shared >= 0.72 * smaller - 1e-9 group by 1, 2",
    "in12_refresh": _F + _ID + ", sm as (select ident, list_sort(list(distinct doc_id::varchar)) same from idf where ident <> '' group by 1), x as (select doc_id, ident, list_concat([(doc_id + 1)::varchar, doc_id::varchar], coalesce(same, [])) l from idf left join sm using (ident)) select doc_id::varchar paper_id, ident as identity, array_to_string(list_filter(list_filter(l, lambda v, i: list_position(l, v) = i), lambda v: v <> doc_id::varchar), ',') possible from x",
    "in13_sources": _TN + r""", w as (select article_id::varchar p, regexp_replace(title, '[^A-Za-z0-9]+', ' ', 'g') || '.pdf' nm from a where title <> ''), fl as (select distinct case when p::bigint % 4 = 0 then nm else 'copy ' || nm end file from w), tw as (select p, list_filter(list_distinct(string_split(trim(regexp_replace(lower(regexp_replace(nm, '\.[A-Za-z0-9]{1,5}$', '')), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda x: length(x) >= 3 and x not in ('the', 'and', 'for', 'with', 'from', 'pdf')) ws from w),
 tf as (select file, list_filter(list_distinct(string_split(trim(regexp_replace(lower(regexp_replace(file, '\.[A-Za-z0-9]{1,5}$', '')), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda x: length(x) >= 3 and x not in ('the', 'and', 'for', 'with', 'from', 'pdf')) fs from fl), s as (select p, file, len(list_intersect(ws, fs)) / len(ws) sc from tw, tf where len(ws) > 0 and len(list_intersect(ws, fs)) >= 0.6 * len(ws) - 1e-9),
 r as (select *, row_number() over (partition by p order by sc desc, file) k, lead(sc) over (partition by p order by sc desc, file) nx from s)
 select w.p paper_id, coalesce(fl.file, r.file) file, case when fl.file is not null then 'origin_filename' when r.file is not null then 'title_tokens' end how from w left join fl on fl.file = nm left join r on r.p = w.p and k = 1 and (nx is null or sc > nx + 0.15)""",
    "in18_report": _TG + ", th as (select distinct lower(target) l from tg where idx % 3 = 0) select idx as \"index\", case when lower(target) in (select l from th) then 'success' when idx % 4 = 0 then 'failed' else 'pending' end status, idx >= 5 and lower(target) not in (select l from th) chosen from tg",
    "in21_targets": _TG + " select idx as \"index\", target from tg",
    "in22_state": "select citation_id, arg_max(case when coalesce(pdf_url, '') <> '' then 'ok' else 'no_pdf' end, harvested_at) status, arg_max(source, harvested_at) last_source, count(*) attempts, min(harvested_at) as first, max(harvested_at) as last from citations group by 1",
    "io17_markdown": EQ._BT + """, l as (select paper_id, block_order, id, case when reading_type = 'section_heading' then '## ' || trim(coalesce(text, '')) when reading_type in ('figure', 'table') then '*' || case when trim(coalesce(caption, '')) = '' then trim(coalesce(text, '')) else trim(caption) end || '*' when reading_type = 'list_item' then '- ' || trim(coalesce(text, '')) else trim(coalesce(text, '')) end l from bt where coalesce(include_in_reading, true) and (trim(coalesce(text, '')) <> '' or trim(coalesce(caption, '')) <> '')),
 m as (select paper_id, string_agg(l, chr(10) || chr(10) order by block_order, id) m from l group by 1) select paper_id, sha256(m) markdown, length(m) chars from m""",
    "o1_stages": _DONE + """, s as (select paper_id, paper_id in (select paper_id from bp) b, coalesce(has_card = 1, false) c, paper_id in (select paper_id from ro) e, coalesce(len(methods) > 2, false) t from pap), x as (select *, case when not b then 'clean' when not c then 'card' when not e then 'elements' when not t then 'card_tags' end todo from s),
 y as (select *, case when todo is null then 'complete' when todo = 'card_tags' and paper_id like '%3' then 'failed' when paper_id like '%7' and todo <> 'clean' then 'deferred' else 'pending' end state from x) select paper_id, case when state in ('pending', 'failed') then todo end as next, state from y""",
    "o2_summary": _DONE + " select paper_id from ro where paper_id not in (select paper_id from pap where paper_id like '%3')",
    "o4_work": "with " + EQ._PAP + ", f as (select title, min(paper_id) f from pap where title <> '' group by 1) select paper_id, case when coalesce(title, '') = '' then 'deferred' when f < paper_id then 'possible_duplicate' else 'selected' end state from pap left join f using (title) where coalesce(paper_type, '') <> 'review'",
    "o5_cache": _DONE + " select paper_id, 'card' stage, paper_id not like '%1' and paper_id in (select paper_id from bp) and paper_id in (select paper_id from ro) hit from pap",
}
QUERIES = {k: globals()[k] for k in [*SQL, "in9_names"]}
