"""Queries of block construction: headings, cleaning, tables, metadata, section and reading plans, joined paragraphs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.operators import blocks as K
from evispark.operators import evidence as E
from evispark.plans.text_queries import _CON, _DAN, _INC, B
from evispark.tables import latest, table

FIELDS = ["paper_id", "block_order", "section_id", "section_title", "section_kind", "reading_type", "include_in_reading", "page_start", "page_end", "source_block_ids", "text", "caption", "join_reason", "confidence"]


def reading(spark: SparkSession, sf: str) -> DataFrame:
    """Reading blocks, one per id; those without a paper or a place are left out. Places are numbered anew, as repeated deliveries may share one."""
    b = latest(table(spark, sf, "reading_blocks"), ["reading_block_id"], "loaded_at", FIELDS).where("reading_block_id is not null and paper_id is not null")
    w = Window.partitionBy("paper_id").orderBy("block_order", "reading_block_id")
    return b.withColumn("ord", F.row_number().over(w)).withColumnsRenamed({"include_in_reading": "include", "source_block_ids": "source_ids"})


def content(spark: SparkSession, sf: str) -> DataFrame:
    """Content blocks that stand for the sources of reading blocks: their lines and clauses, numbered within each."""
    parts = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "([a-z)][.;]) |\n", "$1\u0001"), "\u0001")
    r = reading(spark, sf).select("paper_id", "ord", "section_id", "reading_type", F.col("page_start").alias("page"), "caption", F.posexplode(parts).alias("part", "text"))
    kind = F.when(F.col("reading_type").isin("figure", "table", "list_item", "footnote"), F.col("reading_type")).otherwise("text")
    return r.select("paper_id", F.format_string("%s-%04d-%04d", "paper_id", "ord", "part").alias("block_id"), kind.alias("type"), "page", "text", F.when(F.col("part") == 0, F.col("caption")).alias("caption"), (F.col("ord") * 10_000 + F.col("part")).alias("position"), "ord", "part", "section_id")


def sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections as runs of content blocks, with the faults of a careless plan: every 9th block is missing, every 7th stands twice, and every 11th section has a block that doesn't exist and a kind that doesn't either."""
    c = content(spark, sf).where("position % 9 <> 0")
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", "block_id"))), lambda x: F.when(x["position"] % 7 == 0, F.array(x["block_id"], x["block_id"])).otherwise(F.array(x["block_id"]))))
    g = c.where("section_id is not null").groupBy("paper_id", "section_id").agg(ids.alias("block_ids"), F.min("position").alias("pos"))
    names = reading(spark, sf).where("section_id is not null").groupBy("paper_id", "section_id").agg(F.min_by("section_title", "ord").alias("section_title"), F.min_by("section_kind", "ord").alias("section_kind"))
    odd = F.col("pos") % 11 == 0
    return g.join(names, ["paper_id", "section_id"]).select("paper_id", "section_id", "section_title", F.when(odd, "odd").otherwise(F.col("section_kind")).alias("section_kind"), F.when(odd, F.concat("block_ids", F.array(F.concat("paper_id", F.lit("-none"))))).otherwise(F.col("block_ids")).alias("block_ids"), "pos")


def plan(spark: SparkSession, sf: str) -> DataFrame:
    """A reading plan over the content: one row per reading block; every 13th names a source that doesn't exist, every 17th an unknown type, every 19th leaves its last source out."""
    c = content(spark, sf)
    ids = c.groupBy("paper_id", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "block_id"))), lambda x: x["block_id"]).alias("ids"))
    r = reading(spark, sf).select("paper_id", "ord", "section_id", "reading_type", "join_reason", "confidence").join(ids, ["paper_id", "ord"])
    source = F.when(F.col("ord") % 13 == 0, F.concat("ids", F.array(F.lit("none")))).when(F.col("ord") % 19 == 0, F.slice("ids", F.lit(1), F.size("ids") - 1)).otherwise(F.col("ids"))
    return r.select("paper_id", F.col("ord").alias("idx"), "section_id", F.when(F.col("ord") % 17 == 0, "strange").otherwise(F.col("reading_type")).alias("reading_type"), source.alias("source_ids"), "join_reason", "confidence")


def rb1_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Content blocks of a package: reading blocks as document items, page headers and noise left out."""
    r = reading(spark, sf)
    kind = F.when(F.col("reading_type") == "figure", "pictures").when(F.col("reading_type") == "table", "tables").otherwise("texts")
    label = F.when(F.col("reading_type").isin("page_header", "list_item", "footnote", "caption"), F.col("reading_type")).when(F.col("reading_type") == "section_heading", "section_header").when(F.col("reading_type") == "other", "other").otherwise("text")
    layer = F.when(F.col("include"), "body").otherwise("furniture")
    items = r.select("paper_id", F.col("ord").alias("pos"), kind.alias("kind"), (F.col("ord") - 1).alias("idx"), label.alias("label"), layer.alias("layer"), F.col("page_start").alias("page"), "text", "caption")
    return K.clean_package(items).select("paper_id", "block_id", "evidence_id", "type", F.length("text").alias("chars"))


def rb3_headings(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("section_title")
    b = reading(spark, sf).where("section_title is not null").select("section_title").distinct()
    return b.select("section_title", K.numbered(t).alias("numbered"), K.real_heading(t).alias("real"), K.front_matter_heading(t).alias("front"), K.heading_level(t).alias("level"))


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as spanning table cells: a line fills a row or two and one or two of four columns."""
    l = table(spark, sf, "lineitem")
    n = l.groupBy(F.col("l_orderkey").alias("table_id")).agg(F.max("l_linenumber").alias("rows"))
    c0, r0 = (F.col("l_partkey") % 3).cast("int"), (F.col("l_linenumber") - 1).cast("int")
    c = l.select(F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") * 10**12 + F.col("l_partkey") * 10**5 + F.col("l_suppkey")).alias("cell"), r0.alias("r0"), (r0 + 1 + (F.col("l_suppkey") % 2)).cast("int").alias("r1"), c0.alias("c0"), F.when(F.col("l_suppkey") % 5 > 0, (c0 + 1 + F.col("l_partkey") % 2).cast("int")).alias("c1"), F.concat("l_returnflag", F.lit("|"), F.col("l_linenumber").cast("string")).alias("text"))
    return c.join(n, "table_id").withColumn("cols", F.lit(4)).withColumn("rows", F.col("rows").cast("int"))


def rb4_tables(spark: SparkSession, sf: str) -> DataFrame:
    return K.dense_cells(_cells(spark, sf))


def rb4_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return K.markdown_tables(K.dense_cells(_cells(spark, sf)))


def rb5_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """DOI, year and fitness as title from what citations say, as from the first page of a document."""
    c = latest(table(spark, sf, "citations"), ["citation_id"], "harvested_at", ["title", "doi", "year", "journal", "pdf_url"])
    blob = F.concat_ws(" ", "doi", "pdf_url", "title")
    return c.select("citation_id", K.doi_in(blob).alias("doi"), K.year_in([F.col("pdf_url")], [F.concat_ws(" ", F.lit("Published"), "year"), F.col("doi")]).alias("year"), K.bad_title(F.col("title"), ["Carbon", "Energy"]).alias("bad_title"))


def rb6_letters(spark: SparkSession, sf: str) -> DataFrame:
    b = reading(spark, sf).where("text is not null")
    return b.select("reading_block_id", F.sha2(K.fused_letters(F.col("text")), 256).alias("fused"))


def rb7_sections(spark: SparkSession, sf: str) -> DataFrame:
    return K.check_sections(sections(spark, sf), content(spark, sf))


def rb8_cover(spark: SparkSession, sf: str) -> DataFrame:
    p = K.covered_plan(plan(spark, sf), content(spark, sf), sections(spark, sf))
    return p.select("paper_id", "idx", "section_id", "reading_type", F.array_join("source_ids", ",").alias("sources"), "confidence")


def rb9_validation(spark: SparkSession, sf: str) -> DataFrame:
    return K.check_plan(plan(spark, sf), content(spark, sf), sections(spark, sf))


def _materialised(spark: SparkSession, sf: str) -> DataFrame:
    return K.materialise(plan(spark, sf), content(spark, sf), sections(spark, sf))


def rb10_blocks(spark: SparkSession, sf: str) -> DataFrame:
    m = _materialised(spark, sf)
    return m.select("paper_id", "ord", "section_kind", "reading_type", "include", "page_start", "page_end", F.size("source_ids").alias("sources"), F.sha2("text", 256).alias("text"), "caption", "removed", F.round("confidence", 6).alias("confidence"))


def rb11_first_page(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks whose text an untangled first page changes; the papers' own first pages count as page 1."""
    r, c = reading(spark, sf), content(spark, sf)
    first = r.groupBy("paper_id").agg((F.min("page_start") - 1).alias("off"))
    ids = c.groupBy("paper_id", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "block_id"))), lambda x: x["block_id"]).alias("ids"))
    b = r.join(first, "paper_id").join(ids, ["paper_id", "ord"]).select("paper_id", "ord", "section_id", "section_kind", "reading_type", "include", (F.col("page_start") - F.col("off")).alias("page_start"), (F.col("page_end") - F.col("off")).alias("page_end"), F.col("ids").alias("source_ids"), "text", "join_reason", "confidence")
    done = K.untangle_first_page(b, c.join(first, "paper_id").withColumn("page", F.col("page") - F.col("off")))
    return done.join(b.select("paper_id", "ord", F.col("source_ids").alias("was")), ["paper_id", "ord"]).where("not source_ids <=> was").select("paper_id", "ord", F.size("was").alias("was"), F.size("source_ids").alias("sources"), "page_start", "page_end")


def rb12_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    """Reading blocks after interrupted paragraphs are joined."""
    return K.coalesce_paragraphs(reading(spark, sf)).select("paper_id", "ord", "section_id", "reading_type", F.size("source_ids").alias("sources"), F.length("text").alias("chars"), "page_start", "page_end", "join_reason", "confidence")


def rb13_predicates(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    more = [K.page_header(t).alias("header"), K.lead_in(t).alias("lead_in"), K.explanation(t).alias("explanation"), K.connector(t).alias("connector"), K.formula_continues(t).alias("formula_continues"), (~F.coalesce(F.col("section_kind").isin(K.CLOSED_KINDS), F.lit(False))).alias("eligible")]
    return reading(spark, sf).select("reading_block_id", E.incomplete(t).alias("incomplete"), E.dangling(t).alias("dangling"), E.continues(t).alias("continues"), *more)


def rb14_report(spark: SparkSession, sf: str) -> DataFrame:
    """Merge report of each paper: blocks, those of several sources, excluded ones, share of reading blocks to content blocks, and the first 20 examples."""
    m = _materialised(spark, sf)
    many = F.size("source_ids") > 1
    first = lambda cond: F.array_join(F.slice(F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("ord", cond.alias("c")))), lambda x: F.when(x["c"], x["ord"].cast("string")))), 1, 20), ",")
    r = m.groupBy("paper_id").agg(F.count("*").alias("blocks"), F.sum(many.cast("int")).alias("merged"), F.sum((~F.coalesce("include", F.lit(True))).cast("int")).alias("excluded"), first(many).alias("merged_examples"), first(~F.coalesce("include", F.lit(True))).alias("excluded_examples"))
    n = content(spark, sf).groupBy("paper_id").agg(F.count("*").alias("content_blocks"))
    return n.join(r, "paper_id").select("paper_id", "content_blocks", "blocks", "merged", (F.col("blocks") - F.col("merged")).alias("singletons"), "excluded", F.round(F.col("blocks") / F.greatest(F.lit(1), F.col("content_blocks")), 4).alias("compression"), "merged_examples", "excluded_examples")


def rb15_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of each paper's included blocks: unfinished paragraphs (exempt: front matter, lines of dates, lists of symbols, and those before a formula or, where they name one, a figure or table), loose starts, empty visuals, page headers."""
    t, sq = F.coalesce("text", F.lit("")), K.squeeze(F.coalesce("text", F.lit("")))
    w = Window.partitionBy("paper_id").orderBy("ord")
    b = reading(spark, sf).where("coalesce(include, true)").withColumn("next_type", F.lead("reading_type").over(w)).withColumn("same", F.lead("section_id").over(w).eqNullSafe(F.col("section_id")) & F.lead("ord").over(w).isNotNull())
    para = F.col("reading_type") == "paragraph"
    dates = sq.rlike(r"\bReceived\b.+\bAccepted\b") | sq.rlike(r"\bAvailable online\b")
    symbols = F.lower(K.squeeze(F.coalesce("section_title", F.lit("")))).contains("symbol") | ((F.col("section_kind") == "front_matter") & (F.regexp_count(sq, F.lit(r"\b[A-Za-z][A-Za-z0-9,/+-]*\s*,")) >= 4))
    names = sq.rlike(r"(?i)\b(Fig|Table|Equation|Eq)\.?\s*\d")
    before = F.col("same") & ((F.col("next_type") == "formula") | (F.col("next_type").isin("figure", "table") & names))
    unfinished = para & E.incomplete(t) & ~F.coalesce(F.col("section_kind").isin("front_matter", "keywords"), F.lit(False)) & ~dates & ~F.coalesce(symbols, F.lit(False)) & ~F.coalesce(before, F.lit(False))
    word = F.lower(F.regexp_replace(F.split(sq, " ")[0], r"^[ ,;:()\[\]{}]+|[ ,;:()\[\]{}]+$", ""))
    # First words of a text that goes on with another.
    loose = sq.rlike(r"^\p{Ll}") | word.isin("and", "or", "but", "which", "where", "whereas", "thereby", "therefore", "resulting", "leading", "occupied", "respectively")
    formula = sq.rlike(r"(?i)^a\s+b\s+s\s+t\s+r\s+a\s+c\s+t\b") | K.explanation(t) | F.lower(sq).startswith("where:") | sq.rlike(r"(?i)\b(calculated|defined|expressed|written|given)\s+as$") | sq.rlike(r"(?i)\b(calculated|defined|expressed|written|given)\b.+:$") | (word == "while")
    empty = F.col("reading_type").isin("figure", "table") & (F.coalesce("caption", F.lit("")) == "") & (t == "")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    return b.groupBy("paper_id").agg(F.count("*").alias("blocks"), n(unfinished).alias("incomplete"), n(para & (sq != "") & loose & ~formula).alias("loose_starts"), n(empty).alias("empty_visuals"), n(K.page_header(t)).alias("headers"))


def rb17_captions(spark: SparkSession, sf: str) -> DataFrame:
    """Captions of figures and tables put together from the caption text and the block before."""
    r = reading(spark, sf)
    w = Window.partitionBy("paper_id").orderBy("ord")
    v = r.withColumn("before", F.lag("reading_block_id").over(w)).where("reading_type in ('figure', 'table')")
    refs = v.select(F.col("reading_block_id").alias("item"), F.posexplode(F.array(F.concat("reading_block_id", F.lit("#c")), "before")).alias("pos", "ref"))
    texts = r.select(F.concat("reading_block_id", F.lit("#c")).alias("ref"), F.col("caption").alias("text")).unionAll(r.select("reading_block_id", "text"))
    return K.captions(refs, texts).select("item", F.sha2("caption", 256).alias("caption"), "first_ref")


def rb18_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles from file stems made of id, year, first author, title words and article number."""
    a = latest(table(spark, sf, "articles"), ["article_id"], "exported_at", ["title", "year"]).where("title is not null")
    y = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("year", F.lit("")), "((?:19|20)[0-9]{2})", 1), F.lit("")), F.lit("unknown-year"))
    tail = F.when(F.col("article_id") % 3 == 0, "_j.fuel.2016.12.001").when(F.col("article_id") % 3 == 1, "_C5RA12345A").otherwise("")
    stem = F.concat(F.lit("S"), F.col("article_id").cast("string"), F.lit("_"), y, F.lit("_unknown_"), F.regexp_replace("title", "[^A-Za-z0-9]+", "_"), tail)
    return a.select("article_id", K.stem_title(stem).alias("title"))


_SQ = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_RB = "with b0 as (select * exclude rn from (select *, row_number() over (partition by reading_block_id order by loaded_at desc) rn from reading_blocks where reading_block_id is not null) where rn = 1 and paper_id is not null), rb as (select *, row_number() over (partition by paper_id order by block_order, reading_block_id) ord from b0)"
_CT = _RB + r""", c0 as (select paper_id, ord, section_id, reading_type, page_start page, caption, string_split(regexp_replace(coalesce(text, ''), '([a-z)][.;]) |\n', '\1' || chr(1), 'g'), chr(1)) p from rb),
 ct as (select paper_id, paper_id || '-' || lpad(ord::varchar, 4, '0') || '-' || lpad(part::varchar, 4, '0') block_id, case when reading_type in ('figure', 'table', 'list_item', 'footnote') then reading_type else 'text' end as type, page, text, case when part = 0 then caption end caption, ord * 10000 + part as position, ord, part, section_id
   from (select * exclude p, unnest(p) text, unnest(range(0, len(p))) part from c0))"""
_SEC = """, s0 as (select paper_id, section_id, min(position) pos, flatten(list(case when position % 7 = 0 then [block_id, block_id] else [block_id] end order by position)) ids from ct where position % 9 <> 0 and section_id is not null group by 1, 2),
 sn as (select paper_id, section_id, arg_min(struct_pack(t := section_title), ord).t section_title, arg_min(struct_pack(t := section_kind), ord).t section_kind from rb where section_id is not null group by 1, 2),
 sec as (select paper_id, section_id, section_title, case when pos % 11 = 0 then 'odd' else section_kind end section_kind, case when pos % 11 = 0 then list_append(ids, paper_id || '-none') else ids end block_ids, pos from s0 join sn using (paper_id, section_id))"""
_PLAN = """, pi as (select paper_id, ord, list(block_id order by position) ids from ct group by 1, 2), pl as (select paper_id, rb.ord idx, section_id, case when rb.ord % 17 = 0 then 'strange' else reading_type end reading_type,
   case when rb.ord % 13 = 0 then list_append(ids, 'none') when rb.ord % 19 = 0 then ids[1:-2] else ids end source_ids, join_reason, confidence from rb join pi using (paper_id, ord)),
 pe as (select paper_id, idx, section_id, unnest(source_ids) block_id, unnest(range(0, len(source_ids))) as nth from pl), kn as (select pe.* from pe join ct using (paper_id, block_id))"""
_JOIN = r"""case when len({p}) = 0 then '' else list_reduce({p}, lambda a, x: case when a = '' then x when x = '' then a when regexp_matches(x, '^[,.;:)\]}}%]') or regexp_matches(a, '[(\[{{/-]$') then a || x else a || ' ' || x end) end"""
_HDR = r"regexp_full_match(" + _SQ + r", '[A-Z]\.\s+[A-Z][A-Za-z''\-]+ et al\.')"
_MAT = _CT + _SEC + _PLAN + r""", ph as (select paper_id, list(p order by -length(p), p) phr from (select distinct paper_id, """ + _SQ.format("text") + r""" p from ct where type in ('text', 'list_item', 'footnote') and """ + _HDR.format("text") + r""") group by 1),
 src as (select pe.paper_id, pe.idx, list(case when type in ('figure', 'table') then '' else """ + _SQ.format("coalesce(text, '')") + """ end order by nth) parts, list(case when type in ('figure', 'table') then """ + _SQ.format("coalesce(caption, '')") + """ else '' end order by nth) caps, min(page) ps, max(page) pe_, count(*) n, bool_and(type not in ('figure', 'table') and coalesce(""" + _HDR.format("text") + """, false)) hdr from pe join ct using (paper_id, block_id) group by 1, 2),
 m0 as (select src.*, pl.section_id, pl.reading_type, pl.confidence, pl.join_reason, sec.section_kind, list_filter(parts, lambda x: x <> '') pp, list_filter(caps, lambda x: x <> '') cc, coalesce(phr, []) phr from src join pl using (paper_id, idx) left join sec on sec.paper_id = src.paper_id and sec.section_id = pl.section_id left join ph on ph.paper_id = src.paper_id),
 m1 as (select *, """ + _JOIN.format(p="pp") + " raw, " + _JOIN.format(p="cc") + r""" caption from m0),
 m2 as (select *, list_reduce(list_prepend(raw, phr), lambda a, p: case when contains(a, p) and """ + _SQ.format("a") + r""" <> p then replace(a, p, ' ') else a end) cl, len(list_filter(phr, lambda p: contains(raw, p) and """ + _SQ.format("raw") + r""" <> p)) removed from m1),
 m3 as (select *, """ + _SQ.format("cl") + r""" txt from m2),
 mat as (select paper_id, idx ord, section_kind, case when hdr then 'page_header' when reading_type = 'paragraph' and regexp_full_match(lower(txt), '(and|or|where|then|therefore)\s*,?') then 'formula' else reading_type end reading_type, ps page_start, pe_ page_end, n sources, txt, caption, removed, coalesce(least(1.0, greatest(0.0, confidence)), 1.0) confidence from m3)"""
_CELLS = """with l as (select l_orderkey table_id, l_linenumber::bigint * 1000000000000 + l_partkey * 100000 + l_suppkey cell, l_linenumber - 1 r0, l_linenumber + l_suppkey % 2 r1, l_partkey % 3 c0, case when l_suppkey % 5 > 0 then l_partkey % 3 + 1 + l_partkey % 2 else l_partkey % 3 + 1 end c1, l_returnflag || '|' || l_linenumber text, max(l_linenumber) over (partition by l_orderkey) n from lineitem),
 g as (select distinct table_id, r as row, c as col from (select table_id, unnest(range(0, n)) r from l), unnest(range(0, 4)) u(c)),
 d as (select g.table_id, g.row, g.col, coalesce(arg_max(text, cell), '') text from g left join l on l.table_id = g.table_id and g.row >= r0 and g.row < r1 and g.col >= c0 and g.col < c1 group by 1, 2, 3)"""
_T = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
_TK = r"coalesce(nullif(regexp_replace(regexp_replace(lower(regexp_replace(trim(coalesce({}, '')), '^\d+(\.\d+)*\.?\s*', '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'section')"
_HEADS = "(" + ", ".join(f"'{h}'" for h in K.HEADINGS) + ")"
_NZ = r"nullif(regexp_extract(coalesce({}, ''), '{}', 1), '')"
_MT = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?i)\bfl ow\b', 'flow', 'g'), '(?i)\bfl uid\b', 'fluid', 'g'), '(?i)\bmicrofl uidic\b', 'microfluidic', 'g'), '\s+', ' ', 'g'))"
_FIRSTS = ", ".join(f"'{w}'" for w in ["and", "or", "but", "which", "where", "whereas", "thereby", "therefore", "resulting", "leading", "occupied", "respectively"])
SQL = {
    "rb1_clean": _RB + r""", i as (select paper_id, ord, case reading_type when 'figure' then 'pictures' when 'table' then 'tables' else 'texts' end kind, case when reading_type in ('page_header', 'list_item', 'footnote', 'caption') then reading_type when reading_type = 'section_heading' then 'section_header' when reading_type = 'other' then 'other' else 'text' end label,
   coalesce(include_in_reading, false) inc, text, caption, """ + _SQ.format("coalesce(text, '')") + r""" v from rb),
 k as (select *, row_number() over (partition by paper_id order by ord) n from i where kind <> 'texts' or (label in ('text', 'section_header', 'list_item', 'caption', 'formula', 'footnote') and inc and v <> '' and not regexp_full_match(v, '\d+') and lower(v) not in ('contents lists available at sciencedirect', 'available online', 'article info', 'a r t i c l e i n f o') and not contains(lower(v), 'journal homepage:')))
 select paper_id, paper_id || '-BLK-' || lpad(n::varchar, 4, '0') block_id, paper_id || '-' || case kind when 'pictures' then 'FIG' when 'tables' then 'TAB' else 'TXT' end || '-' || lpad(ord::varchar, 4, '0') evidence_id, case kind when 'pictures' then 'figure' when 'tables' then 'table' else case label when 'section_header' then 'heading_candidate' else label end end as type, case when kind = 'texts' then length(trim(text)) end chars from k""",
    "rb3_headings": _RB + r""" select distinct section_title, regexp_matches(trim(section_title), '^\d+(?:\.\d+)*\.?\s+\S') numbered, regexp_matches(trim(section_title), '^\d+(?:\.\d+)*\.?\s+\S') or """ + _TK.format("section_title") + " in " + _HEADS + r""" as real,
  """ + _TK.format("section_title") + r""" in ('article_info', 'a_r_t_i_c_l_e_i_n_f_o') or regexp_matches(lower(trim(section_title)), '^(http://|https://|doi)') or contains(lower(section_title), 'journal homepage') front, greatest(1, len(string_split(nullif(regexp_extract(trim(section_title), '^(\d+(?:\.\d+)*)', 1), ''), '.'))) as level from rb where section_title is not null""",
    "rb4_tables": _CELLS + " select * from d",
    "rb4_markdown": _CELLS + r""", r as (select table_id, row, '| ' || string_agg(trim(replace(replace(text, '|', '\|'), chr(10), ' ')), ' | ' order by col) || ' |' line from d group by 1, 2)
 select table_id, string_agg(line || case when row = 0 then chr(10) || '| --- | --- | --- | --- |' else '' end, chr(10) order by row) markdown from r group by 1""",
    "rb5_metadata": r"""with c as (select * from (select *, row_number() over (partition by citation_id order by harvested_at desc) rn from citations) where rn = 1), t as (select *, concat_ws(' ', doi, pdf_url, title) t, 'Published' || coalesce(' ' || year, '') py from c),
 x as (select *, regexp_replace(regexp_extract(t, '(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)', 1), '\.+$', '') plain, regexp_extract(lower(t), '(?:^|[^a-z0-9])j[._-]([a-z0-9]+)[._-]((?:19|20)\d{2})[._-]([a-z0-9]+(?:[._-][a-z0-9]+)*)', ['j', 'y', 'a']) e, upper(regexp_extract(t, '(?i)(?:^|[^A-Z0-9])([A-Z]\d[A-Z]{2}\d{5}[A-Z]?)(?:$|[^A-Z0-9])', 1)) rsc,
   regexp_extract(lower(t), '(?:^|[^a-z0-9])aic[._-]([0-9]{4,})(?:$|[^0-9])', 1) aic, regexp_extract(lower(t), '(?:^|[^a-z0-9])advs[._-]([0-9]{4,})(?:$|[^0-9])', 1) advs, regexp_extract(t, '(?i)(?:^|[^0-9])(\d{5,6})[-_](PA|MS|SPE)(?:$|[^A-Z0-9])', ['n', 's']) spe, """ + _MT.format(_SQ.format("coalesce(title, '')")) + r""" mt from t)
 select citation_id, case when plain <> '' then plain when e.j <> '' then '10.1016/j.' || e.j || '.' || e.y || '.' || regexp_replace(e.a, '[._-]+', '.', 'g') when rsc <> '' then '10.1039/' || rsc when aic <> '' then '10.1002/aic.' || aic when advs <> '' then '10.1002/advs.' || advs when spe.n <> '' then '10.2118/' || spe.n || '-' || upper(spe.s) else '' end doi,
  coalesce(""" + ", ".join([_NZ.format("pdf_url", r"(?:^|\D)((?:19|20)\d{2})(?:\D|$)"), *[_NZ.format(c, p) for c in ("py", "doi") for p in (r"(?is)(?:copyright|©|&|Ó|V C)\s*\D{0,20}\b((?:19|20)\d{2})\b", r"(?is)\bAvailable online\b.*?\b((?:19|20)\d{2})\b", r"(?is)\bPublished\b.*?\b((?:19|20)\d{2})\b")], *[_NZ.format(c, r"(?:^|\D)((?:19|20)\d{2})(?:\D|$)") for c in ("py", "doi")]]) + r""", '') as year,
  mt = '' or length(mt) > 220 or length(mt) - length(replace(mt, '.', '')) >= 2 or replace(""" + _TK.format("mt") + r""", '_', ' ') in ('miniaturisation for chemistry physics biology materials science and bioengineering', 'contents lists available at sciencedirect', 'full length article', 'article info', 'abstract') or lower(mt) in ('carbon', 'energy') or regexp_matches(replace(""" + _TK.format("mt") + r""", '_', ' '), '^(journal homepage|www |issn |volume )') bad_title from x""",
    "rb6_letters": _RB + r""", w as (select reading_block_id, unnest(string_split(""" + _SQ.format("text") + r""", ' ')) t, unnest(range(0, len(string_split(""" + _SQ.format("text") + r""", ' ')))) i from rb where text is not null),
 f as (select *, regexp_full_match(t, '\p{L}') s from w), g as (select *, i - row_number() over (partition by reading_block_id, s order by i) isl from f),
 u as (select reading_block_id, min(i) i, case when count(*) >= 3 then string_agg(t, '' order by i) else string_agg(t, ' ' order by i) end t from g where s group by reading_block_id, isl union all select reading_block_id, i, t from g where not s)
 select reading_block_id, sha256(coalesce(string_agg(t, ' ' order by i), '')) fused from u group by 1""",
    "rb7_sections": _CT + _SEC + """, e as (select paper_id, unnest(block_ids) block_id from sec), n as (select paper_id, block_id, count(*) n from e group by 1, 2), j as (select coalesce(n.paper_id, ct.paper_id) paper_id, n.n, ct.block_id is not null known from n full join ct on ct.paper_id = n.paper_id and ct.block_id = n.block_id),
 per as (select paper_id, sum(case when not known then n else 0 end) as unknown, sum(coalesce(n - 1, 0)) repeated, sum((n is null)::int) missing from j group by 1), kd as (select paper_id, sum((section_kind is null or section_kind not in (""" + ", ".join(f"'{k}'" for k in K.SECTION_KINDS) + """))::int) bad_kinds from sec group by 1)
 select paper_id, unknown::bigint as unknown, repeated::bigint repeated, missing::bigint missing, coalesce(bad_kinds, 0)::bigint bad_kinds, case when unknown + repeated + missing + coalesce(bad_kinds, 0) = 0 then 'ok' else 'needs_fix' end status from per left join kd using (paper_id)""",
    "rb8_cover": _CT + _SEC + _PLAN + """, kp as (select paper_id, idx, string_agg(block_id, ',' order by nth) sources from kn group by 1, 2), own as (select paper_id, block_id, arg_max(section_id, pos) own from (select paper_id, section_id, pos, unnest(block_ids) block_id from sec) group by 1, 2), fs as (select paper_id, arg_min(section_id, pos) f from sec group by 1), ls as (select paper_id, max(idx) l from pl group by 1),
 ms as (select ct.* from ct where not exists (select 1 from kn where kn.paper_id = ct.paper_id and kn.block_id = ct.block_id))
 select paper_id, idx, section_id, reading_type, sources, confidence from kp join pl using (paper_id, idx)
 union all select ms.paper_id, coalesce(l, 0) + row_number() over (partition by ms.paper_id order by position), coalesce(own, f, ''), case when type in ('list_item', 'figure', 'table', 'footnote') then type when type = 'text' then 'paragraph' else 'other' end, ms.block_id, 1.0 from ms left join own on own.paper_id = ms.paper_id and own.block_id = ms.block_id left join fs on fs.paper_id = ms.paper_id left join ls on ls.paper_id = ms.paper_id""",
    "rb9_validation": _CT + _SEC + _PLAN + """, rw as (select pl.paper_id, sum((sec.section_id is null)::int) unknown_section, sum((reading_type is null or reading_type not in (""" + ", ".join(f"'{k}'" for k in K.READING_TYPES) + """))::int) bad_type, sum((len(source_ids) = 0)::int) no_sources from pl left join sec on sec.paper_id = pl.paper_id and sec.section_id = pl.section_id group by 1),
 ex as (select paper_id, block_id, max(section_id) expected from (select paper_id, section_id, unnest(block_ids) block_id from sec) group by 1, 2), us as (select paper_id, block_id, count(*) n, list(section_id) ats from pe group by 1, 2),
 j as (select coalesce(us.paper_id, ct.paper_id) paper_id, us.n, ct.block_id is not null known, case when ct.block_id is not null and us.n is not null then len(list_filter(ats, lambda s: s is distinct from ex.expected)) else 0 end mis from us full join ct on ct.paper_id = us.paper_id and ct.block_id = us.block_id left join ex on ex.paper_id = ct.paper_id and ex.block_id = ct.block_id),
 p as (select paper_id, sum((not known)::int) as unknown, sum(mis) misplaced, sum((n is null)::int) missing, sum(coalesce(n > 1, false)::int) repeated from j group by 1)
 select paper_id, coalesce(unknown_section, 0)::bigint unknown_section, coalesce(bad_type, 0)::bigint bad_type, coalesce(no_sources, 0)::bigint no_sources, unknown::bigint as unknown, misplaced::bigint misplaced, missing::bigint missing, repeated::bigint repeated, case when coalesce(unknown_section + bad_type + no_sources, 0) + unknown + misplaced + missing + repeated = 0 then 'ok' else 'needs_fix' end status from p left join rw using (paper_id)""",
    "rb10_blocks": _MAT + " select paper_id, ord, section_kind, reading_type, reading_type not in ('page_header', 'noise') include, page_start, page_end, sources, sha256(txt) text, caption, removed, round(confidence, 6) confidence from mat",
    "rb13_predicates": _RB + f""" select reading_block_id, {_INC} incomplete, {_DAN} dangling, {_CON} continues, coalesce({_HDR.format('text')}, false) header, regexp_matches(lower({_T}), '\\b(calculated|defined|expressed|written|given|shown|obtained|computed)\\s+as\\b.*:$') lead_in, regexp_matches(lower({_T}), '^(where |wherein |where, |here |here, )') explanation,
  regexp_full_match(lower({_T}), '(and|or|where|then|therefore)\\s*,?') connector, regexp_matches(lower({_T}), '^(represents |denotes |indicates |corresponds |is |are )') formula_continues, not coalesce(section_kind in ('front_matter', 'keywords', 'references', 'acknowledgements', 'appendix'), false) eligible from rb""",
    "rb14_report": _MAT + """, n as (select paper_id, count(*) content_blocks from ct group by 1), q as (select *, reading_type in ('page_header', 'noise') ex from mat)
 select paper_id, content_blocks, count(*) blocks, sum((sources > 1)::int)::bigint merged, count(*) - sum((sources > 1)::int)::bigint singletons, sum(ex::int)::bigint excluded, round(count(*) / greatest(1, content_blocks), 4) compression, coalesce(array_to_string((list(ord order by ord) filter (sources > 1))[1:20], ','), '') merged_examples, coalesce(array_to_string((list(ord order by ord) filter (ex))[1:20], ','), '') excluded_examples from q join n using (paper_id) group by paper_id, content_blocks""",
    "rb15_audit": _RB + f""", t as (select *, {_T} sq, lead(reading_type) over w nt, lead(section_id) over w is not distinct from section_id and lead(ord) over w is not null same from rb where coalesce(include_in_reading, true) window w as (partition by paper_id order by ord)),
 f as (select *, lower(regexp_replace(string_split(sq, ' ')[1], '^[ ,;:()\\[\\]{{}}]+|[ ,;:()\\[\\]{{}}]+$', '', 'g')) word from t)
 select paper_id, count(*) blocks, sum(coalesce(reading_type = 'paragraph' and {_INC} and not coalesce(section_kind in ('front_matter', 'keywords'), false) and not regexp_matches(sq, '\\bReceived\\b.+\\bAccepted\\b') and not regexp_matches(sq, '\\bAvailable online\\b')
   and not contains(lower(coalesce(section_title, '')), 'symbol') and not coalesce(same and (nt = 'formula' or nt in ('figure', 'table') and regexp_matches(sq, '(?i)\\b(Fig|Table|Equation|Eq)\\.?\\s*\\d')), false), false)::int)::bigint incomplete,
  sum(coalesce(reading_type = 'paragraph' and sq <> '' and (regexp_matches(sq, '^\\p{{Ll}}') or word in ({_FIRSTS})) and not (regexp_matches(sq, '(?i)^a\\s+b\\s+s\\s+t\\s+r\\s+a\\s+c\\s+t\\b') or regexp_matches(lower(sq), '^(where |wherein |where, |here |here, |where:)') or regexp_matches(sq, '(?i)\\b(calculated|defined|expressed|written|given)\\s+as$') or regexp_matches(sq, '(?i)\\b(calculated|defined|expressed|written|given)\\b.+:$') or word = 'while'), false)::int)::bigint loose_starts,
  sum(coalesce(reading_type in ('figure', 'table') and coalesce(caption, '') = '' and coalesce(text, '') = '', false)::int)::bigint empty_visuals, sum(coalesce({_HDR.format('text')}, false)::int)::bigint headers from f group by 1""",
    "rb17_captions": _RB + """, v as (select reading_block_id item, lag(reading_block_id) over (partition by paper_id order by ord) pre, reading_type, caption from rb), c as (select item, 0 pos, item || '#c' ref, trim(caption) t from v where reading_type in ('figure', 'table') union all select item, 1, pre, trim(rb.text) from v join rb on rb.reading_block_id = pre where v.reading_type in ('figure', 'table'))
 select item, sha256(string_agg(t, ' ' order by pos)) caption, arg_min(ref, pos) first_ref from c where t <> '' group by 1""",
    "rb18_titles": r"""with a as (select * from (select *, row_number() over (partition by article_id order by exported_at desc) rn from articles) where rn = 1 and title is not null), s as (select article_id, trim(regexp_replace(title, '[^A-Za-z0-9]+', '_', 'g'), '_') t, article_id % 3 k, regexp_matches(regexp_replace(title, '[^A-Za-z0-9]+', '_', 'g'), '(?i)(^|_)([a-z]\d[a-z]{2}\d{5}[a-z]?|aic|advs)_?$') odd from a)
 select article_id, """ + _MT.format("trim(replace(t, '_', ' '))") + " title from s",
}
QUERIES = {k: globals()[k] for k in [*SQL, "rb11_first_page", "rb12_coalesce"]}
