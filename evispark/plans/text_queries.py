"""Queries of the text, intake and author operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.operators import evidence as E
from evispark.tables import latest, table


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    fields = ["paper_id", "block_order", "section_title", "section_kind", "reading_type", "include_in_reading", "text", "caption"]
    b = latest(table(spark, sf, "reading_blocks"), ["reading_block_id"], "loaded_at", fields)
    return b.withColumnsRenamed({"reading_block_id": "id", "include_in_reading": "include"})


def in1_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that stand more than once, by hash."""
    d = table(spark, sf, "documents").where("text is not null").select(F.sha2("text", 256).alias("hash"), "doc_id")
    return d.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


def in15_cjk(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", E.cjk_share_all(F.col("text")).alias("share"), E.cjk_share_letters(F.col("text")).alias("letter_share"))
    return d.withColumn("defer", F.col("share") > 0.05).withColumn("letter_defer", F.col("letter_share") >= 0.15)


def rb2_section_kind(spark: SparkSession, sf: str) -> DataFrame:
    b = blocks(spark, sf)
    return b.groupBy("section_title", E.section_kind(F.col("section_title")).alias("kind")).agg(F.count("*").alias("n"))


def rb16_context(spark: SparkSession, sf: str) -> DataFrame:
    """Each block with the ids before and after it in its paper."""
    w = Window.partitionBy("paper_id").orderBy("block_order", "id")
    return blocks(spark, sf).where("paper_id is not null").select("id", F.lag("id").over(w).alias("before"), F.lead("id").over(w).alias("after"))


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    b = blocks(spark, sf).where("text is not null")
    return b.select("id", "section_kind", F.posexplode(E.sentences(F.col("text"))).alias("pos", "s"))


def ev3_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return _sentences(spark, sf).groupBy("id").agg(F.count("*").alias("sentences"), F.sum(F.length("s")).alias("chars"))


def ev4_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _sentences(spark, sf).select("id", "pos", E.sentence_score(F.col("s"), F.coalesce("section_kind", F.lit(""))).alias("score"))


def ev5_atom_types(spark: SparkSession, sf: str) -> DataFrame:
    return _sentences(spark, sf).groupBy(E.atom_type(F.col("s"), F.coalesce("section_kind", F.lit(""))).alias("atom_type")).agg(F.count("*").alias("n"))


def el4_values(spark: SparkSession, sf: str) -> DataFrame:
    """Values that the short parser finds in quotes of conditions with verified digits, per unit."""
    o = latest(table(spark, sf, "occurrences"), ["occ_id"], "loaded_at", ["facet", "quote", "digits_verified"]).where("facet = 'condition' and digits_verified = 1 and quote is not null")
    return o.select(F.explode(E.parse_values(F.col("quote"))).alias("v")).groupBy(F.col("v.unit").alias("unit")).agg(F.count("*").alias("n"), F.countDistinct("v.num").alias("numbers"))


def io13_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Author lists after upserts by DOI: blank keys ignored, the latest fetch wins."""
    a = table(spark, sf, "authors").where("trim(doi) <> ''").withColumn("key", F.lower(F.trim("doi")))
    return latest(a, ["key"], "fetched_at", ["authors", "fetched_at"]).select("key", F.when(F.col("authors").isNull(), 0).otherwise(F.size("authors")).alias("authors"), F.col("fetched_at").alias("fetched"))


def io14_export(spark: SparkSession, sf: str) -> DataFrame:
    """Per paper its blocks by type and flags."""
    b = blocks(spark, sf).groupBy("paper_id").agg(F.count("*").alias("blocks"), *[F.sum((F.col("reading_type") == t).cast("int")).alias(t + "s") for t in ("figure", "table", "paragraph")])
    p = latest(table(spark, sf, "papers"), ["paper_id"], "loaded_at", ["has_card"])
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return p.join(b, "paper_id", "left").select("paper_id", "has_card", n("blocks"), n("figures"), n("tables"), n("paragraphs"), F.col("blocks").isNotNull().alias("has_blocks"))


def _like(c: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower({c}), '{w}')" for w in words) + ")"


_IN = lambda c, vs: f"coalesce({c} in (" + ", ".join(f"'{v}'" for v in vs) + "), false)"
B = "with b as (select * exclude rn from (select *, reading_block_id id, row_number() over (partition by reading_block_id order by loaded_at desc) rn from reading_blocks) where rn = 1)"
_SQZ = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_T = _SQZ.format("coalesce(text, '')")
_INC = rf"({_T} <> '' and len(string_split({_T}, ' ')) >= 4 and not regexp_matches({_T}, '[.?!;:)\]}}]$') and not (len(string_split({_T}, ' ')) > 120 and regexp_matches({_T}, '\b[A-Z][a-z]+(?:\s+and\s+[A-Z][a-z]+)?$')))"
_DAN = "(" + " or ".join(f"suffix(lower({_T}), '{e}')" for e in E.DANGLING) + ")"
_CON = rf"({_T} <> '' and (regexp_matches({_T}, '^\[\d+(?:,\d+)*\]\.|^\d{{4}}[a-z]?\s*[;,)]|^\p{{Ll}}') or " + _IN(r"lower(regexp_replace(string_split(" + _T + r", ' ')[1], '^[ ,;:()\[\]{}]+|[ ,;:()\[\]{}]+$', '', 'g'))", E.CONTINUING) + "))"
# RE2 has no look-around: a mark is put where a sentence ends.
_SEN = B + rf""", v as (select id, coalesce(section_kind, '') section_kind, {_SQZ.format('text')} v from b where text is not null),
 p as (select id, section_kind, v, string_split(regexp_replace(v, '([.!?])\s+([A-Z0-9(])', '\1' || chr(1) || '\2', 'g'), chr(1)) s from v),
 q as (select id, section_kind, case when len(s) = 1 and length(v) > 450 then regexp_split_to_array(v, ';\s+') else s end s from p),
 f as (select id, section_kind, list_filter(list_transform(s, lambda x: trim(x)), lambda x: len(regexp_split_to_array(x, '\s+')) >= 5) s from q),
 sen as (select id, section_kind, unnest(s) s, generate_subscripts(s, 1) - 1 as pos from f)"""
_DIG = "case when regexp_matches(s, '[0-9]') then 'quantitative_result' else 'result' end"
_NAME = r"trim(regexp_replace(a[len(a)], '\s+', ' ', 'g'))"
_KEY = rf"""regexp_replace(lower(case when contains({_NAME}, ',') then split_part({_NAME}, ',', 1) else regexp_extract({_NAME}, '(\S+)$', 1) end), '[^a-z]', '', 'g') f,
 left(regexp_replace(lower(case when contains({_NAME}, ',') then regexp_replace({_NAME}, '^[^,]*,', '') else regexp_replace({_NAME}, '\s*\S+$', '') end), '[^a-z]', '', 'g'), 1) g"""
_T2 = r"trim(regexp_replace(lower(regexp_replace(trim(coalesce(section_title, '')), '^\d+(\.\d+)*\.?\s*', '')), '[^a-z0-9]+', '_', 'g'), '_')"

# No look-behind in RE2: the character before a number is taken into the match instead.
_VALUE = "(?:^|[^\\d.\\-])" + E.VALUE.split(")", 1)[1]
SQL = {
    "in1_hashes": "select sha256(text) hash, count(*) n, min(doc_id) first from documents where text is not null group by 1 having count(*) > 1",
    "in15_cjk": r"""with d as (select doc_id, length(coalesce(text, '')) l, length(regexp_replace(coalesce(text, ''), '[^㐀-鿿]', '', 'g')) c, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) a from documents),
 s as (select doc_id, case when l > 0 then c / l else 0.0 end share, case when c + a > 0 then round(c / (c + a), 4) else 0.0 end letter_share from d) select *, share > 0.05 defer, letter_share >= 0.15 letter_defer from s""",
    "rb2_section_kind": B + f""", t as (select section_title, {_T2} t from b) select section_title, case when t in ('abstract', 'a_b_s_t_r_a_c_t') then 'abstract' when contains(t, 'keyword') then 'keywords' when contains(t, 'introduction') then 'introduction'
 when {_like('t', ['method', 'experiment', 'simulation', 'computational'])} then 'methods' when {_like('t', ['result', 'discussion', 'analysis'])} then 'results_discussion' when {_like('t', ['conclusion', 'summary'])} then 'conclusion'
 when contains(t, 'reference') then 'references' else 'body' end kind, count(*) n from t group by 1, 2""",
    "rb16_context": B + "select id, lag(id) over w before, lead(id) over w as after from b where paper_id is not null window w as (partition by paper_id order by block_order, id)",
    "ev3_sentences": _SEN + " select id, count(*) sentences, sum(length(s)) chars from sen group by 1",
    "ev4_scores": _SEN + f" select id, pos, case when section_kind in ('abstract', 'conclusion') then 40 when {_IN('section_kind', E.CORE_SECTIONS)} then 30 else 0 end + 15 * regexp_matches(s, '[0-9]')::int + " + " + ".join(f"{n} * contains(lower(s), '{w}')::int" for w, n in E.SENTENCE_WEIGHTS.items()) + " score from sen",
    "ev5_atom_types": _SEN + f""" select case when {_like('s', E.LIMITS)} then 'limitation' when {_like('s', E.RANGES)} and {_like('s', E.CHANGES)} then {_DIG} when {_like('s', E.RANGES)} then 'variable'
 when section_kind = 'methods' or {_like('s', E.METHODS)} then 'method' when {_like('s', E.MECHANISMS)} then 'mechanism' when {_like('s', E.RESULTS)} then {_DIG}
 when section_kind in ('abstract', 'conclusion', 'results', 'discussion', 'results_discussion') then 'result' when section_kind = 'introduction' then 'background' else 'other' end atom_type, count(*) n from sen group by 1""",
    "io13_upsert": "select lower(trim(doi)) as key, coalesce(len(arg_max(struct_pack(a := authors), fetched_at).a), 0) authors, max(fetched_at) fetched from authors where trim(doi) <> '' group by 1",
    "io14_export": B + """, p as (select paper_id, has_card from (select *, row_number() over (partition by paper_id order by loaded_at desc) rn from papers) where rn = 1),
 n as (select paper_id, count(*) blocks, sum((reading_type = 'figure')::int) figures, sum((reading_type = 'table')::int) tables, sum((reading_type = 'paragraph')::int) paragraphs from b group by 1)
 select paper_id, has_card, coalesce(blocks, 0) blocks, coalesce(figures, 0) figures, coalesce(tables, 0) tables, coalesce(paragraphs, 0) paragraphs, blocks is not null has_blocks from p left join n using (paper_id)""",
    "el4_values": f"""with o as (select * from (select *, row_number() over (partition by occ_id order by loaded_at desc) rn from occurrences) where rn = 1 and facet = 'condition' and digits_verified = 1 and quote is not null),
 v as (select unnest(regexp_extract_all(quote, '{_VALUE}', 1)) num, unnest(regexp_extract_all(quote, '{_VALUE}', 2)) unit from o) select unit, count(*) n, count(distinct regexp_replace(num, '\\s*[-–—~]\\s*', '-', 'g')) numbers from v group by 1""",
}
QUERIES = {k: globals()[k] for k in SQL}
