"""Queries of the registry: entries, redirects, matching, verification of extracted items, topics and vocabularies, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.keys import norm_key
from evispark.operators import quotes as Q
from evispark.operators import registry as R
from evispark.operators import resolution as S
from evispark.plans.index_queries import OCC, load
from evispark.session import cut
from evispark.tables import latest, table

METHOD_FACETS = ["preparation", "measurement", "simulation"]
KINDS = {"object": ["material"], "method": METHOD_FACETS}


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """The reference list as a registry. The list has no redirects and no origin, so a rule stands in: of every ten entries of a facet, by id, the last three redirect to the one before, and every third is a seed."""
    e = table(spark, sf, "elements").select("element_id", "facet", "display_name", "aliases_json", "human_locked").where("element_id is not null").dropDuplicates(["element_id"])
    w = Window.partitionBy("facet").orderBy("element_id")  # the reference list, a fixed number of entries
    e = e.withColumn("rn", F.row_number().over(w)).withColumn("redirect_to", F.when((F.col("rn") % 10).isin(7, 8, 9), F.lag("element_id").over(w)))
    a = F.coalesce(F.from_json("aliases_json", "array<string>"), F.array().cast("array<string>"))
    origin = F.when(F.col("rn") % 3 == 0, "seed").otherwise("auto-stream")
    return e.select("element_id", "facet", "display_name", a.alias("aliases"), "redirect_to", origin.alias("origin"), F.coalesce("human_locked", F.lit(0)).alias("human_locked"), F.col("element_id").alias("ordinal"), "rn", "aliases_json")


def occurrences(spark: SparkSession, sf: str, fields: list[str]) -> DataFrame:
    return latest(table(spark, sf, "occurrences"), ["occ_id"], "loaded_at", fields).where("occ_id is not null")


def first_spellings(spark: SparkSession, sf: str) -> DataFrame:
    """(facet, display_name, arrival): each distinct surface of unresolved occurrences, once, by its first occurrence."""
    o = occurrences(spark, sf, ["facet", "surface", "element_id"]).where("element_id is null and facet is not null and trim(surface) <> ''")
    return o.groupBy("facet", F.col("surface").alias("display_name")).agg(F.min("occ_id").alias("arrival"))


def el2_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Extracted items against their blocks; every 40th item proposes a facet of its own."""
    o = occurrences(spark, sf, ["facet", "surface", "quote", "role", "reading_block_id"])
    other = F.col("occ_id") % 40 == 0
    items = o.withColumn("proposed_facet", F.when(other, F.col("facet"))).withColumn("facet", F.when(other, "other").otherwise(F.col("facet"))).withColumn("role", F.lower("role")).withColumn("item", F.lit(True))
    b = latest(table(spark, sf, "reading_blocks"), ["reading_block_id"], "loaded_at", ["text", "caption"])
    return Q.checked_items(items, b, table(spark, sf, "elements").select("facet")).select("occ_id", "facet", F.length("quote").alias("quote_chars"), "reason", "digits_verified")


def el3_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes against the text of their blocks, letters alone and with digits."""
    o = occurrences(spark, sf, ["quote", "reading_block_id"])
    b = latest(table(spark, sf, "reading_blocks"), ["reading_block_id"], "loaded_at", ["text", "caption"]).where("reading_block_id is not null")
    t = b.select("reading_block_id", F.coalesce(F.expr("nullif(text, '')"), F.col("caption"), F.lit("")).alias("t"))
    return Q.verified(o.join(t, "reading_block_id"), "quote", "t").select("occ_id", "quote_verified", "digits_verified", F.col("quote_reason").alias("reason"))


def el5_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per paper after findings are replaced by those that verify against their blocks."""
    o = occurrences(spark, sf, ["paper_id", "facet", "surface", "quote", "role", "reading_block_id"])
    b = latest(table(spark, sf, "reading_blocks"), ["reading_block_id"], "loaded_at", ["text", "caption"])
    new = Q.checked_items(o.where("facet = 'finding'").withColumn("role", F.lower("role")).withColumn("proposed_facet", F.lit(None).cast("string")).withColumn("item", F.lit(True)), b, spark.createDataFrame([("finding",)], "facet string"))
    done = Q.backfilled(o, new)
    old = o.groupBy("paper_id").agg(F.sum(F.coalesce(F.col("facet") == "finding", F.lit(False)).cast("int")).alias("removed_old"))
    return old.join(done.groupBy(F.col("paper_id").alias("p")).agg(F.count("*").alias("rows"), F.sum(F.coalesce(F.col("facet") == "finding", F.lit(False)).cast("int")).alias("added")), F.col("paper_id").eqNullSafe(F.col("p")), "left").select("paper_id", "removed_old", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("added", F.lit(0)).alias("added"))


def el6_seeds(spark: SparkSession, sf: str) -> DataFrame:
    r = registry(spark, sf)
    e = R.from_seeds(r.select("facet", F.col("display_name").alias("canonical"), "aliases", "ordinal"))
    return e.select("element_id", "facet", "display_name", F.array_join("aliases", "|").alias("aliases"), "origin")


def el7_create(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of new entries, one per spelling of what is unresolved, in order of arrival."""
    return R.create_entries(registry(spark, sf), first_spellings(spark, sf))


def el8_events(spark: SparkSession, sf: str) -> DataFrame:
    """A log folded: every resolved surface as alias, then every 7th entry renamed, then every 10th merged by a person into the one before."""
    r = registry(spark, sf).withColumn("redirect_to", F.when(F.col("rn") % 10 == 9, F.col("redirect_to")))
    o = occurrences(spark, sf, ["surface", "element_id"]).where("element_id is not null and surface is not null")
    alias = o.select(F.col("occ_id").alias("seq"), F.lit("alias").alias("event"), "element_id", F.col("surface").alias("detail"), F.lit("auto").alias("source"))
    rename = r.where("rn % 7 = 0").select((F.lit(10**12) + F.col("rn")).alias("seq"), F.lit("rename"), "element_id", F.concat("display_name", F.lit(" renamed")), F.lit("human"))
    w = Window.partitionBy("facet").orderBy("element_id")
    merge = r.withColumn("before", F.lag("element_id").over(w)).where("rn % 10 = 0").select((F.lit(2 * 10**12) + F.col("rn")).alias("seq"), F.lit("merge"), "element_id", "before", F.lit("human"))
    done = R.fold_events(r, alias.unionAll(rename).unionAll(merge))
    return done.select("element_id", "display_name", F.array_join(F.array_sort("aliases"), "|").alias("aliases"), "redirect_to", "human_locked")


def el9_redirects(spark: SparkSession, sf: str) -> DataFrame:
    return R.resolve_redirects(registry(spark, sf))


def el10_lookup(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "occurrences").where("facet is not null and surface is not null").select("facet", "surface").distinct()
    r = registry(spark, sf)
    return R.find(v, r, R.resolve_redirects(r))


def el11_unresolved(spark: SparkSession, sf: str) -> DataFrame:
    o = occurrences(spark, sf, ["facet", "surface", "element_id"]).withColumnRenamed("occ_id", "position")
    return R.unresolved(o, load(spark, sf).elements)


def _shortlist(spark: SparkSession, sf: str) -> DataFrame:
    r = registry(spark, sf)
    keys = el11_unresolved(spark, sf).where("key <> ''").select("facet", "key")
    return R.shortlist(keys, r.where("redirect_to is null").select("element_id", "facet", "display_name", "aliases_json"))


def el12_shortlist(spark: SparkSession, sf: str) -> DataFrame:
    return _shortlist(spark, sf).select("facet", "key", "element_id", "overlap", "rank")


def el13_chunks(spark: SparkSession, sf: str) -> DataFrame:
    keys = cut(el11_unresolved(spark, sf).where("key <> ''").select("facet", "key"))
    r = registry(spark, sf)
    s = R.shortlist(keys, r.where("redirect_to is null").select("element_id", "facet", "display_name", "aliases_json")).groupBy("facet", "key").agg(F.collect_set("element_id").alias("ids"))  # eight at most
    return S.pack_chunks(keys.join(s, ["facet", "key"], "left"))


def _committed(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts by rule: the first candidate of a shortlist with two common words or more; keys of a length that 11 divides have failed."""
    un = cut(el11_unresolved(spark, sf).where("key <> ''"))
    r = registry(spark, sf)
    said = R.shortlist(un.select("facet", "key"), r.where("redirect_to is null").select("element_id", "facet", "display_name", "aliases_json")).where("rank = 1 and overlap >= 2").select("facet", "key", "element_id")
    groups = un.select("facet", "key", F.col("first_surface").alias("surface"), F.struct("facet", "key").alias("arrival"))
    return S.commit(groups, said, un.where("length(key) % 11 = 0").select("facet", "key"), r, R.resolve_redirects(r))


def el14_commit(spark: SparkSession, sf: str) -> DataFrame:
    return _committed(spark, sf)


def el17_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """A first run over all surfaces, grouped by the first word; the most counted spelling names a group."""
    n = occurrences(spark, sf, ["facet", "surface"]).where("facet is not null and trim(surface) <> ''").groupBy("facet", F.trim("surface").alias("surface")).agg(F.count("*").alias("n"))
    n = cut(n)
    first = F.split(norm_key(F.col("surface")), " ")[0]
    g = n.withColumn("w", first).where("w <> ''").groupBy("facet", "w").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "surface"))).alias("m"))
    groups = g.select("facet", F.col("m")[0]["surface"].alias("canonical"), F.transform("m", lambda x: x["surface"]).alias("members"))
    r = registry(spark, sf)
    chunks, entries = S.bootstrap(n, groups, r, R.resolve_redirects(r))
    e = entries.groupBy("facet", "how").agg(F.count("*").alias("entries"), F.sum("members").alias("members"))
    return e.unionAll(chunks.groupBy("facet").agg(F.max("chunk").cast("bigint").alias("entries"), F.count("*").alias("members")).select("facet", F.lit("chunks").alias("how"), "entries", "members"))


def el18_superbuckets(spark: SparkSession, sf: str) -> DataFrame:
    """Entries with more than 12 aliases, those of the reference list and the spellings of its occurrences together."""
    r = registry(spark, sf)
    o = occurrences(spark, sf, ["surface", "element_id"]).where("element_id is not null").select("element_id", norm_key(F.col("surface")).alias("key"))
    own = r.select("element_id", F.explode(F.transform("aliases", norm_key)).alias("key"))
    names = r.select("element_id", norm_key(F.col("display_name")).alias("name"))
    all_ = own.unionAll(o.join(r.select("element_id"), "element_id", "left_semi")).where("key <> ''").distinct().join(names, "element_id").where("key <> name")
    return all_.groupBy("element_id").agg(F.count("*").alias("aliases")).where("aliases > 12")


def _with_plurals(spark: SparkSession, sf: str) -> DataFrame:
    """The registry with every 4th entry again in the plural, every 8th of them locked, so that there is something to merge."""
    r = registry(spark, sf).select("element_id", "facet", "display_name", "aliases", "redirect_to", "origin", "human_locked", "rn")
    more = r.where("rn % 4 = 0").select(F.concat("element_id", F.lit("-again")).alias("element_id"), "facet", F.concat("display_name", F.lit("s")).alias("display_name"), F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("redirect_to"), F.lit("auto-stream").alias("origin"), (F.col("rn") % 8 == 0).cast("int").alias("human_locked"), "rn")
    return r.unionAll(more)


def el19_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return R.duplicates(_with_plurals(spark, sf))


def el19_merged(spark: SparkSession, sf: str) -> DataFrame:
    m = R.merge_duplicates(_with_plurals(spark, sf))
    return R.resolve_redirects(m).where("element_id <> final")


def _topic_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Topics whose name has an even number of characters are known beforehand."""
    t = load(spark, sf).papers.select(F.explode("domain_tags").alias("v")).select(F.lower(F.trim("v")).alias("display_name")).where("display_name <> '' and length(display_name) % 2 = 0").distinct()
    e = R.create_entries(spark.createDataFrame([], "element_id string"), t.select(F.lit("topic").alias("facet"), "display_name", F.col("display_name").alias("arrival")))
    return e.select("element_id", "facet", "display_name", F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("redirect_to"), F.lit("seed").alias("origin"), F.lit(0).alias("human_locked"), F.col("arrival").alias("ordinal"))


def _topics(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    r = cut(_topic_registry(spark, sf))
    none = spark.createDataFrame([], "tag string, element_id string")
    return S.resolve_topics(load(spark, sf).papers.select("paper_id", "domain_tags"), r, R.resolve_redirects(r), none)


def el20_topic_import(spark: SparkSession, sf: str) -> DataFrame:
    """A vocabulary imported as topics: each tag's spellings under one norm_key are a concept."""
    r = cut(_topic_registry(spark, sf))
    t = load(spark, sf).papers.select(F.explode("domain_tags").alias("v")).select(F.trim("v").alias("v")).where("v <> ''").distinct().withColumn("k", norm_key(F.col("v"))).where("k <> ''")
    c = t.groupBy("k").agg(F.array_sort(F.collect_set("v")).alias("members")).select(F.col("members")[0].alias("canonical"), F.concat("members", F.array(F.concat("k", F.lit(" topic")))).alias("members"), F.col("k").alias("arrival"))
    return S.import_vocabulary(c, r, R.resolve_redirects(r))


def el21_topics(spark: SparkSession, sf: str) -> DataFrame:
    return _topics(spark, sf)[0]


def el22_topic_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _topics(spark, sf)[1].select("paper_id", F.array_join("topic_ids", "|").alias("topic_ids"))


def el23_tags(spark: SparkSession, sf: str) -> DataFrame:
    r = registry(spark, sf)
    return R.derived_tags(load(spark, sf).rows, r, KINDS, {"object": 6, "method": 7})


def el24_enrich(spark: SparkSession, sf: str) -> DataFrame:
    """Domain tags enriched by the paper's methods and objects, nine in all."""
    p = load(spark, sf).papers
    more = F.concat(F.coalesce("methods", F.array().cast("array<string>")), F.coalesce("research_objects", F.array().cast("array<string>")))
    return p.select("paper_id", F.array_join(S.enriched_tags(F.col("domain_tags"), more), "|").alias("tags"))


def el25_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return R.vocabulary(table(spark, sf, "elements").dropDuplicates(["element_id"]), KINDS)


def el26_tag_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Tags led to concepts by overlapping groups: those with one first word and those with one last word; groups of one word alone are not proposed."""
    counts = cut(S.tag_counts(load(spark, sf).papers, ["domain_tags", "methods", "research_objects"]))
    words = F.split(norm_key(F.col("tag")), " ")
    ends = counts.select("facet", "tag", F.explode(F.array(F.concat(F.lit("1 "), words[0]), F.concat(F.lit("2 "), F.element_at(words, -1)))).alias("ordinal"))
    groups = ends.groupBy("facet", "ordinal").agg(F.array_sort(F.collect_set("tag")).alias("members")).where("size(members) > 1").select("facet", "members", "ordinal", F.col("members")[0].alias("canonical"))
    return S.tag_vocabulary(counts, groups)


def el28_topup(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of a top-up run: papers pending and done, surfaces matched, created and put off."""
    ix = load(spark, sf)
    state = _committed(spark, sf).groupBy(F.col("state").alias("counter")).agg(F.count("*").alias("n"))
    have = ix.rows.select("paper_id").distinct().withColumn("h", F.lit(True))
    p = ix.papers.where("has_card = 1").join(have, "paper_id", "left").groupBy(F.when(F.col("h"), "papers_done").otherwise("papers_pending").alias("counter")).agg(F.count("*").alias("n"))
    return state.unionAll(p)


_NK = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_SLUG = r"coalesce(nullif(regexp_replace(regexp_replace(lower(trim({})), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unnamed')"
W = "with recursive " + OCC
_REG = r""", e0 as (select distinct element_id, facet, display_name, aliases_json, human_locked, case when json_valid(aliases_json) then coalesce(from_json(aliases_json, '["varchar"]'), []) else [] end aliases from elements where element_id is not null),
 e1 as (select *, row_number() over (partition by facet order by element_id) rn, lag(element_id) over (partition by facet order by element_id) pre from e0),
 reg as (select element_id, facet, display_name, aliases, aliases_json, coalesce(human_locked, 0) human_locked, rn, pre, case when rn % 3 = 0 then 'seed' else 'auto-stream' end origin, case when rn % 10 in (7, 8, 9) then pre end redirect_to from e1),
 hop(id, cur) as (select element_id, element_id from reg union all select hop.id, reg.redirect_to from hop join reg on reg.element_id = hop.cur where reg.redirect_to is not null),
 res as (select id, cur as final from hop where cur in (select element_id from reg where redirect_to is null))"""
_NAMES = f""", nm as (select distinct element_id, facet, {_NK.format('name')} as key from (select element_id, facet, display_name as name from reg union all select element_id, facet, unnest(aliases) from reg) where {_NK.format('name')} <> ''),
 best as (select facet, key, res.final element_id from (select facet, key, min(element_id) hit from nm group by 1, 2) join res on res.id = hit)"""
_UN = f""", u as (select facet, surface, occ_id, {_NK.format('surface')} as key from occ where (element_id is null or element_id not in (select element_id from e0)) and facet is not null and surface is not null),
 b0 as (select distinct facet, key from nm), un as (select facet, key, arg_min(surface, occ_id) first_surface, count(*) occurrences from u where not exists (select 1 from b0 where b0.facet = u.facet and b0.key = u.key) group by 1, 2)"""
_SHORT = """, kt as (select distinct facet, key, unnest(string_split(key, ' ')) t from un where key <> ''), nt as (select distinct element_id, facet, key nk, unnest(string_split(key, ' ')) t from nm where element_id in (select element_id from reg where redirect_to is null)),
 h as (select kt.facet, kt.key, element_id, nk, count(*) c from kt join nt on kt.facet = nt.facet and kt.t = nt.t group by 1, 2, 3, 4), ov as (select facet, key, element_id, max(c) overlap from h group by 1, 2, 3),
 short as (select facet, key, element_id, overlap, rank from (select ov.*, row_number() over (partition by ov.facet, ov.key order by overlap desc, display_name, element_id) rank from ov join (select element_id, display_name from reg) e using (element_id)) where rank <= 8)"""
_SHORT_ALL = W + _REG + _NAMES + _UN + _SHORT
_FREE = """ free as (select *, row_number() over (partition by base order by arrival) + (base in (select element_id from {reg}))::int k from wanted), made as (select case when k = 1 then base else base || '-' || k end element_id, facet, display_name, arrival from free)"""
_VF = r"""replace(replace(replace(replace(replace(replace(replace(replace(coalesce({}, ''), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), '²', '2'), '³', '3'), '…', '...')"""
_BT = """, bt as (select reading_block_id, coalesce(nullif(arg_max(struct_pack(t := text), loaded_at).t, ''), arg_max(struct_pack(t := caption), loaded_at).t, '') t from reading_blocks where reading_block_id is not null group by 1)"""
_VER = r""", v1 as (select *, list_filter(list_transform(string_split(q, '...'), lambda f: regexp_replace(lower(f), '[^\p{L}]', '', 'g')), lambda f: length(f) >= 12) lf, list_filter(list_transform(string_split(q, '...'), lambda f: regexp_replace(lower(f), '[^\p{L}\p{N}]', '', 'g')), lambda f: length(f) >= 12) tf,
   regexp_replace(lower(bt), '[^\p{L}]', '', 'g') bl, regexp_replace(lower(bt), '[^\p{L}\p{N}]', '', 'g') btt from v0),
 v2 as (select *, case when len(lf) = 0 then 'too_short' when len(list_filter(lf, lambda f: not contains(bl, f))) > 0 then 'not_found' else '' end reason from v1),
 ver as (select *, reason = '' quote_verified, reason = '' and len(tf) > 0 and len(list_filter(tf, lambda f: not contains(btt, f))) = 0 digits_verified from v2)"""
_TAGS = ", tg as (select paper_id, trim(v) surface, lower(trim(v)) tag, i - 1 as pos from (select paper_id, unnest(domain_tags) v, unnest(range(1, len(domain_tags) + 1)) i from pap) where trim(v) <> '')"
_TREG = f""", tn as (select distinct tag display_name from tg where length(tag) % 2 = 0), tw as (select display_name, 'elem:topic/' || {_SLUG.format('display_name')} base from tn),
 tk as (select *, row_number() over (partition by base order by display_name) k from tw), treg as (select case when k = 1 then base else base || '-' || k end element_id, display_name, {_NK.format('display_name')} as key from tk),
 tb as (select key, arg_min(element_id, display_name) element_id from treg where key <> '' group by 1)"""
_TOP = W + _TAGS + _TREG + f""", f1 as (select tag, arg_min(surface, (paper_id, pos)) surface, min((paper_id, pos)) arrival from tg group by 1), f2 as (select f1.*, tb.element_id hit from f1 left join tb on tb.key = {_NK.format('f1.surface')}),
 mk as (select tag, 'elem:topic/' || {_SLUG.format('surface')} base, arrival from f2 where hit is null),
 tkn as (select b, case when n = '' then 1 else n::int end k from (select regexp_replace(element_id, '-[0-9]+$', '') b, regexp_extract(element_id, '-([0-9]+)$', 1) n from treg) union all select element_id, 1 from treg),
 m2 as (select tag, base, row_number() over (partition by base order by arrival) r from mk), m3 as (select m2.tag, base, r, list_filter(range(1, 60), lambda x: not list_contains(coalesce(t.ks, []), x::int)) freek from m2 left join (select b, list(distinct k) ks from tkn group by 1) t on t.b = m2.base),
 m4 as (select tag, case when freek[r] = 1 then base else base || '-' || freek[r] end made from m3), topics as (select f2.tag, coalesce(hit, made) element_id, case when hit is not null then 'exact' else 'created' end how from f2 left join m4 using (tag))"""
_TC = ", tc as (select facet, tag, count(*) cards from (" + " union ".join(f"select paper_id, '{c}' facet, lower(trim(v)) tag from pap, unnest({c}) u(v) where trim(v) <> ''" for c in ("domain_tags", "methods", "research_objects")) + ") group by 1, 2)"
_PLURAL = """, wp as (select element_id, facet, display_name, aliases, redirect_to, origin, human_locked from reg union all select element_id || '-again', facet, display_name || 's', [], null, 'auto-stream', (rn % 8 = 0)::int from reg where rn % 4 = 0),
 dk as (select *, array_to_string(list_transform(string_split(trim(regexp_replace(lower(display_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: case when length(t) > 3 and t like '%s' and not (t like '%ss' or t like '%us' or t like '%is') then left(t, -1) else t end), ' ') dkey from wp where redirect_to is null),
 dt as (select facet, dkey, element_id, human_locked, first_value(element_id) over (partition by facet, dkey order by human_locked desc, (origin <> 'seed')::int, -len(aliases), element_id) target from dk)"""

SQL = {
    "el2_validation": W + _BT + ", v0 as (select occ_id, trim(case when occ_id % 40 = 0 then 'other' else coalesce(facet, '') end) f, trim(coalesce(facet, '')) pf, coalesce(role, '') role, bt.reading_block_id bid, substring(trim(coalesce(quote, '')), 1, 300) q0, "
    + _VF.format("substring(trim(coalesce(quote, '')), 1, 300)") + " q, " + _VF.format("bt.t") + " bt from occ left join bt on bt.reading_block_id = trim(coalesce(occ.reading_block_id, ''))) " + _VER
    + """ select occ_id, case when f = 'other' and pf <> '' then 'proposed:' || pf else f end facet, length(q0) quote_chars, case when not (f = 'other' and pf <> '') and f not in (select facet from elements where facet is not null) then 'bad_facet' when role not in ('used', 'mentioned') then 'bad_role' when bid is null then 'unknown_block' when reason = 'not_found' then 'quote_not_found' else reason end reason, digits_verified from ver""",
    "el3_quotes": W + _BT + ", v0 as (select occ_id, " + _VF.format("quote") + " q, " + _VF.format("bt.t") + " bt from occ join bt using (reading_block_id))" + _VER + " select occ_id, quote_verified, digits_verified, reason from ver",
    "el5_backfill": W + _BT + ", v0 as (select occ_id, paper_id, coalesce(role, '') role, bt.reading_block_id bid, " + _VF.format("substring(trim(coalesce(quote, '')), 1, 300)") + " q, " + _VF.format("bt.t") + " bt from occ left join bt on bt.reading_block_id = trim(coalesce(occ.reading_block_id, '')) where facet = 'finding')" + _VER
    + """, ok as (select paper_id, count(*) c from ver where role in ('used', 'mentioned') and bid is not null and reason = '' group by 1), old as (select paper_id, sum(coalesce(facet = 'finding', false)::int) removed_old, sum((not coalesce(facet = 'finding', false))::int) keep from occ group by 1)
 select old.paper_id, removed_old, keep + coalesce(c, 0) as rows, coalesce(c, 0) added from old left join ok on ok.paper_id is not distinct from old.paper_id""",
    "el6_seeds": W + _REG + f", s as (select 'elem:' || facet || '/' || {_SLUG.format('display_name')} id, * from reg) select id element_id, facet, display_name, array_to_string(list_filter(aliases, lambda a: {_NK.format('a')} <> {_NK.format('display_name')}), '|') aliases, 'seed' origin from (select *, row_number() over (partition by id order by element_id desc) r from s) where r = 1",
    "el7_create": W + _REG + f", wanted as (select facet, surface display_name, min(occ_id) arrival, 'elem:' || facet || '/' || {_SLUG.format('surface')} base from occ where element_id is null and facet is not null and trim(surface) <> '' group by 1, 2)," + _FREE.format(reg="reg") + " select element_id, facet, display_name, arrival from made",
    "el8_events": W + _REG + f""", al as (select element_id, surface, occ_id, {_NK.format('surface')} as key from r where surface is not null and element_id in (select element_id from reg)),
 own as (select element_id, {_NK.format('x')} as key from (select element_id, unnest(list_append(aliases, display_name)) x from reg)), fresh as (select element_id, key, arg_min(surface, occ_id) surface from al where not exists (select 1 from own where own.element_id = al.element_id and own.key = al.key) group by 1, 2),
 added as (select element_id, list(surface) l from fresh group by 1), st as (select reg.*, list_concat(aliases, coalesce(l, [])) al from reg left join added using (element_id))
 select element_id, case when rn % 7 = 0 then display_name || ' renamed' else display_name end display_name, array_to_string(list_sort(case when rn % 7 = 0 and not list_contains(list_transform(al, lambda a: {_NK.format('a')}), {_NK.format('display_name')}) then list_append(al, display_name) else al end), '|') aliases,
  case when rn % 10 = 9 then pre when rn % 10 = 0 then (select q.pre from reg q where q.element_id = st.pre) end redirect_to,
  case when rn % 7 = 0 then 1 when rn % 10 = 8 and exists (select 1 from reg q where q.facet = st.facet and q.rn = st.rn + 2) then 1 else human_locked end human_locked from st""",
    "el9_redirects": W + _REG + " select id element_id, final from res",
    "el10_lookup": W + _REG + _NAMES + f", v as (select distinct facet, surface from occurrences where facet is not null and surface is not null) select v.facet, surface, element_id from v left join best on best.facet = v.facet and best.key = {_NK.format('surface')}",
    "el11_unresolved": W + _REG + _NAMES + _UN + " select * from un",
    "el12_shortlist": _SHORT_ALL + " select * from short",
    "el13_chunks": _SHORT_ALL + """, it as (select un.facet, un.key, coalesce(ids, []) ids, row_number() over (partition by un.facet order by un.key) i from un left join (select facet, key, list(element_id) ids from short group by 1, 2) s on s.facet = un.facet and s.key = un.key where un.key <> ''),
 ch as (select facet, key, i, 1 as chunk, 1 as n, ids held from it where i = 1 union all
  select it.facet, it.key, it.i, case when full_ then chunk + 1 else chunk end, case when full_ then 1 else n + 1 end, case when full_ then it.ids else list_distinct(list_concat(held, it.ids)) end
  from (select ch.*, it.ids nids, ch.n >= 30 or len(list_distinct(list_concat(ch.held, it.ids))) > 120 full_ from ch join it on it.facet = ch.facet and it.i = ch.i + 1) c join it on it.facet = c.facet and it.i = c.i + 1)
 select facet, key, chunk from ch""",
    "el14_commit": _SHORT_ALL + f""", said as (select facet, key, element_id hit from short where rank = 1 and overlap >= 2), g as (select un.facet, un.key, first_surface surface, hit, length(un.key) % 11 = 0 failed from un left join said on said.facet = un.facet and said.key = un.key where un.key <> ''),
 wanted as (select facet, surface display_name, key arrival, 'elem:' || facet || '/' || {_SLUG.format('surface')} base from g where not failed and hit is null),""" + _FREE.format(reg="reg") + """
 select g.facet, g.key, surface, case when failed then 'skipped' when hit is not null then 'matched' else 'created' end state, case when failed then null else coalesce(hit, m.element_id) end element_id from g left join made m on m.facet = g.facet and m.arrival = g.key""",
    "el17_bootstrap": W + _REG + _NAMES + f""", n as (select facet, trim(surface) surface, count(*) n from occ where facet is not null and trim(surface) <> '' group by 1, 2), k as (select *, {_NK.format('surface')} as key from n),
 g as (select facet, string_split(key, ' ')[1] w, list(surface order by n desc, surface) m from k where key <> '' group by 1, 2), g2 as (select facet, m[1] canonical, {_NK.format('m[1]')} as key, m[1:8] m from g),
 nmd as (select facet, key, min(canonical) d, list_distinct(flatten(list(m))) m from g2 group by 1, 2), held as (select facet, key from nmd union select facet, {_NK.format('x')} from (select facet, unnest(m) x from nmd)),
 lft as (select distinct facet, key from k where not exists (select 1 from best where best.facet = k.facet and best.key = k.key) and not exists (select 1 from held where held.facet = k.facet and held.key = k.key))
 select facet, how, count(*) entries, sum(m) members from (select nmd.facet, case when element_id is not null then 'found' else 'created' end how, len(m) m from nmd left join best on best.facet = nmd.facet and best.key = nmd.key union all select facet, 'leftover', 0 from lft) group by 1, 2
 union all select facet, 'chunks', max((r - 1) // 150 + 1), count(*) from (select facet, row_number() over (partition by facet order by n desc, surface) r from n) group by 1""",
    "el18_superbuckets": W + _REG + f""", x as (select element_id, {_NK.format('v')} as key from (select element_id, unnest(aliases) v from reg union all select element_id, surface from r where element_id in (select element_id from reg)))
 select element_id, count(distinct key) aliases from x join (select element_id, {_NK.format('display_name')} as name from reg) using (element_id) where key <> '' and key <> name group by 1 having count(distinct key) > 12""",
    "el19_duplicates": W + _REG + _PLURAL + """ select facet, dkey, target, coalesce(string_agg(case when human_locked = 0 then element_id end, ',' order by element_id), '') sources, sum((human_locked <> 0)::int) kept from dt where element_id <> target group by 1, 2, 3""",
    "el19_merged": W + _REG + _PLURAL + """, nx as (select wp.element_id, coalesce(case when dt.human_locked = 0 and dt.target <> dt.element_id then dt.target end, wp.redirect_to) nxt from wp left join dt using (element_id)),
 hp(id, cur) as (select element_id, element_id from nx union all select hp.id, nx.nxt from hp join nx on nx.element_id = hp.cur where nx.nxt is not null) select id element_id, cur as final from hp where cur in (select element_id from nx where nxt is null) and id <> cur""",
    "el20_topic_import": W + _TAGS + _TREG + f""", sp as (select distinct surface v, {_NK.format('surface')} as k from tg), c as (select k, list(v order by v) m from sp where k <> '' group by 1),
 c2 as (select k, m[1] canonical, list_append(m, k || ' topic') members, tb.element_id hit from c left join tb on tb.key = k), mk as (select k, 'elem:topic/' || {_SLUG.format('canonical')} base from c2 where hit is null),
 own as (select element_id, key from treg), o as (select c2.*, coalesce(hit, base) id from c2 left join mk using (k))
 select canonical, id element_id, case when hit is not null then 'already' else 'created' end how, len(list_filter(list_distinct(list_transform(list_filter(members, lambda x: x <> canonical), lambda x: {_NK.format('x')})), lambda x: x <> k)) aliased from o""",
    "el21_topics": _TOP + " select * from topics",
    "el22_topic_ids": _TOP + ", pl as (select paper_id, element_id, min(pos) pos from tg join topics using (tag) group by 1, 2) select paper_id, string_agg(element_id, '|' order by pos) topic_ids from pl group by 1",
    "el23_tags": W + _REG + _NAMES + f""", k as (select element_id, display_name, origin = 'seed' seed, case when facet = 'material' then 'object' when facet in ('preparation', 'measurement', 'simulation') then 'method' end kind from reg),
 c as (select paper_id, kind, display_name tag, count(*) n, min(element_id) element_id, arg_min(seed, element_id) seed from r join k using (element_id) where role = 'used' and kind is not null group by 1, 2, 3),
 fi as (select paper_id, ' ' || string_agg(distinct {_NK.format('surface')}, ' ' order by {_NK.format('surface')}) || ' ' txt from r where facet = 'finding' and surface is not null group by 1),
 hit as (select distinct c.paper_id, c.kind, c.tag from c join fi using (paper_id) join nm on nm.element_id = c.element_id where contains(txt, ' ' || nm.key || ' ')),
 j as (select c.*, exists (select 1 from hit where hit.paper_id = c.paper_id and hit.kind = c.kind and hit.tag = c.tag) in_finding from c)
 select paper_id, kind, rank, tag, n, in_finding from (select *, row_number() over (partition by paper_id, kind order by in_finding desc, n desc, seed desc, tag) rank from j) where rank <= case kind when 'object' then 6 else 7 end""",
    "el24_enrich": W + """, x as (select paper_id, coalesce(domain_tags, []) t, list_filter(list_transform(list_concat(coalesce(methods, []), coalesce(research_objects, [])), lambda v: trim(v)), lambda v: v <> '') m from pap),
 y as (select paper_id, t, list_filter(m, lambda v: not list_contains(list_transform(t, lambda z: lower(trim(z))), lower(v))) f from x), z as (select paper_id, t, list_filter(f, lambda v, i: list_position(list_transform(f, lambda q: lower(q)), lower(v)) = i) o from y)
 select paper_id, array_to_string(list_concat(t, o[1:greatest(0, 9 - len(t))]), '|') tags from z""",
    "el25_vocabulary": W + _REG + """, m as (select case when facet = 'material' then 'object' when facet in ('preparation', 'measurement', 'simulation') then 'method' end out_facet, lower(trim(name)) member, display_name, human_locked, element_id
   from (select element_id, facet, display_name, human_locked, unnest(list_append(aliases, display_name)) as name from reg) where trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) <> '')
 select out_facet, member, first(display_name order by human_locked desc, display_name, element_id) canonical, count(distinct display_name) - 1 collisions from m where out_facet is not null group by 1, 2""",
    "el26_tag_vocabulary": W + _TC + f""", en as (select facet, tag, cards, unnest(['1 ' || string_split({_NK.format('tag')}, ' ')[1], '2 ' || string_split({_NK.format('tag')}, ' ')[-1]]) o from tc),
 gr as (select facet, o, min(tag) canonical, count(distinct tag) size, sum(cards) weight from en group by 1, 2 having count(distinct tag) > 1), pick as (select en.facet, en.tag, first(canonical order by size desc, weight desc, gr.o) canonical from en join gr on gr.facet = en.facet and gr.o = en.o group by 1, 2)
 select tc.facet, tc.tag, coalesce(canonical, tc.tag) canonical, cards, canonical is null dropped from tc left join pick using (facet, tag)""",
    "el28_topup": _SHORT_ALL + """, said as (select facet, key from short where rank = 1 and overlap >= 2), g as (select case when length(un.key) % 11 = 0 then 'skipped' when said.key is not null then 'matched' else 'created' end counter from un left join said on said.facet = un.facet and said.key = un.key where un.key <> '')
 select counter, count(*) n from g group by 1 union all select case when paper_id in (select paper_id from r) then 'papers_done' else 'papers_pending' end, count(*) from pap where has_card = 1 group by 1""",
}
QUERIES = {k: globals()[k] for k in SQL}
