"""Queries of evidence atoms, syntheses, cards and their checks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.operators import atoms as A
from evispark.operators import cards as C
from evispark.operators import evidence as E
from evispark.operators import quotes as Q
from evispark.plans.text_queries import _IN, _SQZ, B, _like
from evispark.session import cut
from evispark.tables import latest, table


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Reading blocks with their sources and pages; those without a paper are left out."""
    fields = ["paper_id", "block_order", "section_title", "section_kind", "reading_type", "include_in_reading", "page_start", "page_end", "source_block_ids", "text", "caption"]
    b = latest(table(spark, sf, "reading_blocks"), ["reading_block_id"], "loaded_at", fields).where("reading_block_id is not null and paper_id is not null")
    return b.withColumnsRenamed({"reading_block_id": "id", "include_in_reading": "include", "source_block_ids": "source_ids"})


def atoms(spark: SparkSession, sf: str) -> DataFrame:
    """Rule-based atoms of all papers, with ids; cut, as most queries use it several times."""
    a = A.pick_atoms(blocks(spark, sf)).withColumn("atom_id", F.concat("paper_id", F.lit("-EVATOM-"), F.format_string("%04d", F.col("n")))).withColumn("seq", F.col("n"))
    return cut(a)


def ev1_relevant(spark: SparkSession, sf: str) -> DataFrame:
    """The 140 best blocks of each paper for its card, with their place in order."""
    r = E.relevant_blocks(blocks(spark, sf)).select("paper_id", "id", "score", "rank", "block_order")
    return r.withColumn("place", F.row_number().over(Window.partitionBy("paper_id").orderBy("block_order", "id"))).drop("block_order")


def ev2_relevant(spark: SparkSession, sf: str) -> DataFrame:
    return A.relevant_for_atoms(blocks(spark, sf)).select("paper_id", "id", "score", "rank")


def ev6_topics(spark: SparkSession, sf: str) -> DataFrame:
    return blocks(spark, sf).select("id", F.array_join(A.topic_tags(F.col("text")), "|").alias("tags"))


def ev7_atoms(spark: SparkSession, sf: str) -> DataFrame:
    return atoms(spark, sf).select("paper_id", "n", F.col("id").alias("block"), "quote", "atom_type", F.array_join("topic_tags", "|").alias("tags"), "score")


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    """Each occurrence's quote as a claim beside the text of its block."""
    o = latest(table(spark, sf, "occurrences"), ["occ_id"], "loaded_at", ["paper_id", "surface", "quote", "reading_block_id"]).where("occ_id is not null and quote is not null")
    b = blocks(spark, sf).select(F.col("id").alias("reading_block_id"), A.block_text().alias("text"))
    return o.join(b, "reading_block_id")


def ev8_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes in their blocks, their overlap, and the quote that repair leaves."""
    c = _claims(spark, sf)
    q, t = F.col("quote"), F.col("text")
    return c.select("occ_id", Q.in_block(q, t).alias("in_block"), F.round(Q.overlap(q, t), 6).alias("overlap"), F.sha2(Q.repaired_quote(q, t), 256).alias("repaired"))


def _proposed(spark: SparkSession, sf: str) -> DataFrame:
    """Atoms as a careless hand might propose them: every third names only a source, every fifth an odd type, every seventh an odd confidence, every second quote is upper case, every eleventh empty."""
    b = blocks(spark, sf).select("id", "source_ids")
    a = atoms(spark, sf).join(b, "id")
    at = lambda k: F.col("n") % k == 0
    return a.select("paper_id", F.col("n").alias("seq"), F.when(~at(3), F.col("id")).alias("reading_block_id"), F.when(at(4), F.concat("source_ids", F.array(F.lit("none")))).otherwise(F.col("source_ids")).alias("source_ids"), F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"), F.when(at(11), "").when(at(2), F.upper("quote")).otherwise(F.col("quote")).alias("quote"), F.when(at(6), " ").otherwise(F.col("minimal_claim")).alias("minimal_claim"), F.when(at(9), F.array().cast("array<string>")).otherwise(F.array(F.lit(" a  b"), F.lit("a b"), F.lit(""))).alias("topic_tags"), F.when(at(5), "Odd").otherwise(F.upper("atom_type")).alias("atom_type"), F.when(at(7), "sure").otherwise(" HIGH ").alias("confidence"))


def ev9_normalised(spark: SparkSession, sf: str) -> DataFrame:
    n = A.normalise_atoms(_proposed(spark, sf), blocks(spark, sf))
    return n.select("paper_id", "seq", "reading_block_id", F.array_join("source_ids", ",").alias("sources"), "page_start", "page_end", F.sha2("quote", 256).alias("quote"), F.array_join("topic_tags", "|").alias("tags"), "atom_type", "confidence", "found")


def ev10_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers with a unit in a quote whose digits its block doesn't hold."""
    return _claims(spark, sf).select("occ_id", A.drifted(F.col("quote"), F.col("text")).alias("d")).where("size(d) > 0").select("occ_id", F.array_join("d", "|").alias("drift"))


def ev11_check(spark: SparkSession, sf: str) -> DataFrame:
    """Validation of proposed atoms as they are, without normalisation; ids repeat every 12."""
    p = _proposed(spark, sf).withColumn("atom_id", F.concat("paper_id", F.lit("-"), (F.col("seq") % 12).cast("string"))).withColumn("minimal_claim", F.concat_ws(" ", "minimal_claim", F.when(F.col("seq") % 8 == 0, "at 98765 MPa")))
    return A.check_atoms(p, blocks(spark, sf))


def _syntheses(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    a = atoms(spark, sf)
    return cut(A.template_syntheses(a)), a


def ev12_syntheses(spark: SparkSession, sf: str) -> DataFrame:
    s, _ = _syntheses(spark, sf)
    return s.select("paper_id", "nth", "synthesis_type", "claim", F.array_join("support", ",").alias("support"), "scope", F.size("limitations").alias("limitations"))


def _scoped(s: DataFrame) -> DataFrame:
    """Syntheses with a scope of numbers, every second one with an unknown atom, every third with one atom only."""
    scope = F.concat("scope", F.lit(" in "), (F.lit(1980) + F.col("nth") * 7).cast("string"), F.lit(" at 2 and 142 and 10"))
    support = F.when(F.col("nth") % 3 == 0, F.slice("support", 1, 1)).when(F.col("nth") % 2 == 0, F.concat("support", F.array(F.lit("none")))).otherwise(F.col("support"))
    return s.withColumn("scope", scope).withColumn("support", support)


def ev13_check(spark: SparkSession, sf: str) -> DataFrame:
    s, a = _syntheses(spark, sf)
    return A.check_syntheses(_scoped(s), a)


def ev14_scope(spark: SparkSession, sf: str) -> DataFrame:
    s, a = _syntheses(spark, sf)
    return A.supported_scope(_scoped(s), a).select("paper_id", "nth", F.array_join("support", ",").alias("support"))


def _themes(a: DataFrame) -> DataFrame:
    """Themes of each paper: its atom types, with the first three atoms and two groups of words; a synthesis needs two of the atoms and a word."""
    g = a.where("n <= 12").groupBy("paper_id", "atom_type").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("n", "atom_id"))), lambda x: x["atom_id"]), 1, 3).alias("expected"))
    return g.select("paper_id", F.col("atom_type").alias("theme_id"), F.concat(F.col("atom_type"), F.lit(" of the core")).alias("label"), "expected", F.array(F.array(F.lit("measured"), F.lit("Paper links")), F.array(F.lit("purpose,  setup"))).alias("term_groups"), F.lit(2).alias("least_overlap"), F.lit(1).alias("least_hits"))


def ev15_themes(spark: SparkSession, sf: str) -> DataFrame:
    s, a = _syntheses(spark, sf)
    return A.theme_coverage(_themes(a), s)


def ev16_themes(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage where support or terms suffice."""
    s, a = _syntheses(spark, sf)
    return A.theme_coverage(_themes(a), s, both=False)


def ev16_stability(spark: SparkSession, sf: str) -> DataFrame:
    """Signatures of three rounds: all syntheses, those without the second, the same again."""
    s, _ = _syntheses(spark, sf)
    sig = s.withColumn("signature", A.signature(F.col("synthesis_type"), F.col("support"), F.col("claim"))).withColumn("round", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    return A.stability(sig.select("paper_id", "round", F.when((F.col("round") == 1) | (F.col("nth") != 2), F.col("signature")).alias("signature")))


def ev17_canonical(spark: SparkSession, sf: str) -> DataFrame:
    a = atoms(spark, sf)
    return A.canonical_syntheses(_themes(a), a).select("paper_id", "theme_id", "synthesis_type", "claim", F.array_join("support", ",").alias("support"))


def ev18_best_block(spark: SparkSession, sf: str) -> DataFrame:
    """The block that each paper's objective fits best."""
    p = load_papers(spark, sf).select(F.col("paper_id").alias("query_id"), "paper_id", F.col("objective").alias("query"))
    return A.best_blocks(p, blocks(spark, sf)).select("query_id", "id", F.round("recall", 6).alias("recall"))


def load_papers(spark: SparkSession, sf: str) -> DataFrame:
    fields = ["has_card", "title", "year", "journal", "doi", "paper_type", "objective", "research_objects", "methods", "domain_tags", "main_findings"]
    return latest(table(spark, sf, "papers"), ["paper_id"], "loaded_at", fields).where("paper_id is not null")


def ev19_design(spark: SparkSession, sf: str) -> DataFrame:
    return C.study_design(blocks(spark, sf)).select("paper_id", "aspect", "id")


def ev19_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return C.keywords(load_papers(spark, sf)).select("paper_id", "rank", "keyword", "reason")


def ev19_section(spark: SparkSession, sf: str) -> DataFrame:
    return load_papers(spark, sf).select("paper_id", C.review_section(F.col("research_objects"), F.col("methods"), F.col("domain_tags")).alias("section"))


def ev20_card_check(spark: SparkSession, sf: str) -> DataFrame:
    """Checks of cards built by rule."""
    b = blocks(spark, sf)
    return C.check_cards(load_papers(spark, sf), C.rule_card(b), b)


def ev21_card(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of a card built by rule with the block that each stands on."""
    return C.rule_card(blocks(spark, sf)).select("paper_id", "field", "id", F.sha2("quote", 256).alias("quote"))


def ev22_slim(spark: SparkSession, sf: str) -> DataFrame:
    """Slim cards settled with the metadata of citations, and their warnings."""
    c = latest(table(spark, sf, "citations"), ["citation_id"], "harvested_at", ["title", "doi", "year", "journal"])
    meta = c.where("doi <> ''").groupBy(F.lower(F.trim("doi")).alias("key")).agg(F.max(F.struct("citation_id", F.col("title").alias("meta_title"), F.col("year").alias("meta_year"), F.col("journal").alias("meta_journal"))).alias("m"))
    p = load_papers(spark, sf).withColumn("key", F.lower(F.regexp_extract(F.coalesce("doi", F.lit("")), r"(10\..*)$", 1)))
    j = p.join(meta, "key", "left").select("paper_id", "title", "doi", "year", "journal", "paper_type", "objective", "research_objects", "methods", "domain_tags", "main_findings", "m.meta_title", F.lit(None).cast("string").alias("meta_doi"), "m.meta_year", "m.meta_journal")
    return C.slim_cards(j).select("paper_id", "title", "year", "journal", "paper_type", F.size("domain_tags").alias("n_tags"), F.size("main_findings").alias("n_findings"), F.array_join("warnings", "|").alias("warnings"), "status")


def ev23_grounding(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the quotes of each paper's occurrences stand where they say; every 10th names the block of another."""
    o = latest(table(spark, sf, "occurrences"), ["occ_id"], "loaded_at", ["paper_id", "quote", "reading_block_id"]).where("occ_id is not null")
    moved = F.when(F.col("occ_id") % 10 == 0, F.concat("paper_id", F.lit("-RB-0001"))).otherwise(F.col("reading_block_id"))
    return Q.grounded(o.select(F.col("paper_id").alias("card"), moved.alias("reading_block_id"), "quote"), blocks(spark, sf).select(F.col("paper_id").alias("card"), "id", F.col("block_order").alias("place"), "text"))


def ev24_even_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty papers spread evenly over all, in order of id."""
    return A.even_sample(load_papers(spark, sf).select("paper_id"), "paper_id", 20)


def ev24_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts on the sampled papers' summaries, tallied; a rule stands in for the judge: a paper without an objective is `off`, one without findings `partial`."""
    p = load_papers(spark, sf)
    s = ev24_even_sample(spark, sf).join(p.select("paper_id", "objective", "main_findings"), "paper_id")
    v = F.when(F.coalesce(F.trim("objective"), F.lit("")) == "", "off").when(F.coalesce(F.size("main_findings"), F.lit(0)) < 1, "partial").otherwise("faithful")
    return s.groupBy(v.alias("verdict")).agg(F.count("*").alias("papers"))


def ev25_verification(spark: SparkSession, sf: str) -> DataFrame:
    """Atoms without a verdict and with drifted numbers per paper; every 4th atom has not been judged."""
    a = atoms(spark, sf)
    judged = a.where("n % 4 <> 0").select("atom_id")
    return C.verification(a.withColumn("minimal_claim", F.concat_ws(" ", "minimal_claim", F.when(F.col("n") % 8 == 0, "at 98765 MPa"))), judged)


def ev26_references(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence references of proposed atoms settled: block, sources, pages, and the head of the block where there is no quote."""
    return C.references(_proposed(spark, sf), blocks(spark, sf)).select("paper_id", "seq", "reading_block_id", F.array_join("source_ids", ",").alias("sources"), "page_start", "page_end", F.sha2("quote", 256).alias("quote"))


def ev27_numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised atoms once per block and quote, numbered anew."""
    n = A.numbered_atoms(A.normalise_atoms(_proposed(spark, sf), blocks(spark, sf)))
    return n.select("paper_id", "seq", "atom_id")


def ev28_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """The sentence of an occurrence's block that its surface asks for."""
    c = _claims(spark, sf).where("surface is not null")
    return c.select("occ_id", F.sha2(A.focused_quote(F.col("text"), F.col("surface")), 256).alias("quote"))


def ev29_first_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return C.first_by_kind(blocks(spark, sf), ["abstract", "methods", "results", "conclusion"])


def ev30_accepted(spark: SparkSession, sf: str) -> DataFrame:
    """Packages accepted after validation: the first valid attempt, else the rule-based one if it is valid, else failed."""
    b = blocks(spark, sf)
    a = cut(A.pick_atoms(b).withColumn("atom_id", F.concat("paper_id", F.lit("-EVATOM-"), F.format_string("%04d", F.col("n")))).withColumn("seq", F.col("n")).withColumn("confidence", F.lit("medium")))
    full = a.join(b.select("id", "source_ids", "page_start", "page_end"), "id").withColumnRenamed("id", "reading_block_id")
    tries = [A.check_atoms(_proposed(spark, sf).withColumn("atom_id", F.concat("paper_id", F.lit("-"), "seq")), b).withColumn("attempt", F.lit(1)), A.check_atoms(full.where("n <= 12 and n % 5 <> 0").withColumn("minimal_claim", F.when(F.length("paper_id") % 2 == 0, "").otherwise(F.col("minimal_claim"))), b).withColumn("attempt", F.lit(2))]
    return C.accepted(tries[0].unionByName(tries[1]), A.check_atoms(full, b))


def ev31_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Statuses of all validators, counted."""
    parts = [f(spark, sf).select(F.lit(k).alias("kind"), "status") for k, f in (("atoms", ev11_check), ("syntheses", ev13_check), ("slim", ev22_slim), ("card", ev20_card_check))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    return every.groupBy("kind", "status").agg(F.count("*").alias("papers"))


_ST = lambda c, n: f"(case when length({c}) > {n} then rtrim(substring({c}, 1, {n - 1})) || '...' else {c} end)"
_LIST = lambda ws: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + "]"
_WR = B.replace("with b as", "with recursive b as", 1)
_BT = _WR + f", bt as (select * exclude bt, {_SQZ.format('bt')} t, bt from (select *, coalesce(nullif(text, ''), caption, '') bt from b where id is not null and paper_id is not null))"
_KW = "case section_kind " + " ".join(f"when '{k}' then {w}" for k, w in A.KIND_WEIGHTS.items()) + " else 10 end"
_REL = _BT + f""", rel0 as (select *, {_KW} + case when reading_type in ('paragraph', 'list_item') then 25 when reading_type in ('figure', 'table', 'caption') then 35 when reading_type = 'section_heading' then -80 else 0 end + 15 * regexp_matches(t, '[0-9]')::int + 45 * {_like('t', A.BLOCK_WORDS)}::int score
   from bt where coalesce(include_in_reading, true) and length(t) >= 25 and not {_IN('section_kind', A.SKIPPED_KINDS)} and not {_IN('reading_type', A.SKIPPED_TYPES)}), rel as (select *, row_number() over (partition by paper_id order by score desc, block_order, id) rank from rel0)"""
_SPLIT = """, {n}p as (select {k}, v, string_split(regexp_replace(v, '([.!?])\\s+([A-Z0-9(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) s from {src}),
 {n}q as (select {k}, case when len(s) = 1 and length(v) > 450 then regexp_split_to_array(v, ';\\s+') else s end s from {n}p), {n}f as (select {k}, list_filter(list_transform(s, lambda x: trim(x)), lambda x: len(regexp_split_to_array(x, '\\s+')) >= 5) s from {n}q),
 {n} as (select {k}, unnest(s) s, generate_subscripts(s, 1) - 1 as pos from {n}f)"""
_DIG = "case when regexp_matches(s, '[0-9]') then 'quantitative_result' else 'result' end"
_TYPE = f"""case when {_like('s', E.LIMITS)} then 'limitation' when {_like('s', E.RANGES)} and {_like('s', E.CHANGES)} then {_DIG} when {_like('s', E.RANGES)} then 'variable' when kind = 'methods' or {_like('s', E.METHODS)} then 'method' when {_like('s', E.MECHANISMS)} then 'mechanism'
  when {_like('s', E.RESULTS)} then {_DIG} when kind in ('abstract', 'conclusion', 'results', 'discussion', 'results_discussion') then 'result' when kind = 'introduction' then 'background' else 'other' end"""
_SCORE = f"case when kind in ('abstract', 'conclusion') then 40 when {_IN('kind', E.CORE_SECTIONS)} then 30 else 0 end + 15 * regexp_matches(s, '[0-9]')::int + " + " + ".join(f"{n} * contains(lower(s), '{w}')::int" for w, n in E.SENTENCE_WEIGHTS.items())
_TAGS = lambda c: f"(case when len(list_filter({_LIST(A.TOPIC_WORDS)}, lambda w: contains(lower({c}), w))) = 0 then ['paper-evidence'] else list_filter({_LIST(A.TOPIC_WORDS)}, lambda w: contains(lower({c}), w))[1:8] end)"
_ATOM = _REL + ", sv as (select paper_id, id, block_order, coalesce(section_kind, '') kind, t v from rel where rank <= 90)" + _SPLIT.format(n="sen", k="paper_id, id, block_order, kind", src="sv") + f""",
 sc as (select *, {_SCORE} score from (select * replace ({_ST('s', 520)} as s) from sen)), cand as (select *, case when length(s) > 520 then rtrim(substring(s, 1, 520)) else s end quote, row_number() over (partition by paper_id order by score desc, block_order, id, pos) i from sc where score >= 45),
 pick(paper_id, i, ids, qs, took) as (select distinct paper_id, 0::bigint, []::varchar[], []::varchar[], false from cand union all
   select paper_id, i, case when ok then list_append(ids, id) else ids end, case when ok then list_append(qs, lower(quote)) else qs end, ok from (select c.paper_id, c.i, c.id, c.quote, p.ids, p.qs, len(p.qs) < 24 and len(list_filter(p.ids, lambda x: x = c.id)) < 2 and not list_contains(p.qs, lower(c.quote)) ok from pick p join cand c on c.paper_id = p.paper_id and c.i = p.i + 1)),
 atoms as (select c.paper_id, len(p.qs) n, c.id, c.quote, {_ST('c.quote', 240)} minimal_claim, {_TYPE} atom_type, {_TAGS('s')} topic_tags, score, c.paper_id || '-EVATOM-' || lpad(len(p.qs)::varchar, 4, '0') atom_id from pick p join cand c using (paper_id, i) where took)"""
_TERMS = lambda c: f"list_distinct(list_transform(list_filter(regexp_extract_all({c}, '{Q.TERM[1:-1]}'), lambda x: length(x) >= 2), lambda x: lower(x)))"
_OVER = lambda a, b: f"(case when len({_TERMS(a)}) > 0 then len(list_intersect({_TERMS(a)}, {_TERMS(b)})) / len({_TERMS(a)}) else 0.0 end)"
_OC = ", oc as (select o.occ_id, o.paper_id, o.surface, " + _SQZ.format("o.quote") + " q, o.quote raw, bt.t, bt.id from (select *, row_number() over (partition by occ_id order by loaded_at desc) rn from occurrences where occ_id is not null) o join bt on bt.id = o.reading_block_id where rn = 1 and o.quote is not null)"
_SALL = ", sav as (select id, t v from bt)" + _SPLIT.format(n="sa", k="id", src="sav")
_PROP = """, prop as (select a.paper_id, n seq, case when n % 3 <> 0 then a.id end reading_block_id, case when n % 4 = 0 then list_append(bt.source_block_ids, 'none') else bt.source_block_ids end source_ids, case when n % 11 = 0 then '' when n % 2 = 0 then upper(quote) else quote end quote,
  case when n % 6 = 0 then ' ' else minimal_claim end minimal_claim, case when n % 9 = 0 then [] else [' a  b', 'a b', ''] end topic_tags, case when n % 5 = 0 then 'Odd' else upper(atom_type) end atom_type, case when n % 7 = 0 then 'sure' else ' HIGH ' end confidence, null::int page_start, null::int page_end from atoms a join bt on bt.id = a.id)"""
_NORM = _SALL + _PROP + f""", bsrc as (select paper_id, src, arg_max(id, block_order) id from (select paper_id, id, block_order, unnest(source_block_ids) src from bt) group by 1, 2),
 pr as (select prop.*, coalesce(prop.reading_block_id, bsrc.id) bid from prop left join bsrc on bsrc.paper_id = prop.paper_id and bsrc.src = prop.source_ids[1]),
 pb as (select pr.* exclude (page_start, page_end), bt.t, bt.source_block_ids own, bt.page_start, bt.page_end, {_SQZ.format('pr.quote')} q from pr left join bt on bt.id = pr.bid),
 rs as (select paper_id, seq, arg_max(s, (score, -pos)) s, max(score) score from (select pb.paper_id, pb.seq, sa.s, sa.pos, {_OVER('pb.q', 'sa.s')} score from pb join sa on sa.id = pb.bid) group by 1, 2),
 nrm0 as (select pb.*, case when bid is null then q when q = '' then {_ST('t', 280)} when contains(t, q) then q when rs.score >= 0.55 then {_ST('rs.s', 520)} else q end fq, list_filter(pb.source_ids, lambda x: list_contains(own, x)) mine from pb left join rs using (paper_id, seq)),
 nrm as (select paper_id, seq, coalesce(bid, '') reading_block_id, case when bid is null then source_ids when len(mine) > 0 then mine else own end source_ids, page_start, page_end, fq quote, coalesce(nullif({_SQZ.format('minimal_claim')}, ''), fq) claim, case when len(topic_tags) > 0 then ['a b'] else {_TAGS("concat_ws(' ', fq, coalesce(nullif(" + _SQZ.format('minimal_claim') + ", ''), fq))")} end topic_tags,
  case when lower(atom_type) in ({", ".join(f"'{x}'" for x in A.ATOM_TYPES)}) then lower(atom_type) else 'other' end atom_type, case when confidence = ' HIGH ' then 'high' else 'medium' end confidence, bid is not null found from nrm0)"""
_PAT = rf"(?i)(\d+(?:\.\d+)?)\s*(?:{A.CLAIM_UNITS})"
_DRIFT = lambda c, q: f"list_transform(list_filter(range(1, len(regexp_extract_all(coalesce({c}, ''), '{_PAT}', 1)) + 1), lambda i: not contains(regexp_replace(coalesce({q}, ''), '\\s+', '', 'g'), regexp_extract_all(coalesce({c}, ''), '{_PAT}', 1)[i])), lambda i: trim(regexp_extract_all(coalesce({c}, ''), '{_PAT}', 0)[i]))"
_COUNTS = ["atoms", "drift", "unknown_blocks", "bad_sources", "page_mismatches", "quotes_missing", "empty", "bad_enums", "repeated_ids"]


def _check(name: str, src: str) -> str:
    """SQL of the checks of atoms in the relation `src`."""
    sl = lambda c: f"len(list_filter({c}, lambda x: trim(x) <> ''))"
    blank = lambda c: f"({_SQZ.format(f'coalesce({c}, {chr(39) * 2})')} = '')::int"
    return f""", {name}_j as (select a.*, bt.id is not null known, bt.source_block_ids own, bt.page_start ps, bt.page_end pe, bt.t from {src} a left join bt on bt.paper_id = a.paper_id and bt.id = a.reading_block_id),
 {name}_p as (select paper_id, count(*) atoms, sum((len({_DRIFT('minimal_claim', 'quote')}) > 0)::int) drift, sum((not known)::int) unknown_blocks, sum(case when known then len(list_filter(source_ids, lambda x: not coalesce(list_contains(own, x), false))) else 0 end) bad_sources,
  sum((known and not (page_start is not distinct from ps and page_end is not distinct from pe))::int) page_mismatches, sum((known and not ({_SQZ.format('quote')} <> '' and contains(t, {_SQZ.format('quote')})))::int) quotes_missing,
  sum({blank('atom_id')} + {blank('quote')} + {blank('minimal_claim')} + {blank('reading_block_id')} + ({sl('source_ids')} = 0)::int + ({sl('topic_tags')} = 0)::int) empty,
  sum((atom_type is null or atom_type not in ({", ".join(f"'{x}'" for x in A.ATOM_TYPES)}))::int + (confidence is null or confidence not in ('high', 'medium', 'low'))::int) bad_enums from {name}_j group by 1),
 {name}_t as (select paper_id, count(*) repeated_ids from (select paper_id, atom_id from {src} where atom_id <> '' group by 1, 2 having count(*) > 1) group by 1),
 {name} as (select *, case when atoms > 0 and {" + ".join(_COUNTS[1:])} = 0 then 'ok' else 'fail' end status from (select paper_id, {", ".join(f"coalesce({c}, 0)::bigint {c}" for c in _COUNTS)} from (select distinct paper_id from bt) left join {name}_p using (paper_id) left join {name}_t using (paper_id)))"""


def _templates() -> str:
    """SQL of the rule-based syntheses."""
    parts = []
    for k, (kind, takes, opening) in enumerate(A.TEMPLATES):
        for place, (want, most) in enumerate(takes):
            cond = f"n <= {most}" if want == "*" else f"atom_type = '{want}' and of_type <= {most}"
            parts.append(f"select paper_id, {k} k, {place} place, '{kind}' kind, '{opening.replace(chr(39), chr(39) * 2)}' opening, atom_id, minimal_claim, topic_tags, n from aty where {cond}")
    return ", aty as (select *, row_number() over (partition by paper_id, atom_type order by n) of_type from atoms), te as (" + " union all ".join(parts) + f"""),
 tf as (select paper_id, k, kind, opening, atom_id, min((place, n)) w, first(minimal_claim) claim, first(topic_tags) tags from te group by 1, 2, 3, 4, 5),
 tg as (select paper_id, k, kind, opening, list(atom_id order by w) ids, list(claim order by w) cl, flatten(list(tags order by w)) tags from tf group by 1, 2, 3, 4 having count(*) >= 2),
 th as (select *, list_transform(cl[1:3], lambda x: {_ST('x', 120)}) c3, ids[1:4] support from tg), ti as (select *, list_filter(tags, lambda x, i: list_position(tags, x) = i)[1:8] t8 from th),
 lm as (select paper_id, count(*) lim from aty where atom_type = 'limitation' and of_type <= 2 group by 1),
 tj as (select ti.*, opening || ': ' || array_to_string(c3, ' | ') cfull, 'Within this paper''s evidence atoms' || case when len(t8) > 0 then ': ' || array_to_string(t8, ', ') else '.' end sfull, 'The listed atoms connect ' || array_to_string(c3, '; ') || '.' rfull, case when kind = 'limitation_scope' then coalesce(lim, 0) else 0 end limitations, row_number() over (partition by ti.paper_id, support order by k) dup from ti left join lm using (paper_id)),
 syn as (select paper_id, row_number() over (partition by paper_id order by k) nth, kind synthesis_type, {_ST('cfull', 320)} claim, support, {_ST('rfull', 420)} reasoning, {_ST('sfull', 220)} scope, limitations, kind from tj where dup = 1)"""


_SYN = _ATOM + _templates()
_NUM = lambda c: f"list_filter(list_transform(regexp_extract_all(' ' || {_SQZ.format(c)}, '(?:^|[^A-Za-z0-9.]|[^A-Za-z0-9]\\.|[0-9]\\.)\\d+(?:\\.\\d+)?'), lambda x: regexp_extract(x, '(\\d+(?:\\.\\d+)?)$', 1)), lambda x: x <> '0')"
_SCOPED = """, scp as (select * replace (scope || ' in ' || (1980 + nth * 7) || ' at 2 and 142 and 10' as scope, case when nth % 3 = 0 then support[1:1] when nth % 2 = 0 then list_append(support, 'none') else support end as support) from syn)"""
_TH = """, thm as (select paper_id, atom_type theme_id, atom_type || ' of the core' as label, (list(atom_id order by n))[1:3] expected from atoms where n <= 12 group by 1, 2)"""


def _coverage(op: str) -> str:
    blob = f"lower({_SQZ.format(chr(99) + 'oncat_ws(' + chr(39) + ' ' + chr(39) + ', claim, reasoning, scope, lims)')})"
    return _SYN + _TH + f""", lmt as (select paper_id, string_agg({_ST('minimal_claim', 140)}, ' ' order by n) lims from aty where atom_type = 'limitation' and of_type <= 2 group by 1),
 sb as (select syn.*, case when kind = 'limitation_scope' then coalesce(lims, '') else '' end lims from syn left join lmt using (paper_id)), sb2 as (select *, {blob} bl from sb),
 m as (select thm.paper_id, theme_id, nth, coalesce(len(list_intersect(expected, support)), 0) overlap, case when bl is null then 0 else (contains(bl, 'measured') or contains(bl, 'paper links'))::int + contains(bl, 'purpose, setup')::int end hits from thm left join sb2 using (paper_id)),
 mc as (select *, overlap >= 2 {op} hits >= 1 covered from m),
 fo as (select paper_id, theme_id, list_reduce(list_prepend({{'nth': 0::bigint, 'covered': false, 'overlap': 0::bigint, 'hits': 0::bigint}}, list({{'nth': nth::bigint, 'covered': covered, 'overlap': overlap::bigint, 'hits': hits::bigint}} order by nth)), lambda a, x: case when x.nth is not null and ((x.covered and not a.covered) or x.overlap > a.overlap or (x.overlap = a.overlap and x.hits > a.hits)) then x else a end) w from mc group by 1, 2)
 select paper_id, theme_id, w.covered covered, w.nth best, w.overlap overlap, w.hits hits from fo"""


def _first_with(name: str, conds: list[tuple[str, str]]) -> str:
    """SQL of the first blocks for a row of wants, none used twice. Source: relation fb (paper_id, id, block_order, t, section_kind)."""
    flags = "list_filter([" + ", ".join(f"case when coalesce({c}, false) then {k} end" for k, (_, c) in enumerate(conds)) + "], lambda x: x is not null)"
    names = _LIST([n for n, _ in conds])
    return f""", fl as (select paper_id, id, block_order, {flags} f from fb), fg as (select paper_id, list({{'id': id, 'f': f}} order by block_order, id) c from fl where len(f) > 0 group by 1),
 fw(paper_id, k, used, id) as (select paper_id, -1, []::varchar[], null::varchar from fg union all select paper_id, k, case when nid is null then used else list_append(used, nid) end, nid from (select fg.paper_id, fw.k + 1 k, fw.used, list_filter(fg.c, lambda x: list_contains(x.f, fw.k + 1) and not list_contains(fw.used, x.id))[1].id nid from fw join fg using (paper_id) where fw.k + 1 < {len(conds)})),
 {name} as (select paper_id, {names}[k + 1] want, id from fw where id is not null)"""


_FB = _BT + ", fb as (select * from bt where coalesce(include_in_reading, true) and reading_type in ('paragraph', 'list_item') and t <> '')"
_DESIGN = _FB + _first_with("design", [(n, _like("t", ws)) for n, ws in C.DESIGN])
_CARD = _FB + _first_with("card", [(n, _IN("section_kind", kinds) + (f" and {_like('t', ws)}" if ws else "")) for n, kinds, ws in C.RULES]) + f", cf as (select card.paper_id, want field, card.id, {_ST('t', 260)} quote from card join bt on bt.id = card.id)"
_PAP = "pap as (select * exclude rn from (select *, row_number() over (partition by paper_id order by loaded_at desc) rn from papers where paper_id is not null) where rn = 1)"
_CLEAN = lambda c: f"list_filter(list_transform(coalesce({c}, []), lambda x: {_SQZ.format('x')}), lambda x: x <> '')"
_NKT = "trim(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', ' ', 'g'))"
_BAN = lambda c: f"({_NKT.format(c)} in ({', '.join(repr(b) for b in C.BANNERS)}) or contains({_NKT.format(c)}, 'journal homepage') or contains({_NKT.format(c)}, 'elsevier com locate'))"
_SLIM = "with " + _PAP + rf""", cit as (select * from (select *, row_number() over (partition by citation_id order by harvested_at desc) rn from citations) where rn = 1 and doi <> ''), mt as (select lower(trim(doi)) as key, max_by(title, citation_id) mti, max_by(year, citation_id) my, max_by(journal, citation_id) mj, arg_max(struct_pack(t := title, y := year, j := journal), citation_id) m from cit group by 1),
 x as (select pap.*, {_SQZ.format("coalesce(m.t, '')")} mtt, {_SQZ.format("coalesce(m.y, '')")} myy, {_SQZ.format("coalesce(m.j, '')")} mjj from pap left join mt on mt.key = lower(regexp_extract(coalesce(doi, ''), '(10\..*)$', 1))),
 sl as (select paper_id, case when mtt <> '' and ({_SQZ.format("coalesce(title, '')")} = '' or {_BAN('title')}) then mtt else coalesce(title, '') end title, coalesce(nullif(myy, ''), year, '') as year, coalesce(nullif(mjj, ''), journal, '') journal, coalesce(paper_type, 'unknown') paper_type, coalesce(objective, '') objective, {_CLEAN('domain_tags')} dt, {_CLEAN('main_findings')} mf from x),
 slim as (select paper_id, title, year, journal, paper_type, len(dt) n_tags, len(mf) n_findings, array_to_string(list_filter([case when len(dt) = 0 then 'classification_empty' end, case when {_SQZ.format('objective')} = '' then 'summary_objective_empty' end, case when len(mf) = 0 then 'summary_main_findings_empty' end, case when {_SQZ.format('title')} = '' then 'title_empty' end], lambda x: x is not null), '|') warnings from sl)
 select *, case when warnings = '' then 'ok' else 'needs_fix' end status from slim"""
_JOINED = lambda c: f"array_to_string(coalesce({c}, []), ', ')"
_CT = lambda c: f"list_distinct(list_filter(list_transform(regexp_extract_all(coalesce({c}, ''), '[A-Za-z][A-Za-z0-9/+-]{{2,}}'), lambda x: lower(x)), lambda x: x not in ({', '.join(repr(w) for w in A.STOPWORDS)})))"
_FRAG = lambda c: f"list_filter(list_transform(string_split(replace(coalesce({c}, ''), '…', '...'), '...'), lambda f: regexp_replace(lower(f), '[^\\p{{L}}]', '', 'g')), lambda f: length(f) >= 12)"
_FULL = """, full_ as (select a.paper_id, a.n, a.id reading_block_id, a.quote, a.minimal_claim, a.atom_type, a.topic_tags, a.atom_id, 'medium' confidence, bt.source_block_ids source_ids, bt.page_start, bt.page_end from atoms a join bt on bt.id = a.id)"""
SQL = {
    "ev1_relevant": _BT + f""", k as (select *, {_SQZ.format("concat_ws(' ', text, caption)")} tt from bt where coalesce(include_in_reading, true) and not {_IN('reading_type', E.SKIPPED_TYPES)}), s as (select *, 100 * {_IN('section_kind', E.FRONT_SECTIONS)}::int + 80 * {_IN('section_kind', E.CORE_SECTIONS)}::int + 40 * {_IN('reading_type', ['section_heading', 'keywords'])}::int
  + 35 * {_IN('reading_type', ['table', 'figure'])}::int + 30 * {_like('tt', E.RELEVANT_WORDS)}::int + 10 * regexp_matches(tt, '[0-9]')::int score from k where tt <> ''), r as (select *, row_number() over (partition by paper_id order by score desc, block_order, id) rank from s where score > 0)
 select paper_id, id, score, rank, row_number() over (partition by paper_id order by block_order, id) place from r where rank <= 140""",
    "ev2_relevant": _REL + " select paper_id, id, score, rank from rel where rank <= 150",
    "ev6_topics": _BT + f" select id, array_to_string({_TAGS('coalesce(text, ' + chr(39) * 2 + ')')}, '|') tags from bt",
    "ev7_atoms": _ATOM + " select paper_id, n, id as block, quote, atom_type, array_to_string(topic_tags, '|') tags, score from atoms",
    "ev8_overlap": _BT + _OC + _SALL + f""", sc as (select occ_id, arg_max(s, (score, -pos)) s, max(score) score from (select occ_id, s, pos, {_OVER('q', 's')} score from oc join sa using (id)) group by 1)
 select occ_id, q <> '' and contains(t, q) in_block, round({_OVER('q', 't')}, 6) overlap, sha256(case when q <> '' and contains(t, q) then q when sc.score >= 0.55 then {_ST('sc.s', 520)} else q end) repaired from oc left join sc using (occ_id)""",
    "ev9_normalised": _ATOM + _NORM + " select paper_id, seq, reading_block_id, array_to_string(source_ids, ',') sources, page_start, page_end, sha256(quote) quote, array_to_string(topic_tags, '|') tags, atom_type, confidence, found from nrm",
    "ev10_drift": _BT + _OC + f", d as (select occ_id, {_DRIFT('raw', 't')} d from oc) select occ_id, array_to_string(d, '|') drift from d where len(d) > 0",
    "ev11_check": _ATOM + _PROP + ", p2 as (select * replace (minimal_claim || case when seq % 8 = 0 then ' at 98765 MPa' else '' end as minimal_claim), paper_id || '-' || (seq % 12) atom_id from prop)" + _check("chk", "p2") + " select * from chk",
    "ev12_syntheses": _SYN + " select paper_id, nth, synthesis_type, claim, array_to_string(support, ',') support, scope, limitations from syn",
    "ev13_check": _SYN + _SCOPED + f""", ax as (select paper_id, atom_id, {_NUM("concat_ws(' ', quote, minimal_claim)")} nums from atoms), se as (select scp.paper_id, nth, count(*) sn, sum((ax.atom_id is null)::int) unk, flatten(list(coalesce(nums, []))) nums from (select paper_id, nth, unnest(support) atom_id from scp) scp left join ax using (paper_id, atom_id) group by 1, 2),
 j as (select scp.*, sn, unk, nums from scp left join se using (paper_id, nth)), p as (select paper_id, count(*) syntheses, sum(coalesce(unk, 0))::bigint unknown_atoms, sum((coalesce(sn, 0) < 2)::int)::bigint weak, sum(len(list_filter({_NUM('scope')}, lambda x: not coalesce(list_contains(nums, x), false))))::bigint scope_numbers, sum((claim = '')::int + (reasoning = '')::int + (scope = '')::int)::bigint empty, 0::bigint bad_types from j group by 1)
 select *, case when unknown_atoms + weak + scope_numbers + empty + bad_types = 0 then 'ok' else 'fail' end status from p""",
    "ev14_scope": _SYN + _SCOPED + f""", ax as (select paper_id, list({{'id': atom_id, 'nums': {_NUM("concat_ws(' ', quote, minimal_claim, array_to_string(topic_tags, ' '))")}}} order by atom_id) held from atoms group by 1),
 j as (select scp.paper_id, nth, support, coalesce(held, []) held, list_filter({_NUM('scope')}, lambda x: not list_contains(flatten(list_transform(list_filter(coalesce(held, []), lambda h: list_contains(support, h.id)), lambda h: h.nums)), x)) lack from scp left join ax using (paper_id)),
 gr(paper_id, nth, k, sup) as (select paper_id, nth, 0, support from j union all select j.paper_id, j.nth, k + 1, case when len(list_filter(held, lambda h: list_contains(h.nums, lack[k + 1]) and not list_contains(sup, h.id))) > 0 then list_append(sup, list_filter(held, lambda h: list_contains(h.nums, lack[k + 1]) and not list_contains(sup, h.id))[1].id) else sup end from gr join j using (paper_id, nth) where k < len(lack))
 select paper_id, nth, array_to_string(case when len(lack) = 0 then sup else list_sort(list_distinct(sup)) end, ',') support from gr join j using (paper_id, nth) where k = len(lack)""",
    "ev15_themes": _coverage("and"),
    "ev16_themes": _coverage("or"),
    "ev16_stability": _SYN + f""", sg as (select paper_id, nth, synthesis_type || '|' || array_to_string(list_sort(support), '+') || '|' || array_to_string(string_split({_SQZ.format("regexp_replace(regexp_replace(regexp_replace(lower(claim), " + chr(39) + "\\b\\d{4}\\b" + chr(39) + ", '', 'g'), '\\b(s\\d+)-syn-\\d+\\b', '', 'g'), '\\b(s\\d+)-evatom-\\d+\\b', '', 'g')")}, ' ')[1:18], ' ') s from syn),
 rr as (select paper_id, round, list(distinct s) filter (round = 1 or nth <> 2) now from sg, unnest([1, 2, 3]) u(round) group by 1, 2), r2 as (select paper_id, round, coalesce(now, []) now, lag(coalesce(now, [])) over (partition by paper_id order by round) bf from rr)
 select paper_id, round, len(now) signatures, case when bf is not null then case when len(list_distinct(list_concat(now, bf))) = 0 then 1.0 else round(len(list_intersect(now, bf)) / len(list_distinct(list_concat(now, bf))), 4) end end jaccard from r2""",
    "ev17_canonical": _ATOM + _TH + f""", lw as (select *, lower(theme_id || ' ' || label) w from thm) select paper_id, theme_id, case when {_like('w', ['limitation', 'scope', 'future', 'boundary', 'validation'])} then 'limitation_scope' when {_like('w', ['mechanism', 'exothermic', 'collision', 'transport', 'permeability'])} then 'mechanism_result_link'
  when {_like('w', ['variable', 'pressure', 'temperature', 'ranking', 'order', 'effect', 'co2', 'ch4'])} then 'variable_effect' when {_like('w', ['model', 'method', 'simulation', 'gcmc', 'review'])} then 'method_result_link' else 'evidence_summary' end synthesis_type, label claim, array_to_string(list_sort(expected), ',') support from lw where len(expected) >= 2""",
    "ev18_best_block": _BT + ", " + _PAP + f""", qt as (select paper_id, {_CT('objective')} q from pap), bk as (select paper_id, id, block_order, {_CT('bt')} w from bt where coalesce(include_in_reading, true) and not coalesce(reading_type in ('page_header', 'noise', 'figure', 'table', 'formula'), false)),
 s as (select qt.paper_id, id, block_order, len(list_intersect(q, w)) c, len(q) n from qt join bk using (paper_id) where len(q) > 0), r as (select *, row_number() over (partition by paper_id order by c desc, block_order, id) k from s where c > 0) select paper_id query_id, id, round(c / n, 6) recall from r where k = 1 and c / n >= 0.18""",
    "ev19_design": _DESIGN + " select paper_id, want aspect, id from design",
    "ev19_keywords": "with " + _PAP + ", k as (" + " union all ".join(f"select paper_id, {n} k, unnest(range(0, len({c}))) i, 0 j, unnest({c}) kw, 'Classification tag from {c}.' reason from pap" for n, c in enumerate(("research_objects", "methods", "domain_tags"))) + " union all " + " union all ".join(f"select paper_id, 9, i, {j}, '{p}', 'Finding-oriented discovery keyword.' from (select paper_id, unnest(main_findings) f, unnest(range(0, len(main_findings))) i from pap) where contains(lower(f), '{p.lower()}')" for j, p in enumerate(C.PHRASES)) + f"), c as (select paper_id, k, i, j, {_SQZ.format('kw')} keyword, reason from k), d as (select *, row_number() over (partition by paper_id, lower(keyword) order by k, i, j) u from c where keyword <> ''), r as (select *, row_number() over (partition by paper_id order by k, i, j) rank from d where u = 1) select paper_id, rank, keyword, reason from r where rank <= 12",
    "ev19_section": "with " + _PAP + f", x as (select paper_id, {_JOINED('research_objects')} o, {_JOINED('methods')} m, {_JOINED('domain_tags')} d from pap) select paper_id, case when o <> '' then 'gas adsorption in ' || o when m <> '' and d <> '' then m || ' for ' || d when m <> '' then m || ' methods' when d <> '' then d else 'paper-specific evidence synthesis' end section from x",
    "ev20_card_check": _CARD + ", " + _PAP + f""", g as (select cf.paper_id, count(*) fields, 0 unknown_refs, sum((not contains(bt.t, regexp_replace(cf.quote, '\\.\\.\\.$', '')))::int) ungrounded, sum((field = 'methods')::int) de from cf join bt on bt.id = cf.id group by 1),
 o as (select paper_id, coalesce(fields, 0)::bigint fields, coalesce(unknown_refs, 0)::bigint unknown_refs, coalesce(ungrounded, 0)::bigint ungrounded, (coalesce(de, 0) = 0)::int no_design, (greatest(coalesce(len(domain_tags), 0), coalesce(len(methods), 0), coalesce(len(research_objects), 0)) = 0)::int no_tags, ({_SQZ.format("coalesce(title, '')")} = '' or {_BAN('title')})::int bad_title from pap left join g using (paper_id))
 select *, case when fields > 0 and unknown_refs + ungrounded + no_design + no_tags + bad_title = 0 then 'ok' else 'needs_fix' end status from o""",
    "ev21_card": _CARD + " select paper_id, field, id, sha256(quote) quote from cf",
    "ev22_slim": _SLIM,
    "ev23_grounding": _BT + f""", o as (select * from (select *, row_number() over (partition by occ_id order by loaded_at desc) rn from occurrences where occ_id is not null) where rn = 1), w as (select paper_id, string_agg(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]', '', 'g'), '' order by block_order, id) whole from bt group by 1),
 q as (select paper_id, case when occ_id % 10 = 0 then paper_id || '-RB-0001' else reading_block_id end id, {_FRAG('quote')} f from o), j as (select q.paper_id, f, whole, coalesce(regexp_replace(lower(coalesce(bt.text, '')), '[^\\p{{L}}]', '', 'g'), '') tx from q join w using (paper_id) left join bt on bt.paper_id = q.paper_id and bt.id = q.id where len(f) > 0),
 k as (select paper_id, case when len(list_filter(f, lambda x: not contains(tx, x))) = 0 then 'c' when len(list_filter(f, lambda x: not contains(whole, x))) = 0 then 'e' else 'u' end c from j)
 select paper_id card, count(*) quotes, sum((c = 'c')::int)::bigint in_cited, sum((c = 'e')::int)::bigint elsewhere, sum((c = 'u')::int)::bigint ungrounded, round(sum((c = 'c')::int) / count(*), 3) rate from k group by 1""",
    "ev24_even_sample": "with " + _PAP + ", x as (select paper_id, row_number() over (order by paper_id) - 1 as pos, count(*) over () n from pap) select paper_id, pos from x where pos % greatest(1, n // 20) = 0 order by pos limit 20",
    "ev24_verdicts": "with " + _PAP + ", x as (select *, row_number() over (order by paper_id) - 1 as pos, count(*) over () n from pap), s as (select * from x where pos % greatest(1, n // 20) = 0 order by pos limit 20) select case when coalesce(trim(objective), '') = '' then 'off' when coalesce(len(main_findings), 0) < 1 then 'partial' else 'faithful' end verdict, count(*) papers from s group by 1",
    "ev25_verification": _ATOM + f", x as (select *, minimal_claim || case when n % 8 = 0 then ' at 98765 MPa' else '' end mc from atoms) select paper_id, count(*) atoms, sum((n % 4 = 0)::int)::bigint unjudged, sum((len({_DRIFT('mc', 'quote')}) > 0)::int)::bigint drift from x group by 1",
    "ev26_references": _ATOM + _NORM + f" select nrm.paper_id, nrm.seq, nrm.reading_block_id, array_to_string(nrm.source_ids, ',') sources, nrm.page_start, nrm.page_end, sha256(case when prop.quote = '' and found then {_ST('bt.t', 260)} else prop.quote end) quote from nrm join prop on prop.paper_id = nrm.paper_id and prop.seq = nrm.seq left join bt on bt.id = nrm.reading_block_id",
    "ev27_numbered": _ATOM + _NORM + ", u as (select *, row_number() over (partition by paper_id, reading_block_id, lower(quote) order by seq) r from nrm) select paper_id, seq, paper_id || '-EVATOM-' || lpad((row_number() over (partition by paper_id order by seq))::varchar, 4, '0') atom_id from u where r = 1",
    "ev28_quotes": _BT + _OC + _SALL + f""", tm as (select occ_id, id, t, list_filter(regexp_split_to_array(lower(surface), '[^a-z0-9_]+'), lambda x: length(x) > 3) w from oc where surface is not null), h as (select occ_id, arg_min(s, pos) s from tm join sa using (id) where len(list_filter(w, lambda x: contains(lower(s), x))) > 0 group by 1)
 select occ_id, sha256({_ST('coalesce(h.s, t)', 280)}) quote from tm left join h using (occ_id)""",
    "ev29_first_blocks": _BT + " select paper_id, section_kind, arg_min(id, (block_order, id)) id from bt where coalesce(include_in_reading, true) and section_kind in ('abstract', 'methods', 'results', 'conclusion') and t <> '' group by 1, 2",
    "ev30_accepted": _ATOM + _PROP + _FULL + ", t1 as (select *, paper_id || '-' || seq atom_id from prop), t2 as (select * replace (case when length(paper_id) % 2 = 0 then '' else minimal_claim end as minimal_claim) from full_ where n <= 12 and n % 5 <> 0)" + _check("c1", "t1") + _check("c2", "t2") + _check("c3", "full_")
    + ", f as (select paper_id, min(attempt) attempt from (select paper_id, 1 attempt from c1 where status = 'ok' union all select paper_id, 2 from c2 where status = 'ok') group by 1) select c3.paper_id, case when attempt is not null then 'model' when c3.status = 'ok' then 'fallback' else 'failed' end source, attempt from c3 left join f using (paper_id)",
}
SQL["ev31_reports"] = "select kind, status, count(*) papers from (" + " union all ".join(f"select '{k}' kind, status from ({SQL[q]}) {k}_" for k, q in (("atoms", "ev11_check"), ("syntheses", "ev13_check"), ("slim", "ev22_slim"), ("card", "ev20_card_check"))) + ") group by 1, 2"
QUERIES = {k: globals()[k] for k in SQL}
