"""Queries of the connection layer and of the portfolio, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.keys import norm_key
from evispark.operators import cards as K
from evispark.operators import connect as C
from evispark.operators import graph as G
from evispark.operators import index as I
from evispark.operators import portfolio as P
from evispark.plans import evidence_queries as EQ
from evispark.plans.graph_queries import _C3, TAG_WEIGHTS, W, _tags, c3_candidate_edges
from evispark.plans.index_queries import load
from evispark.session import cut
from evispark.tables import latest, table


def c1_concepts(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical concepts of papers: tags of one norm_key are one concept under their least spelling; tags in upper case are not in the vocabulary; papers whose id ends in 9 are deferred."""
    p = load(spark, sf).papers
    parts = [p.select("paper_id", F.lit(c).alias("facet"), F.explode(c).alias("tag")) for c in TAG_WEIGHTS]
    tags = parts[0].unionAll(parts[1]).unionAll(parts[2])
    v = tags.where(F.col("tag") != F.upper("tag")).select("facet", F.lower(F.trim("tag")).alias("member")).where("member <> ''").distinct().withColumn("k", norm_key(F.col("member")))
    names = v.groupBy("facet", "k").agg(F.min("member").alias("canonical"))
    return C.paper_concepts(tags, v.join(names, ["facet", "k"]), p.where("paper_id like '%9'"))


def c3_shared(spark: SparkSession, sf: str) -> DataFrame:
    """The concepts that each candidate edge shares, by facet."""
    t = cut(_tags(spark, sf))
    e = c3_candidate_edges(spark, sf).select("a", "b")
    a, b = t.withColumnRenamed("paper_id", "a"), t.withColumnRenamed("paper_id", "b")
    return e.join(a, "a").join(b, ["b", "facet", "concept"]).groupBy("a", "b", "facet").agg(F.array_join(F.array_sort(F.collect_set("concept")), "|").alias("concepts"))  # the tags of one paper


def c4_top(spark: SparkSession, sf: str) -> DataFrame:
    """The six papers of most candidate edges."""
    d = G.degrees(c3_candidate_edges(spark, sf), load(spark, sf).papers.select("paper_id")).select("paper_id", "degree")
    return d.orderBy(F.desc("degree"), "paper_id").limit(6)


def _surfaces(spark: SparkSession, sf: str) -> DataFrame:
    """(surface, concept): a vocabulary by rule, as names of the reference list hardly stand in the blocks: two and three words after `the` that three blocks or more have."""
    low = F.lower("text")
    both = F.array_distinct(F.concat(*[F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in ("the ([a-z]+ [a-z]+)", "the ([a-z]+ [a-z]+ [a-z]+)")]))
    s = EQ.blocks(spark, sf).where("text <> ''").select(F.explode(both).alias("surface")).groupBy("surface").agg(F.count("*").alias("n")).where("n > 2")
    return s.select("surface", F.regexp_replace("surface", "s$", "").alias("concept"))


def _papers_of(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(papers of concepts, mentions). Central to a concept are the papers that name it in their abstract or conclusion."""
    hits = cut(C.mentions(EQ.blocks(spark, sf), _surfaces(spark, sf)))
    central = hits.where("section in ('abstract', 'conclusion')").select("concept", "paper_id")
    return cut(C.concept_papers(central, hits)), hits


def c5_mentions(spark: SparkSession, sf: str) -> DataFrame:
    hits = C.mentions(EQ.blocks(spark, sf), _surfaces(spark, sf))
    return hits.select("concept", "paper_id", "id", "section", F.sha2("snippet", 256).alias("snippet"))


def c5_index(spark: SparkSession, sf: str) -> DataFrame:
    return C.concept_index(_papers_of(spark, sf)[0])


def c6_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return C.gaps(C.concept_index(_papers_of(spark, sf)[0]))


def _verdicts(c: DataFrame) -> DataFrame:
    """Verdicts on candidate edges by rule, from the number of characters of both ids and the number of shared concepts; some name unknown relations, some pairs are turned round."""
    k = (F.length("a") + F.length("b") + F.col("shared") + F.expr("try_cast(substring(a, 2) as int)")) % 6
    relation = F.element_at(F.array(*map(F.lit, ["supports", "contradicts", "complements", "shared_context", "odd", "complements"])), k.cast("int") + 1)
    turned = F.col("shared") % 2 == 0
    return c.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"), relation.alias("relation"), F.when(k == 2, F.col("a")).when(k == 5, F.col("b")).alias("base"), F.concat(F.lit("by rule "), k.cast("string")).alias("rationale"))


def _typed(spark: SparkSession, sf: str, among: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    c = cut(c3_candidate_edges(spark, sf, among))
    return C.typed_edges(c, _verdicts(c))


def c7_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _typed(spark, sf)[0]


def c8_focal(spark: SparkSession, sf: str) -> DataFrame:
    f = C.focal_context(c3_candidate_edges(spark, sf), EQ.blocks(spark, sf))
    return f.select("focal", "neighbours", F.sha2("abstract", 256).alias("abstract"), F.sha2("conclusion", 256).alias("conclusion"))


def c9_concept_network(spark: SparkSession, sf: str) -> DataFrame:
    """Typed edges among the papers of each concept, counted by relation."""
    p, _ = _papers_of(spark, sf)
    return C.edges_within(_typed(spark, sf)[0], p).groupBy("concept", "relation").agg(F.count("*").alias("edges"))


def c10_paper_network(spark: SparkSession, sf: str) -> DataFrame:
    """Each paper with its typed edges by relation and its central and passing concepts."""
    p, _ = _papers_of(spark, sf)
    e = _typed(spark, sf)[0].select(F.explode(F.array("a", "b")).alias("paper_id"), "relation")
    rel = e.groupBy("paper_id").agg(*[F.sum((F.col("relation") == r).cast("int")).alias(r) for r in P.WEIGHT])
    c = p.groupBy("paper_id").agg(*[F.sum((F.col("role") == r).cast("int")).alias(r) for r in ("central", "passing")])
    return load(spark, sf).papers.select("paper_id").join(rel, "paper_id", "left").join(c, "paper_id", "left").na.fill(0)


def c11_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Relations of the verdicts, dropped shared context included, and the number of edges kept."""
    e, n = _typed(spark, sf)
    return n.unionAll(e.agg(F.lit("edges").alias("relation"), F.count("*").alias("n")))


def c12_angles(spark: SparkSession, sf: str) -> DataFrame:
    """Angles: gaps of five passing papers or more, concepts joined by complements, and the number of contradictions."""
    p, _ = _papers_of(spark, sf)
    e, i = cut(_typed(spark, sf)[0]), cut(C.concept_index(p))
    gaps = C.gaps(i, 5, 10).select(F.lit("gap").alias("kind"), "rank", "concept", F.col("n_passing").alias("n"))
    synth = C.complements_by_concept(e, p, i).select(F.lit("synthesis").alias("kind"), "rank", "concept", F.col("complements").alias("n"))
    tension = e.where("relation = 'contradicts'").agg(F.lit("tension").alias("kind"), F.lit(1).alias("rank"), F.lit("").alias("concept"), F.count("*").alias("n"))
    return gaps.unionAll(synth).unionAll(tension)


def c13_packets(spark: SparkSession, sf: str) -> DataFrame:
    """The material for each concept's draft: its papers with their first quote."""
    p, _ = _papers_of(spark, sf)
    return p.select("concept", "paper_id", "role", "hits", "id", F.sha2(F.coalesce("snippet", F.lit("")), 256).alias("quote"))


def c14_fidelity(spark: SparkSession, sf: str) -> DataFrame:
    """Drafts by rule (objective with a citation and a year) against the paper's findings as quotes, and a styled text that loses the citation of even ids and adds a number to others."""
    p = EQ.load_papers(spark, sf)
    draft = F.concat_ws(" ", "objective", F.concat(F.lit("["), "paper_id", F.lit("]; S1")), "year")
    styled = F.when(F.length("paper_id") % 2 == 0, F.concat_ws(" ", "objective", F.lit("; S1"), "year")).otherwise(F.concat(draft, F.lit(" 17.5")))
    f = p.select("paper_id", C.fidelity(draft, F.array_join(F.coalesce("main_findings", F.array().cast("array<string>")), " "), styled).alias("f"))
    return f.select("paper_id", F.array_join("f.leaked", "|").alias("leaked"), "f.cites_kept", F.array_join("f.new_numbers", "|").alias("new_numbers"))


def c15_full_text(spark: SparkSession, sf: str) -> DataFrame:
    """Texts for groups of papers by the first two characters of their id, within 20,000 characters a group."""
    b = EQ.blocks(spark, sf)
    g = load(spark, sf).papers.select(F.left("paper_id", F.lit(2)).alias("group"), "paper_id")
    return C.full_texts(b, g, 20_000).select(F.col("group").alias("prefix"), "paper_id", F.sha2("text", 256).alias("text"), "mode")


def c16_quotes(spark: SparkSession, sf: str) -> DataFrame:
    c = EQ._claims(spark, sf)
    q = F.when(F.col("occ_id") % 3 == 0, F.concat(F.left("quote", F.lit(20)), F.lit(" .... "), F.expr("right(quote, 20)"))).when(F.col("occ_id") % 3 == 1, F.upper("quote")).otherwise(F.concat("quote", F.lit(" not")))
    return c.select("occ_id", C.quote_stands(q, F.col("text")).alias("stands"))


def c18_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Verified cases for drafting: papers as cases with the quotes of their occurrences; the paper type is the verdict."""
    o = latest(table(spark, sf, "occurrences"), ["occ_id"], "loaded_at", ["paper_id", "quote", "digits_verified"]).where("occ_id is not null and paper_id is not null")
    q = o.groupBy("paper_id").agg(F.collect_list(F.struct(F.col("paper_id").alias("paper"), "quote", (F.col("digits_verified") == 1).alias("verified"))).alias("quotes"))  # one paper's quotes
    cases, counts = C.verified_cases(load(spark, sf).papers.select(F.col("paper_id").alias("case_id"), F.col("paper_type").alias("verdict"), "paper_id").join(q, "paper_id", "left"), ["review", "hybrid", "experimental"])
    n = cases.groupBy("verdict").agg(F.count("*").alias("kept"), F.sum(F.size("quotes")).alias("quotes"))
    return counts.join(n, "verdict", "left").select("verdict", "n", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("quotes", F.lit(0)).alias("quotes"))


def c19_export(spark: SparkSession, sf: str) -> DataFrame:
    b = EQ.blocks(spark, sf)
    return C.export_cards(EQ.load_papers(spark, sf), K.rule_card(b), _typed(spark, sf)[0])


#: Candidates of the queries: key, status, focus terms, groups of which each must have a term.
CANDIDATES = [
    ("creep", "candidate", ["creep", "ageing", "pressure", "Carbon Dioxide"], [["creep", "swelling", "ageing"], ["sample", "core", "series"]]),
    ("flow", "candidate", ["permeability", "flow", "diffusiv", "moisture"], [["flow", "permeability", "moisture"]]),
    ("matrix", "already_generated_flagship", ["matrix", "alloy", "glass", "ceramic"], []),
    ("none", "candidate", ["zzz"], []),
]
GASES = ["methane", "carbon dioxide", "nitrogen", "layered silica composite", "layered bitumen framework"]


def _candidates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CANDIDATES, "key string, status string, focus_terms array<string>, required_any array<array<string>>")


def _inputs(spark: SparkSession, sf: str) -> DataFrame:
    """(paper_id, atoms, syntheses, figures, year, methods, objects, gases, text, title, class_text) of all papers."""
    o = latest(table(spark, sf, "occurrences"), ["occ_id"], "loaded_at", ["paper_id", "element_id", "facet", "surface", "role"]).where("occ_id is not null and paper_id is not null").select("paper_id", "element_id", F.col("facet").alias("occ_facet"), "surface", I.clean_role(F.col("role")).alias("role"), F.col("occ_id").alias("place"))
    a = o.where("role = 'used' and occ_facet in ('finding', 'analysis')").groupBy("paper_id").agg(F.count("*").alias("atoms"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "surface"))), lambda x: x["surface"]), " ").alias("said"))  # one paper's rows
    g = P.gas_list(o, GASES)
    fig = EQ.blocks(spark, sf).where("reading_type = 'figure'").groupBy("paper_id").agg(F.count("*").alias("figures"))
    p = EQ.load_papers(spark, sf).join(a, "paper_id", "left").join(g, "paper_id", "left").join(fig, "paper_id", "left")
    empty = F.array().cast("array<string>")
    many = lambda c: F.coalesce(c, empty)
    text = lambda c: F.array_join(many(c), " ")
    cls = F.concat_ws(" ", text("research_objects"), text("methods"), text("domain_tags"), text("gases"))
    return p.select("paper_id", F.coalesce("atoms", F.lit(0)).alias("atoms"), F.size(many("main_findings")).alias("syntheses"), F.coalesce("figures", F.lit(0)).alias("figures"), I.year_of(F.col("year")).alias("year"), many("methods").alias("methods"), many("research_objects").alias("objects"), many("gases").alias("gases"), P.norm_text(F.concat_ws(" ", "title", "paper_type", "objective", text("main_findings"), cls, "said")).alias("text"), P.norm_text(F.col("title")).alias("title"), P.norm_text(cls).alias("class_text"), "main_findings")


def _chosen(spark: SparkSession, sf: str, inputs: DataFrame | None = None) -> DataFrame:
    return P.selected(P.scored(inputs if inputs is not None else _inputs(spark, sf), _candidates(spark)), 40)


def pf1_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return _inputs(spark, sf).select("paper_id", "atoms", "syntheses", "figures", F.array_join("gases", "|").alias("gases"))


def pf2_scores(spark: SparkSession, sf: str) -> DataFrame:
    return P.scored(_inputs(spark, sf), _candidates(spark)).select("key", "paper_id", "score", F.array_join("terms", "|").alias("terms"))


def pf3_selection(spark: SparkSession, sf: str) -> DataFrame:
    return _chosen(spark, sf).select("key", "paper_id", "score", "rank")


def pf4_edges(spark: SparkSession, sf: str) -> DataFrame:
    return P.internal_edges(_chosen(spark, sf), _typed(spark, sf)[0])


def pf5_concepts(spark: SparkSession, sf: str) -> DataFrame:
    p, _ = _papers_of(spark, sf)
    return P.concept_support(_chosen(spark, sf), p, C.concept_index(p))


def pf6_claims(spark: SparkSession, sf: str) -> DataFrame:
    i = cut(_inputs(spark, sf))
    o = latest(table(spark, sf, "occurrences"), ["occ_id"], "loaded_at", ["paper_id", "facet", "surface", "role"]).where("occ_id is not null and paper_id is not null")
    atoms = o.where(I.clean_role(F.col("role")) == "used").where("facet in ('finding', 'analysis')").select("paper_id", F.lit("atom").alias("kind"), F.col("occ_id").alias("place"), F.col("surface").alias("claim"))
    finds = i.select("paper_id", F.posexplode("main_findings").alias("place", "claim")).select("paper_id", F.lit("finding").alias("kind"), F.col("place").cast("bigint"), "claim")
    return P.claims(_chosen(spark, sf, i), finds.unionAll(atoms), _candidates(spark))


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    i = cut(_inputs(spark, sf))
    chosen = cut(_chosen(spark, sf, i))
    return P.metrics(chosen, i, P.internal_edges(chosen, _typed(spark, sf, chosen)[0]), i.where("paper_id like '%1' or paper_id like '%2'").select("paper_id"), _candidates(spark))


def pf7_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = _metrics(spark, sf)
    return m.select("key", "papers", "atoms", "syntheses", "figures", "edges", "overlap", "first_year", "last_year", *[F.round(c, 6).alias(c) for c in ("evidence_score", "relation_score", "method_score", "figure_score", "recency_score", "penalty")], "density", "level", "risk", "readiness", "overlap_ratio")


def pf8_recommended(spark: SparkSession, sf: str) -> DataFrame:
    """Ranking of the candidates; all count as supported, since the tables are small beside the thresholds."""
    return P.recommended(_metrics(spark, sf).withColumn("level", F.when(F.col("papers") > 0, "borderline_or_focused_large_review").otherwise(F.col("level"))), 5).select("rank", "key", "priority")


def pf9_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap of the candidates' papers."""
    return P.overlaps(_chosen(spark, sf))


def pf11_method(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of the paper on the method: stages done are those whose table has rows for every second paper or more; no scripts are counted."""
    ix = load(spark, sf)
    i = cut(_inputs(spark, sf))
    e = _typed(spark, sf)[0].agg(F.count("*").alias("edges"))
    t = i.agg(F.count("*").alias("papers"), F.sum("atoms").alias("atoms"), F.sum("syntheses").alias("syntheses")).join(F.broadcast(e)).withColumn("scripts", F.lit(40))  # one row each
    n = ix.papers.count()
    stages = [(s, d.select("paper_id").distinct()) for s, d in (("blocks", EQ.blocks(spark, sf)), ("elements", ix.rows), ("findings", i.where("syntheses > 0")), ("cards", ix.papers.where("has_card = 1")), ("figures", i.where("figures > 0")))]
    rows = None
    for s, d in stages:
        one = d.agg(F.lit(s).alias("stage"), (F.count("*") * 2 >= n).alias("done"))
        rows = one if rows is None else rows.unionAll(one)
    return P.method_metrics(t, rows)


def pf12_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Search text of each paper, as a hash, for the manifest."""
    return _inputs(spark, sf).select("paper_id", F.sha2("text", 256).alias("text"), F.sha2("class_text", 256).alias("class_text"))


_WR = W.replace("with ", "with recursive ", 1)
_NKM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_BT = EQ._BT.replace("with recursive ", "", 1)
_HITS = ", " + _BT + r""", sf0 as (select s, regexp_replace(s, 's$', '') concept from (select unnest(list_distinct(list_concat(regexp_extract_all(lower(text), 'the ([a-z]+ [a-z]+)', 1), regexp_extract_all(lower(text), 'the ([a-z]+ [a-z]+ [a-z]+)', 1)))) s from bt where text <> '') group by 1 having count(*) > 2),
 sf1 as (select s, min(concept) concept from sf0 where contains(s, ' ') or s = concept group by 1), lw as (select *, lower(text) low from bt where text <> '' and not coalesce(section_kind = 'references', false) and not coalesce(reading_type = 'reference_entry', false)),
 oc0 as (select id, s, concept, string_split(low, s) p, low from lw join sf1 on contains(low, s)), oc1 as (select id, s, concept, low, unnest(list_transform(range(1, len(p)), lambda k: list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * length(s)))::bigint at0 from oc0),
 oc2 as (select id, concept, at0 p, at0 + length(s) e from oc1 where not (at0 > 0 and substring(low, at0, 1) between 'a' and 'z') and not (at0 + length(s) < length(low) and substring(low, at0 + length(s) + 1, 1) between 'a' and 'z')),
 oc3 as (select id, list_reduce(list_prepend({'p': 0::bigint, 'e': 0::bigint, 'c': []::struct(c varchar, p bigint)[]}, list({'p': p, 'e': e, 'c': [{'c': concept, 'p': p}]} order by p, -e)), lambda a, x: case when x.p >= a.e then {'p': x.p, 'e': x.e, 'c': list_concat(a.c, x.c)} else a end).c cs from oc2 group by 1),
 oc4 as (select id, c.c concept, min(c.p) p from (select id, unnest(cs) c from oc3) group by 1, 2),
 hits as (select concept, paper_id, id, block_order ord, section_kind section, replace(trim(substring(text, greatest(0, p - 40)::int + 1, (p + 160 - greatest(0, p - 40))::int), ' ' || chr(10) || chr(9) || chr(13)), chr(10), ' ') snippet from oc4 join lw using (id))"""
_OF = _HITS + """, cen as (select distinct concept, paper_id from hits where section in ('abstract', 'conclusion')),
 mh as (select concept, paper_id, count(*) hits, arg_min(struct_pack(i := id, s := snippet), (ord, id)) m from hits group by 1, 2), po as (select coalesce(cen.concept, mh.concept) concept, coalesce(cen.paper_id, mh.paper_id) paper_id, case when cen.concept is not null then 'central' else 'passing' end role, coalesce(hits, 0) hits, m.i id, m.s snippet from cen full join mh on cen.concept = mh.concept and cen.paper_id = mh.paper_id),
 ci as (select concept, concept not in (""" + ", ".join(f"'{g}'" for g in C.GENERIC) + """) and (contains(concept, ' ') or length(concept) >= 8) specific, sum((role = 'central')::int)::bigint n_central, sum((role = 'passing')::int)::bigint n_passing from po group by 1), cx as (select *, round(n_passing / (1 + n_central), 2) gap from ci)"""
_TY = _C3 + """, vk as (select *, (length(a) + length(b) + shared + try_cast(substring(a, 2) as int)) % 6 k from c3), ty0 as (select a, b, score, ['supports', 'contradicts', 'complements', 'shared_context', 'odd', 'complements'][k + 1] relation, k, 'by rule ' || k rationale from vk), ty as (select a, b, relation, case when k = 2 then 'a->b' when k = 5 then 'b->a' end direction, score, rationale from ty0 where relation not in ('odd', 'shared_context'))"""
_NT = lambda c: "regexp_replace(replace(replace(lower(" + "".join("replace(" for _ in P.ALIKE) + f"coalesce({c}, '')" + "".join(f", '{a}', '{b}')" for a, b in P.ALIKE) + "), 'carbon dioxide', 'co2'), 'methane', 'ch4 methane'), '\\s+', ' ', 'g')"
_CAND = ", cand as (select * from (values " + ", ".join(f"('{k}', '{s}', {[*f]}::varchar[], {[*map(list, q)]}::varchar[][])" for k, s, f, q in CANDIDATES) + ") t(key, status, focus, required))"
_IN = ", " + _BT + f""", ob as (select paper_id, count(*) atoms, string_agg(surface, ' ' order by occ_id) said from occ where occ_id is not null and role = 'used' and facet in ('finding', 'analysis') group by 1),
 gs as (select paper_id, list(label order by place) gases from (select paper_id, trim(surface) label, min(occ_id) place from occ where role = 'used' and facet = 'material' and (lower(surface) in ({", ".join(f"'{g}'" for g in GASES)}) or lower(replace(string_split(element_id, '/')[-1], '-', ' ')) in ({", ".join(f"'{g}'" for g in GASES)})) and trim(surface) <> '' group by 1, 2) group by 1),
 fg as (select paper_id, count(*) figures from bt where reading_type = 'figure' group by 1),
 i0 as (select pap.*, coalesce(atoms, 0) atoms, coalesce(len(main_findings), 0) syntheses, coalesce(figures, 0) figures, coalesce(gases, []) gases, said, array_to_string(coalesce(main_findings, []), ' ') mf, array_to_string(coalesce(research_objects, []), ' ') || ' ' || array_to_string(coalesce(methods, []), ' ') || ' ' || array_to_string(coalesce(domain_tags, []), ' ') || ' ' || array_to_string(coalesce(gases, []), ' ') cls from pap left join ob using (paper_id) left join gs using (paper_id) left join fg using (paper_id)),
 inp as (select i0.paper_id, atoms, syntheses, figures, yr.y as year_, coalesce(methods, []) methods, coalesce(research_objects, []) objects, gases, {_NT("concat_ws(' ', title, paper_type, objective, mf, cls, said)")} text, {_NT('title')} title, {_NT('cls')} class_text, main_findings from i0 left join yr using (paper_id))"""
_SCORE = _IN + _CAND + f""", fo as (select *, list_transform(focus, lambda t: {_NT('t')}) norms, list_transform(required, lambda g: list_transform(g, lambda t: {_NT('t')})) req from cand),
 h as (select key, inp.*, list_filter(focus, lambda t, i: contains(text, norms[i])) ft, len(list_filter(norms, lambda t: contains(title, t))) nt, len(list_filter(norms, lambda t: contains(class_text, t))) nc from inp, fo where len(list_filter(req, lambda g: len(list_filter(g, lambda t: contains(text, t))) = 0)) = 0),
 sco as (select key, paper_id, round(len(ft) + 2.0::double * nt + 1.5::double * nc + least(syntheses, 6) * 0.25::double + least(atoms, 20) * 0.05::double, 9) score, list_sort(ft) terms, atoms, syntheses from h where len(ft) > 0),
 sel as (select * from (select *, row_number() over (partition by key order by score desc, atoms desc, paper_id desc) rank from sco) where rank <= 40)"""
_PE = ", pe as (select key, a, b, relation, score, row_number() over (partition by key order by case relation when 'contradicts' then 3 when 'complements' then 2 else 1 end desc, score desc, a, b) rank from (select x.key, ty.* from ty join sel x on x.paper_id = a join sel y on y.paper_id = b and y.key = x.key))"
_MET = _TY + _SCORE + _PE + """, mg as (select key, count(*) papers, sum(inp.atoms) atoms, sum(inp.syntheses) syntheses, sum(figures) figures, sum(coalesce(year_ >= 2024, false)::int) recent, min(year_) first_year, max(year_) last_year, sum((paper_id like '%1' or paper_id like '%2')::int) overlap, len(list_distinct(flatten(list(methods)))) nm, len(list_distinct(flatten(list(objects)))) no_, len(list_distinct(flatten(list(gases)))) ng from sel join inp using (paper_id) group by 1),
 me as (select key, count(*) edges, sum((relation = 'contradicts')::int) ct, sum((relation = 'complements')::int) cp, sum((relation = 'supports')::int) sp from pe group by 1),
 m0 as (select key, status, first_year, last_year, coalesce(papers, 0)::bigint papers, coalesce(atoms, 0)::bigint atoms, coalesce(syntheses, 0)::bigint syntheses, coalesce(figures, 0)::bigint figures, coalesce(recent, 0) recent, coalesce(overlap, 0)::bigint overlap, coalesce(nm, 0) nm, coalesce(no_, 0) no_, coalesce(ng, 0) ng, coalesce(edges, 0)::bigint edges, coalesce(ct, 0) ct, coalesce(cp, 0) cp, coalesce(sp, 0) sp from cand left join mg using (key) left join me using (key)),
 m1 as (select *, case when papers > 0 then overlap / papers else 0.0 end ratio from m0), m2 as (select *, least(35.0::double, papers * 0.45::double + atoms * 0.012::double + syntheses * 0.035::double) evidence_score, least(25.0::double, ct * 2.2::double + cp * 0.45::double + sp * 0.25::double) relation_score, least(12.0::double, nm * 0.8::double + ng * 0.8::double + no_ * 0.25::double) method_score, least(14.0::double, figures * 0.08::double) figure_score, least(8.0::double, recent * 0.25::double) recency_score,
  case when status = 'already_generated_flagship' then 0.0::double else least(24.0::double, ratio * 24) end penalty, case when papers > 1 then round(edges / (papers * (papers - 1) / 2), 4) else 0.0 end density, case when papers >= 45 and atoms >= 350 and syntheses >= 90 and edges >= 40 then 'strong_12000_word_review' when papers >= 28 and atoms >= 180 and syntheses >= 50 then 'borderline_or_focused_large_review' else 'insufficient_for_12000_without_more_evidence' end level_,
  case when status = 'already_generated_flagship' then 'completed_reference_manuscript' when ratio >= 0.65 then 'high_overlap_reframe_or_delay' when ratio >= 0.35 then 'moderate_overlap_requires_distinct_thesis' else 'low_overlap' end risk from m1),
 met as (select *, round(evidence_score + relation_score + method_score + figure_score + recency_score - penalty, 2) priority, case when level_ = 'insufficient_for_12000_without_more_evidence' then 'do_not_generate_full_manuscript_yet' when risk = 'high_overlap_reframe_or_delay' then 'delay_until_distinct_thesis_is_locked' when edges < 60 then 'generate_focused_review_or_expand_edges_first' else 'ready_for_sectioned_manuscript_generation' end readiness from m2)"""
_NUMS = lambda c: f"list_distinct(regexp_extract_all({c}, '\\d+(?:\\.\\d+)?'))"
_CITE = lambda c: f"list_distinct(list_concat(regexp_extract_all({c}, '\\[(S\\d+)', 1), regexp_extract_all({c}, ';\\s*(S\\d+)', 1)))"
_TIGHT = lambda c: f"lower(regexp_replace(coalesce({c}, ''), '\\s+', '', 'g'))"
SQL = {
    "c1_concepts": W + ", t as (" + " union all ".join(f"select paper_id, '{c}' facet, unnest({c}) tag from pap" for c in TAG_WEIGHTS) + f"), v as (select distinct facet, lower(trim(tag)) member from t where tag <> upper(tag) and trim(tag) <> ''), n as (select *, min(member) over (partition by facet, {_NKM.format('member')}) canonical from v) select distinct paper_id, t.facet, canonical concept from t join n on n.facet = t.facet and n.member = lower(trim(tag)) where paper_id not like '%9'",
    "c3_shared": W + _C3 + " select a, b, x.facet, string_agg(distinct x.concept, '|' order by x.concept) concepts from c3 join t x on x.paper_id = a join t y on y.paper_id = b and y.facet = x.facet and y.concept = x.concept group by 1, 2, 3",
    "c4_top": W + _C3 + ", dd as (select unnest([a, b]) paper_id from c3) select pap.paper_id, count(dd.paper_id) degree from pap left join dd using (paper_id) group by 1 order by 2 desc, 1 limit 6",
    "c5_mentions": W + _HITS + " select concept, paper_id, id, section, sha256(snippet) snippet from hits",
    "c5_index": W + _OF + " select * from cx",
    "c6_gaps": W + _OF + " select row_number() over (order by gap desc, concept) rank, concept, n_central, n_passing, gap from cx where specific and n_central >= 1 and n_passing >= 4 order by gap desc, concept limit 20",
    "c7_edges": W + _TY + " select * from ty",
    "c8_focal": W + _C3 + ", " + _BT + """, k as (select paper_id, """ + ", ".join(f"left(trim(coalesce(string_agg(coalesce(text, ''), ' ' order by block_order, id) filter (section_kind in ({ks})), '')), {n}) {a}" for ks, n, a in (("'abstract'", 1200, "a"), ("'conclusion'", 1200, "c"), ("'discussion', 'results_discussion'", 1500, "d"))) + """ from bt group by 1), f as (select a focal, count(distinct b) neighbours from c3 group by 1)
 select focal, neighbours, sha256(case when coalesce(k.a, '') = '' and coalesce(c, '') = '' then coalesce(d, '') else coalesce(k.a, '') end) abstract, sha256(coalesce(c, '')) conclusion from f left join k on k.paper_id = focal""",
    "c9_concept_network": W + _OF + _TY + " select x.concept, relation, count(*) edges from ty join po x on x.paper_id = a join po y on y.paper_id = b and y.concept = x.concept group by 1, 2",
    "c10_paper_network": W + _OF + _TY + ", eu as (select unnest([a, b]) paper_id, relation from ty), er as (select paper_id, sum((relation = 'contradicts')::int) contradicts, sum((relation = 'complements')::int) complements, sum((relation = 'supports')::int) supports from eu group by 1), pr as (select paper_id, sum((role = 'central')::int) central, sum((role = 'passing')::int) passing from po group by 1) select paper_id, coalesce(contradicts, 0)::bigint contradicts, coalesce(complements, 0)::bigint complements, coalesce(supports, 0)::bigint supports, coalesce(central, 0)::bigint central, coalesce(passing, 0)::bigint passing from pap left join er using (paper_id) left join pr using (paper_id)",
    "c11_counts": W + _TY + " select relation, count(*) n from ty0 where relation <> 'odd' group by 1 union all select 'edges', count(*) from ty",
    "c12_angles": W + _OF + _TY + """, g as (select row_number() over (order by gap desc, concept) rank, concept, n_passing n from cx where specific and n_central >= 1 and n_passing >= 5), cc as (select x.concept, count(*) n from ty join po x on x.paper_id = a join po y on y.paper_id = b and y.concept = x.concept where relation = 'complements' group by 1),
 sy as (select row_number() over (order by n desc, concept) rank, concept, n from cc join cx using (concept) where specific and n_central >= 2) select 'gap' kind, rank, concept, n from g where rank <= 10 union all select 'synthesis', rank, concept, n from sy where rank <= 10 union all select 'tension', 1, '', count(*) from ty where relation = 'contradicts'""",
    "c13_packets": W + _OF + " select concept, paper_id, role, hits, id, sha256(coalesce(snippet, '')) quote from po",
    "c14_fidelity": W + f""", x as (select paper_id, concat_ws(' ', objective, '[' || paper_id || ']; S1', year) d, array_to_string(coalesce(main_findings, []), ' ') q, objective, year from pap), y as (select *, case when length(paper_id) % 2 = 0 then concat_ws(' ', objective, '; S1', year) else d || ' 17.5' end s from x),
 z as (select *, {_NUMS("regexp_replace(d, 'S\\d+', '', 'g')")} dn, {_NUMS("regexp_replace(q, 'S\\d+', '', 'g')")} qn, {_NUMS('d')} pd, {_NUMS('s')} ps, {_CITE('d')} cd, {_CITE('s')} cs from y)
 select paper_id, array_to_string(list_sort(list_filter(dn, lambda v: not list_contains(qn, v))), '|') leaked, len(list_filter(cd, lambda v: not list_contains(cs, v))) + len(list_filter(cs, lambda v: not list_contains(cd, v))) = 0 cites_kept, array_to_string(list_sort(list_filter(ps, lambda v: not list_contains(pd, v))), '|') new_numbers from z""",
    "c15_full_text": W + ", " + _BT + """, ln as (select paper_id, block_order, id, coalesce(section_kind, '') k, concat_ws(chr(10), case when trim(coalesce(text, '')) <> '' then '«' || coalesce(section_kind, '') || '» ' || trim(text) end, case when trim(coalesce(caption, '')) <> '' then '«' || coalesce(section_kind, '') || '/caption» ' || trim(caption) end) l from bt where coalesce(section_kind, '') not in ('references', 'acknowledgements', 'front_matter', 'keywords')),
 tx as (select paper_id, string_agg(l, chr(10) order by block_order, id) w, string_agg(l, chr(10) order by block_order, id) filter (k in ('abstract', 'results', 'results_discussion', 'discussion', 'conclusion')) v from ln where l <> '' group by 1), g as (select left(paper_id, 2) prefix, paper_id, w, v, sum(length(coalesce(w, ''))) over (partition by left(paper_id, 2)) n from pap left join tx using (paper_id))
 select prefix, paper_id, sha256(coalesce(case when n > 20000 then v else w end, '')) text, case when n > 20000 then 'valued' else 'full' end mode from g""",
    "c16_quotes": EQ._BT + EQ._OC.replace("o.quote raw, bt.t, bt.id", "o.quote raw, bt.t, bt.bt btx, bt.id") + f""", x as (select occ_id, btx, case occ_id % 3 when 0 then left(raw, 20) || ' .... ' || right(raw, 20) when 1 then upper(raw) else raw || ' not' end q from oc), y as (select *, list_filter(list_transform(regexp_split_to_array(q, '\\.{{3,}}|…'), lambda f: {_TIGHT('f')}), lambda f: length(f) >= 12) fr, {_TIGHT('btx')} src, {_TIGHT('q')} tq from x)
 select occ_id, case when len(fr) > 0 then src <> '' and len(list_filter(fr, lambda f: not contains(src, f))) = 0 else length(tq) >= 12 and contains(src, tq) end stands from y""",
    "c18_cases": W + """, q as (select paper_id, sum((coalesce(digits_verified, 0) = 1)::int) v from occ where occ_id is not null group by 1), x as (select coalesce(paper_type, '?') verdict, coalesce(v, 0) v, paper_type in ('review', 'hybrid', 'experimental') and coalesce(v, 0) > 0 k from pap left join q using (paper_id)) select verdict, count(*) n, sum(coalesce(k, false)::int)::bigint kept, sum(case when k then v else 0 end)::bigint quotes from x group by 1""",
    "c19_export": EQ._CARD + "," + W.removeprefix("with") + _TY + r""", od as (select paper_id, max(case when field = 'core_question' then quote end) q, max(case when field = 'key_findings' then quote end) k from cf group by 1), dg as (select paper_id, count(*) degree, sum((relation = 'contradicts')::int) contradicts from (select unnest([a, b]) paper_id, relation from ty) group by 1)
 select paper_id, case when trim(coalesce(title, '')) = '' then paper_id else title end title, trim(regexp_replace(case when trim(coalesce(objective, '')) <> '' then trim(objective) else coalesce(q, '') end, '\s+', ' ', 'g')) objective, case when len(list_filter(coalesce(main_findings, []), lambda x: trim(x) <> '')) > 0 then len(list_filter(main_findings, lambda x: trim(x) <> '')) else (k is not null)::int end findings, coalesce(degree, 0)::bigint degree, coalesce(contradicts, 0)::bigint contradicts from pap left join od using (paper_id) left join dg using (paper_id)""",
    "pf1_inputs": W + _IN + " select paper_id, atoms, syntheses, figures, array_to_string(gases, '|') gases from inp",
    "pf2_scores": W + _SCORE + " select key, paper_id, score, array_to_string(terms, '|') terms from sco",
    "pf3_selection": W + _SCORE + " select key, paper_id, score, rank from sel",
    "pf4_edges": W + _TY + _SCORE + _PE + " select * from pe",
    "pf5_concepts": W + _OF + _IN.replace(", " + _BT, "", 1) + _SCORE.replace(_IN, "", 1) + """, cs as (select key, concept, count(*) n_overlap, sum((role = 'central')::int)::bigint n_central, sum((role = 'passing')::int)::bigint n_passing from po join sel using (paper_id) group by 1, 2), cr as (select cs.*, row_number() over (partition by key order by n_overlap desc, cs.n_central desc, specific desc, gap desc, concept) rank from cs join (select concept, specific, gap from cx) using (concept)) select key, rank, concept, n_overlap, n_central, n_passing from cr where rank <= 18""",
    "pf6_claims": W + _SCORE + f""", cl as (select paper_id, 'finding' kind, unnest(range(0, len(main_findings))) place, trim(unnest(main_findings)) claim from inp union all select paper_id, 'atom', occ_id, trim(surface) from occ where occ_id is not null and paper_id is not null and role = 'used' and facet in ('finding', 'analysis')),
 cm as (select key, cl.*, rank pr from cl join sel using (paper_id) join fo using (key) where claim <> '' and (len(list_filter(norms, lambda t: contains({_NT('claim')}, t))) > 0 or kind = 'finding')), cu as (select key, paper_id, claim, min((pr, (kind = 'atom')::int, place)) w, arg_min(kind, (pr, (kind = 'atom')::int, place)) source from cm group by 1, 2, 3)
 select key, rank, paper_id, claim, source from (select *, row_number() over (partition by key order by w) rank from cu) where rank <= 24""",
    "pf7_metrics": W + _MET + " select key, papers, atoms, syntheses, figures, edges, overlap, first_year, last_year, round(evidence_score, 6) evidence_score, round(relation_score, 6) relation_score, round(method_score, 6) method_score, round(figure_score, 6) figure_score, round(recency_score, 6) recency_score, round(penalty, 6) penalty, density, level_ as level, risk, readiness, round(ratio, 3) overlap_ratio from met",
    "pf8_recommended": W + _MET + " select row_number() over (order by priority desc, key) rank, key, priority from met where status <> 'already_generated_flagship' and (papers > 0 or level_ <> 'insufficient_for_12000_without_more_evidence') order by priority desc, key limit 5",
    "pf9_overlap": W + _SCORE + ", n as (select key, count(*) n from sel group by 1), bb as (select x.key a, y.key b, count(*) shared from sel x join sel y on x.paper_id = y.paper_id and x.key < y.key group by 1, 2), j as (select bb.*, shared / (p.n + q.n - shared) j from bb join n p on p.key = a join n q on q.key = b) select a, b, shared, round(j, 3) jaccard, case when j >= 0.45 then 'high_pair_overlap' when j >= 0.25 then 'moderate_pair_overlap' else 'low_pair_overlap' end risk from j",
    "pf11_method": W + _TY + _IN + """, c as (select count(*) n from pap), st as (select (select count(distinct paper_id) from bt) * 2 >= n a, (select count(distinct paper_id) from r) * 2 >= n b, (select count(*) from inp where syntheses > 0) * 2 >= n c, (select count(*) from pap where has_card = 1) * 2 >= n d, (select count(*) from inp where figures > 0) * 2 >= n e from c),
 tt as (select count(*) papers, sum(atoms)::bigint atoms, sum(syntheses)::bigint syntheses, (select count(*) from ty) edges, 40 scripts from inp), u as (select tt.*, (a::int + b::int + c::int + d::int + e::int)::bigint stages from tt, st) select *, round(40 + stages * 5 + least(20.0::double, scripts * 0.25::double) + least(15.0::double, atoms / 300), 2) priority, case when stages >= 6 then 'method_paper_supported_by_project_artifacts' else 'needs_more_system_validation' end as level from u""",
    "pf12_texts": W + _IN + " select paper_id, sha256(text) text, sha256(class_text) class_text from inp",
}
QUERIES = {k: globals()[k] for k in SQL}
