"""The connection layer: concepts of papers, the concept index, gaps, typed edges, network queries, angles, packets and fidelity gates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.keys import squeeze

# Relations that are kept, relations with a direction, their order of weight.
RELATIONS, DIRECTED = ["supports", "contradicts", "complements", "shared_context"], ["complements"]
# Concepts too general to be a gap.
GENERIC = ["energy", "experimental", "experiment", "water", "pores", "pore", "flow", "storage", "gases", "gas", "review", "transport", "shale", "methane", "coal", "natural gas", "organic matter", "permeability", "porous media", "micropores", "pore structure", "numerical simulation", "simulation", "diffusion", "adsorption", "desorption", "temperature", "pressure", "density", "molecular", "molecular dynamics", "molecular simulation", "carbon dioxide", "nanopores", "porous materials", "fluid", "fluids", "petroleum engineering", "hydrocarbons", "shale gas", "experimental characterization", "modeling", "characterization"]
# Sections left out of a full text, sections kept when it is over the budget, the budget in characters.
SKIPPED, VALUED, BUDGET = ["references", "acknowledgements", "front_matter", "keywords"], ["abstract", "results", "results_discussion", "discussion", "conclusion"], 160_000
#: Surfaces the index may hold; they come from a controlled vocabulary. More raise an error.
MAX_SURFACES = 500_000


def paper_concepts(tags: DataFrame, vocabulary: DataFrame, deferred: DataFrame) -> DataFrame:
    """(paper_id, facet, concept): canonical concepts of each paper's tags (paper_id, facet, tag) by the vocabulary (facet, member, canonical); unmapped tags and deferred papers are left out."""
    v = vocabulary.groupBy("facet", "member").agg(F.min("canonical").alias("concept"))
    t = tags.select("paper_id", "facet", F.lower(F.trim("tag")).alias("member")).join(deferred.select("paper_id").distinct(), "paper_id", "left_anti")
    return t.join(v, ["facet", "member"]).select("paper_id", "facet", "concept").distinct()


def specific(concept: Column) -> Column:
    """Worth ranking as a gap: not general, and of several words or eight letters."""
    return ~concept.isin(GENERIC) & (F.contains(concept, F.lit(" ")) | (F.length(concept) >= 8))


def _find_all(text: str, root: dict) -> list[tuple[int, str]]:
    """(start, concept) of the surfaces in a lower-case text: leftmost, longest, apart from each other, no letter a-z right before or after."""
    letter = lambda i: 0 <= i < len(text) and "a" <= text[i] <= "z"
    out, i = [], 0
    while i < len(text):
        best = None
        if not letter(i - 1):
            node, k = root, i
            while k < len(text) and (node := node.get(text[k])) is not None:
                k += 1
                if "" in node and not letter(k):
                    best = (k, node[""])
        if best:
            out.append((i, best[1]))
            i = best[0]
        else:
            i += 1
    return out


def mentions(blocks: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(concept, paper_id, id, ord, section, snippet): first mention of each concept in each block; reference lists are left out.

    `surfaces`: surface, concept. Only surfaces of several words or equal to their concept count; compared in lower case. The trie of surfaces is sent to all tasks; its size is checked.
    """
    s = surfaces.select(F.lower("surface").alias("s"), "concept").where("s <> ''").where(F.contains(F.col("s"), F.lit(" ")) | (F.col("s") == F.col("concept"))).groupBy("s").agg(F.min("concept").alias("concept"))
    listed = s.limit(MAX_SURFACES + 1).collect()
    if len(listed) > MAX_SURFACES:
        raise ValueError("more surfaces than MAX_SURFACES")
    sent = blocks.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in listed])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root: dict = {}
        for surface, concept in sent.value:
            node = root
            for ch in surface:
                node = node.setdefault(ch, {})
            node[""] = concept
        for pdf in frames:
            out = []
            for p, i, o, sec, t in zip(pdf["paper_id"], pdf["id"], pdf["block_order"], pdf["section_kind"], pdf["text"]):
                seen: set[str] = set()
                for at, c in _find_all(t.lower(), root):
                    if c not in seen:
                        seen.add(c)
                        out.append((c, p, i, o, sec, t[max(0, at - 40) : at + 160].strip().replace("\n", " ")))
            yield pd.DataFrame(out, columns=["concept", "paper_id", "id", "ord", "section", "snippet"])

    b = blocks.where("text <> ''").where(~F.coalesce(F.col("section_kind") == "references", F.lit(False)) & ~F.coalesce(F.col("reading_type") == "reference_entry", F.lit(False)))
    return b.select("paper_id", "id", "block_order", "section_kind", "text").mapInPandas(read, "concept string, paper_id string, id string, ord int, section string, snippet string")


def concept_papers(central: DataFrame, hits: DataFrame) -> DataFrame:
    """(concept, paper_id, role, hits, id, snippet): papers of each concept: central by their card (concept, paper_id), passing by a mention only; with the number of blocks and the first mention."""
    m = hits.groupBy("concept", "paper_id").agg(F.count("*").alias("hits"), F.min_by(F.struct("id", "snippet"), F.struct("ord", "id")).alias("m"))
    j = central.select("concept", "paper_id").distinct().withColumn("c", F.lit(True)).join(m, ["concept", "paper_id"], "full")
    return j.select("concept", "paper_id", F.when(F.col("c"), "central").otherwise("passing").alias("role"), F.coalesce("hits", F.lit(0)).alias("hits"), "m.id", "m.snippet")


def concept_index(papers_of: DataFrame) -> DataFrame:
    """(concept, specific, n_central, n_passing, gap): gap = passing / (1 + central), two digits."""
    n = lambda r: F.sum((F.col("role") == r).cast("int"))
    g = papers_of.groupBy("concept").agg(n("central").alias("n_central"), n("passing").alias("n_passing"))
    return g.select("concept", specific(F.col("concept")).alias("specific"), "n_central", "n_passing", F.round(F.col("n_passing") / (1 + F.col("n_central")), 2).alias("gap"))


def gaps(index: DataFrame, least: int = 4, most: int = 20) -> DataFrame:
    """(rank, concept, n_central, n_passing, gap): specific concepts studied by at least one paper and mentioned by at least `least` others, greatest gap first (a top-k report)."""
    g = index.where(F.col("specific") & (F.col("n_central") >= 1) & (F.col("n_passing") >= least)).orderBy(F.desc("gap"), "concept").limit(most)
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("gap"), "concept"))).select("rank", "concept", "n_central", "n_passing", "gap")  # `most` rows


def typed_edges(candidates: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, counts): candidate pairs (a < b, score) with a verdict (a, b, relation, base, rationale). Unknown pairs and relations are left out; shared_context is counted but makes no edge; `base` gives the direction of directed relations."""
    v = verdicts.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.trim("relation").alias("relation"), F.trim("base").alias("base"), "rationale").where(F.col("relation").isin(RELATIONS))
    j = candidates.select("a", "b", "score").join(v, ["a", "b"])
    way = F.when(F.col("relation").isin(DIRECTED), F.when(F.col("base") == F.col("a"), "a->b").when(F.col("base") == F.col("b"), "b->a"))
    return j.where("relation <> 'shared_context'").select("a", "b", "relation", way.alias("direction"), "score", "rationale"), j.groupBy("relation").agg(F.count("*").alias("n"))


def focal_context(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(focal, neighbours, abstract, conclusion): candidate edges grouped by the lesser end, with that paper's abstract and conclusion, 1,200 characters each; where both are empty 1,500 of its discussion stand for the abstract."""
    text = lambda kinds, n: F.left(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("section_kind").isin(kinds), F.struct("block_order", "id", F.coalesce("text", F.lit("")).alias("t"))))), lambda x: x["t"]), " ")), F.lit(n))
    t = blocks.groupBy("paper_id").agg(text(["abstract"], 1200).alias("a"), text(["conclusion"], 1200).alias("conclusion"), text(["discussion", "results_discussion"], 1500).alias("d"))  # one paper's text
    g = edges.select(F.least("a", "b").alias("focal"), F.greatest("a", "b").alias("n")).groupBy("focal").agg(F.count_distinct("n").alias("neighbours"))
    j = g.join(t, F.col("focal") == F.col("paper_id"), "left")
    none = F.lit("")
    return j.select("focal", "neighbours", F.when((F.coalesce("a", none) == "") & (F.coalesce("conclusion", none) == ""), F.coalesce("d", none)).otherwise(F.coalesce("a", none)).alias("abstract"), F.coalesce("conclusion", none).alias("conclusion"))


def edges_within(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among the papers of one concept: (concept, a, b, relation, score). `members`: concept, paper_id."""
    a = edges.join(members.select("concept", F.col("paper_id").alias("a")), "a")
    return a.join(members.select("concept", F.col("paper_id").alias("b")), ["concept", "b"]).select("concept", "a", "b", "relation", "score")


def complements_by_concept(edges: DataFrame, members: DataFrame, index: DataFrame, most: int = 10) -> DataFrame:
    """(rank, concept, complements, n_central): specific concepts with two central papers or more by the complementary edges among their papers (a top-k report)."""
    n = edges_within(edges.where("relation = 'complements'"), members).groupBy("concept").agg(F.count("*").alias("complements"))
    j = n.join(index.where("specific and n_central >= 2"), "concept").orderBy(F.desc("complements"), "concept").limit(most)
    return j.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("complements"), "concept"))).select("rank", "concept", "complements", "n_central")  # `most` rows


def numbers_of(c: Column) -> Column:
    """Distinct numbers of a text without those of paper ids."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.coalesce(c, F.lit("")), r"S\d+", ""), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)))


def citations_of(c: Column) -> Column:
    """Distinct paper ids cited as `[S1` or `; S1`."""
    t = F.coalesce(c, F.lit(""))
    return F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit(r"\[(S\d+)"), F.lit(1)), F.regexp_extract_all(t, F.lit(r";\s*(S\d+)"), F.lit(1))))


def fidelity(draft: Column, quotes: Column, styled: Column) -> Column:
    """struct: leaked (numbers of the draft that no quote holds), cites_kept (the styled text cites the same papers), new_numbers (of the styled text)."""
    plain = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)))
    same = (F.size(F.array_except(citations_of(draft), citations_of(styled))) == 0) & (F.size(F.array_except(citations_of(styled), citations_of(draft))) == 0)
    return F.struct(F.array_sort(F.array_except(numbers_of(draft), numbers_of(quotes))).alias("leaked"), same.alias("cites_kept"), F.array_sort(F.array_except(plain(styled), plain(draft))).alias("new_numbers"))


def full_texts(blocks: DataFrame, groups: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(group, paper_id, text, mode): texts of each group's papers (group, paper_id), section by section, `full`, or `valued` (sections of value only) where the group's texts are over the budget together."""
    k = F.coalesce("section_kind", F.lit(""))
    line = lambda mark, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit("«"), k, F.lit(mark), F.trim(c)))
    b = blocks.where(~k.isin(SKIPPED)).select("paper_id", "block_order", "id", k.alias("kind"), F.concat_ws("\n", line("» ", F.col("text")), line("/caption» ", F.col("caption"))).alias("t")).where("t <> ''")
    text = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("block_order", "id", "t")))), lambda x: x["t"]), "\n")
    per = b.groupBy("paper_id").agg(text(F.lit(True)).alias("whole"), text(F.col("kind").isin(VALUED)).alias("valued"))  # one paper's text
    j = groups.join(per, "paper_id", "left")
    size = j.groupBy("group").agg(F.sum(F.length(F.coalesce("whole", F.lit("")))).alias("n"))
    over = F.col("n") > budget
    return j.join(size, "group").select("group", "paper_id", F.coalesce(F.when(over, F.col("valued")).otherwise(F.col("whole")), F.lit("")).alias("text"), F.when(over, "valued").otherwise("full").alias("mode"))


def quote_stands(quote: Column, source: Column) -> Column:
    """Whether a quote stands in a source, white space and case aside: every fragment of 12 characters or more between ellipses; without such a fragment the quote as a whole, if it has 12."""
    tight = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))
    frags = F.filter(F.transform(F.split(F.coalesce(quote, F.lit("")), r"\.{3,}|…"), tight), lambda f: F.length(f) >= 12)
    src = tight(source)
    return F.when(F.size(frags) > 0, (src != "") & F.forall(frags, lambda f: F.contains(src, f))).otherwise((F.length(tight(quote)) >= 12) & F.contains(src, tight(quote)))


def verified_cases(cases: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cases, counts): verdicts counted, and the cases (case_id, verdict, quotes: array of paper, quote, verified) of the verdicts to keep that have a verified quote, with those only."""
    n = cases.groupBy(F.coalesce("verdict", F.lit("?")).alias("verdict")).agg(F.count("*").alias("n"))
    good = F.filter(F.coalesce("quotes", F.array().cast("array<struct<paper:string,quote:string,verified:boolean>>")), lambda q: q["verified"])
    return cases.where(F.col("verdict").isin(keep)).withColumn("quotes", good).where("size(quotes) > 0"), n


def export_cards(cards: DataFrame, fields: DataFrame, edges: DataFrame) -> DataFrame:
    """(paper_id, title, objective, findings, degree, contradicts): nodes of the graph export: title else the id, objective and findings of the slim card, else those of the older card's fields (paper_id, field, quote), and its typed neighbours."""
    old = fields.groupBy("paper_id").agg(F.max(F.when(F.col("field") == "core_question", F.col("quote"))).alias("q"), F.max(F.when(F.col("field") == "key_findings", F.col("quote"))).alias("k"))
    ends = edges.select(F.explode(F.array("a", "b")).alias("paper_id"), "relation").groupBy("paper_id").agg(F.count("*").alias("degree"), F.sum((F.col("relation") == "contradicts").cast("int")).alias("contradicts"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    clean = F.filter(F.transform(F.coalesce("main_findings", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    found = F.when(F.size(clean) > 0, F.size(clean)).otherwise(F.col("k").isNotNull().cast("int"))
    j = cards.join(old, "paper_id", "left").join(ends, "paper_id", "left")
    return j.select("paper_id", F.when(blank(F.col("title")) == "", F.col("paper_id")).otherwise(F.col("title")).alias("title"), squeeze(F.when(blank(F.col("objective")) != "", blank(F.col("objective"))).otherwise(F.coalesce("q", F.lit("")))).alias("objective"), found.alias("findings"), F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("contradicts", F.lit(0)).alias("contradicts"))
