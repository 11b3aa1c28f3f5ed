"""Evidence atoms and syntheses: selection, picking, normalisation, drift of numbers, validation, templates, themes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.keys import short_text, squeeze
from evispark.operators import evidence as E
from evispark.operators.quotes import in_block, repaired_quote
from evispark.session import ranked

# Atom types, synthesis types, confidences, what is left out, section weights, words of the block score, topic words in order.
ATOM_TYPES = ["method", "variable", "mechanism", "result", "quantitative_result", "limitation", "scope", "background", "other"]
SYNTHESIS_TYPES = ["method_result_link", "mechanism_result_link", "variable_effect", "limitation_scope", "evidence_summary", "other"]
CONFIDENCES = ["high", "medium", "low"]
SKIPPED_KINDS, SKIPPED_TYPES = ["references", "acknowledgements", "appendix"], ["page_header", "noise", "reference_entry"]
KIND_WEIGHTS = {"abstract": 160, "conclusion": 145, "results_discussion": 135, "results": 130, "discussion": 120, "methods": 105, "keywords": 35, "front_matter": 25, "introduction": 20}
BLOCK_WORDS = ["this study", "this paper", "in this work", "employed", "used", "method", "experiment", "simulation", "model", "pressure", "temperature", "mpa", "adsorption", "diffusion", "tortuosity", "methane", "carbon dioxide", "ch4", "co2", "result", "suggest", "indicate", "increase", "decrease", "higher", "lower", "greater", "conclude", "limitation"]
TOPIC_WORDS = ["kerogen", "shale", "methane", "ch4", "carbon dioxide", "co2", "adsorption", "diffusion", "tortuosity", "pressure", "temperature", "langmuir", "freundlich", "henry", "illite", "montmorillonite", "calcite", "mineral", "pore", "gcmc", "molecular dynamics", "experiment", "simulation"]
# Units that make a number of a claim count, in this order.
CLAIM_UNITS = r"%|wt\.?\s*%|MPa|kPa|GPa|Pa|K\b|°C|nm|Å|µm|um|mm\b|mmol/g|mol/g|mg/g|g/cm3|g/cm³|kg/m3|kJ/mol|kcal/mol|eV|m2/s|m²/s|cm2/s|mD|psia?|bar"
# Words that say nothing about what a text is about.
STOPWORDS = ["the", "and", "for", "with", "that", "this", "from", "into", "using", "under", "were", "are", "was", "has", "have", "study", "paper", "result", "results"]


def block_text(text: str = "text", caption: str = "caption") -> Column:
    return F.coalesce(F.nullif(F.col(text), F.lit("")), F.col(caption), F.lit(""))


def relevant_for_atoms(blocks: DataFrame, limit: int = 150) -> DataFrame:
    """The `limit` best blocks of each paper for atoms with score and rank, earliest first at ties (a top-k report). `blocks`: id, paper_id, block_order, section_kind, reading_type, include, text, caption."""
    t = squeeze(block_text())
    b = blocks.where("coalesce(include, true)").withColumn("t", t).where(F.length("t") >= 25)
    b = b.where(~F.coalesce(F.col("section_kind").isin(SKIPPED_KINDS), F.lit(False)) & ~F.coalesce(F.col("reading_type").isin(SKIPPED_TYPES), F.lit(False)))
    weight = F.lit(10)
    for k, w in KIND_WEIGHTS.items():
        weight = F.when(F.col("section_kind") == k, w).otherwise(weight)
    kind = F.when(F.col("reading_type").isin("paragraph", "list_item"), 25).when(F.col("reading_type").isin("figure", "table", "caption"), 35).when(F.col("reading_type") == "section_heading", -80).otherwise(0)
    score = weight + kind + F.when(F.col("t").rlike("[0-9]"), 15).otherwise(0) + F.when(E.any_of(F.col("t"), BLOCK_WORDS), 45).otherwise(0)
    rank = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("score"), "block_order", "id"))
    return b.withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= limit).drop("t")


def topic_tags(c: Column, limit: int = 8) -> Column:
    """The first `limit` topic words that the text holds; `paper-evidence` if none."""
    low = F.lower(F.coalesce(c, F.lit("")))
    tags = F.slice(F.filter(F.array(*map(F.lit, TOPIC_WORDS)), lambda w: F.contains(low, w)), 1, limit)
    return F.when(F.size(tags) == 0, F.array(F.lit("paper-evidence"))).otherwise(tags)


def pick_atoms(blocks: DataFrame, most: int = 24, per_block: int = 2, least: int = 45) -> DataFrame:
    """Rule-based atoms: paper_id, n, id (block), quote, minimal_claim, atom_type, topic_tags, score.

    Sentences of the 90 best blocks that score `least` or more are taken best first, earliest first at ties: at most `per_block` of a block, `most` of a paper, no quote twice. The cap of a
    block is tested before repeats, and a capped sentence is not remembered, so a copy of it elsewhere may still come in. Each paper is a sorted stream.
    """
    best = relevant_for_atoms(blocks, 90)
    s = best.select("paper_id", "id", "block_order", F.coalesce("section_kind", F.lit("")).alias("kind"), F.posexplode(E.sentences(block_text())).alias("pos", "s"))
    s = s.withColumn("s", short_text(F.col("s"), 520)).withColumn("score", E.sentence_score(F.col("s"), F.col("kind"))).where(F.col("score") >= least)
    s = s.withColumn("quote", F.when(F.length("s") > 520, F.rtrim(F.substring("s", 1, 520))).otherwise(F.col("s")))

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paper, n, seen, held = None, 0, set(), {}
        for pdf in frames:
            out = []
            for p, i, pos, q in zip(pdf["paper_id"], pdf["id"], pdf["pos"], pdf["quote"]):
                if p != paper:
                    paper, n, seen, held = p, 0, set(), {}
                if n < most and held.get(i, 0) < per_block and q.lower() not in seen:
                    n += 1
                    seen.add(q.lower())
                    held[i] = held.get(i, 0) + 1
                    out.append((p, i, pos, n))
            yield pd.DataFrame(out, columns=["paper_id", "id", "pos", "n"])

    order = s.select("paper_id", "score", "block_order", "id", "pos", "quote").repartition("paper_id").sortWithinPartitions("paper_id", F.desc("score"), "block_order", "id", "pos")
    taken = order.mapInPandas(pick, "paper_id string, id string, pos int, n int")
    a = taken.join(s, ["paper_id", "id", "pos"])
    return a.select("paper_id", "n", "id", "quote", short_text(F.col("quote"), 240).alias("minimal_claim"), E.atom_type(F.col("s"), F.col("kind")).alias("atom_type"), topic_tags(F.col("s")).alias("topic_tags"), "score")


def string_list(c: Column, limit: int | None = None) -> Column:
    """Distinct squeezed texts of a list in order, blank ones left out, the first `limit`; null counts as empty."""
    clean = F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: squeeze(x)), lambda x: x.isNotNull() & (x != "")))
    return clean if limit is None else F.slice(clean, 1, limit)


def normalise_atoms(atoms: DataFrame, blocks: DataFrame) -> DataFrame:
    """Proposed atoms with their block resolved, enums settled and defaults filled in: paper_id, seq, reading_block_id, source_ids, page_start, page_end, quote, minimal_claim, topic_tags, atom_type, confidence, found.

    A block is found by its id, else by the first source id (of blocks that share a source the last). Sources are those of the block; an atom's own are kept where the block has them. An empty quote is the block's head, one that
    isn't in the block gives way to the sentence that shares at least 0.55 of its words. Unknown types are `other`, unknown confidences `medium`.
    """
    b = blocks.select("paper_id", F.col("id").alias("_id"), "block_order", F.col("source_ids").alias("_sources"), F.col("page_start").alias("_ps"), F.col("page_end").alias("_pe"), block_text().alias("_text"))
    by_source = b.select("paper_id", F.explode("_sources").alias("_src"), "block_order", "_id").groupBy("paper_id", "_src").agg(F.max_by("_id", "block_order").alias("_by_source"))
    a = atoms.withColumn("_src", F.col("source_ids")[0]).withColumn("_given", F.coalesce("reading_block_id", F.lit("")))
    known = b.select("paper_id", F.col("_id").alias("_given"), F.lit(True).alias("_known"))
    a = a.join(known, ["paper_id", "_given"], "left").join(by_source, ["paper_id", "_src"], "left")
    a = a.withColumn("_id", F.when(F.col("_known"), F.col("_given")).otherwise(F.col("_by_source"))).join(b.drop("block_order"), ["paper_id", "_id"], "left")
    found = F.col("_id").isNotNull()
    mine = F.array_intersect(F.coalesce("source_ids", F.array().cast("array<string>")), "_sources")
    quote = squeeze(F.coalesce("quote", F.lit("")))
    settled = F.when(~found, quote).when(quote == "", short_text(F.col("_text"), 280)).otherwise(repaired_quote(quote, F.col("_text")))
    a = a.withColumn("_q", settled)
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    claim = F.coalesce(F.nullif(squeeze(F.col("minimal_claim")), F.lit("")), F.col("_q"))
    tags = string_list(F.col("topic_tags"), 10)
    return a.select("paper_id", "seq", F.when(found, F.col("_id")).otherwise(F.col("_given")).alias("reading_block_id"), F.when(~found, F.col("source_ids")).when(F.size(mine) > 0, mine).otherwise(F.col("_sources")).alias("source_ids"), F.when(found, F.col("_ps")).otherwise(F.col("page_start")).alias("page_start"), F.when(found, F.col("_pe")).otherwise(F.col("page_end")).alias("page_end"), F.col("_q").alias("quote"), claim.alias("minimal_claim"), F.when(F.size(tags) > 0, tags).otherwise(topic_tags(F.concat_ws(" ", "_q", claim))).alias("topic_tags"), F.when(low("atom_type").isin(ATOM_TYPES), low("atom_type")).otherwise("other").alias("atom_type"), F.when(low("confidence").isin(CONFIDENCES), low("confidence")).otherwise("medium").alias("confidence"), found.alias("found"))


def numbered_atoms(atoms: DataFrame, name: str = "EVATOM") -> DataFrame:
    """Atoms once per block and quote (the first by seq), with ids `paper-EVATOM-0001` in order."""
    first = Window.partitionBy("paper_id", "reading_block_id", F.lower("quote")).orderBy("seq")
    once = atoms.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    n = F.row_number().over(Window.partitionBy("paper_id").orderBy("seq"))
    return once.withColumn("atom_id", F.concat("paper_id", F.lit(f"-{name}-"), F.format_string("%04d", n)))


def drifted(claim: Column, quote: Column) -> Column:
    """Numbers with a unit in a claim whose digits don't stand in the quote without white space."""
    pattern = F.lit(rf"(?iu)(\d+(?:\.\d+)?)\s*(?:{CLAIM_UNITS})")
    digits = F.regexp_replace(F.coalesce(quote, F.lit("")), r"\s+", "")
    c = F.coalesce(claim, F.lit(""))
    both = F.arrays_zip(F.regexp_extract_all(c, pattern, F.lit(0)).alias("whole"), F.regexp_extract_all(c, pattern, F.lit(1)).alias("num"))
    return F.transform(F.filter(both, lambda x: ~F.contains(digits, x["num"])), lambda x: F.trim(x["whole"]))


def check_atoms(atoms: DataFrame, blocks: DataFrame) -> DataFrame:
    """(paper_id, atoms, drift, unknown_blocks, bad_sources, page_mismatches, quotes_missing, empty, bad_enums, repeated_ids, status) of atom packages; a paper without atoms fails too if it is in `blocks`."""
    b = blocks.select("paper_id", F.col("id").alias("reading_block_id"), F.col("source_ids").alias("_s"), F.col("page_start").alias("_ps"), F.col("page_end").alias("_pe"), block_text().alias("_t"), F.lit(True).alias("_b"))
    j = atoms.join(b, ["paper_id", "reading_block_id"], "left")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    blank = lambda c: (squeeze(F.coalesce(c, F.lit(""))) == "").cast("int")
    empty = sum((blank(F.col(c)) for c in ("atom_id", "quote", "minimal_claim", "reading_block_id")), F.lit(0)) + (F.size(string_list(F.col("source_ids"))) == 0).cast("int") + (F.size(string_list(F.col("topic_tags"))) == 0).cast("int")
    bad = (~F.coalesce(F.col("atom_type").isin(ATOM_TYPES), F.lit(False))).cast("int") + (~F.coalesce(F.col("confidence").isin(CONFIDENCES), F.lit(False))).cast("int")
    known = F.col("_b").isNotNull()
    sources = F.when(known, F.size(F.filter(F.coalesce("source_ids", F.array().cast("array<string>")), lambda s: ~F.coalesce(F.array_contains("_s", s), F.lit(False))))).otherwise(0)
    pages = known & ~(F.col("page_start").eqNullSafe(F.col("_ps")) & F.col("page_end").eqNullSafe(F.col("_pe")))
    per = j.groupBy("paper_id").agg(F.count("*").alias("atoms"), n(F.size(drifted(F.col("minimal_claim"), F.col("quote"))) > 0).alias("drift"), n(~known).alias("unknown_blocks"), F.sum(sources).alias("bad_sources"), n(pages).alias("page_mismatches"), n(known & ~in_block(F.col("quote"), F.col("_t"))).alias("quotes_missing"), F.sum(empty).alias("empty"), F.sum(bad).alias("bad_enums"))
    twice = atoms.where("atom_id <> ''").groupBy("paper_id", "atom_id").agg(F.count("*").alias("c")).where("c > 1").groupBy("paper_id").agg(F.count("*").alias("repeated_ids"))
    out = blocks.select("paper_id").where("paper_id is not null").distinct().join(per, "paper_id", "full").join(twice, "paper_id", "left")
    counts = ["atoms", "drift", "unknown_blocks", "bad_sources", "page_mismatches", "quotes_missing", "empty", "bad_enums", "repeated_ids"]
    out = out.select("paper_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    return out.withColumn("status", F.when((F.col("atoms") > 0) & (sum((F.col(c) for c in counts[1:]), F.lit(0)) == 0), "ok").otherwise("fail"))


# Templates of rule-based syntheses in order: type, atoms taken of each atom type (`*`: of all), opening words.
TEMPLATES = [
    ("method_result_link", [("method", 2), ("result", 2), ("quantitative_result", 1)], "The paper links its method or setup to reported findings"),
    ("variable_effect", [("variable", 2), ("quantitative_result", 2), ("result", 1)], "The paper treats conditions or variables as connected to measured outcomes"),
    ("mechanism_result_link", [("mechanism", 2), ("result", 2), ("quantitative_result", 1)], "The paper links a mechanism-oriented statement to a reported outcome"),
    ("limitation_scope", [("scope", 1), ("limitation", 2), ("*", 2)], "The paper's broader claim is bounded by its stated scope or limits"),
    ("evidence_summary", [("*", 4)], "The paper's core evidence combines purpose, setup, and findings"),
]


def template_syntheses(atoms: DataFrame) -> DataFrame:
    """Rule-based syntheses of each paper: paper_id, nth, synthesis_type, claim, support (at most 4 atom ids), reasoning, scope, limitations.

    A template takes the first atoms of each type; it needs two distinct ones. Templates with the same support count once. `atoms`: paper_id, atom_id, atom_type, minimal_claim, topic_tags, seq.
    """
    w = Window.partitionBy("paper_id").orderBy("seq")
    t = Window.partitionBy("paper_id", "atom_type").orderBy("seq")
    a = atoms.withColumn("of_all", F.row_number().over(w)).withColumn("of_type", F.row_number().over(t))
    parts = []
    for k, (kind, takes, opening) in enumerate(TEMPLATES):
        for place, (want, most) in enumerate(takes):
            hit = F.col("of_all") <= most if want == "*" else (F.col("atom_type") == want) & (F.col("of_type") <= most)
            parts.append(F.when(hit, F.struct(F.lit(k).alias("k"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), F.lit(opening).alias("opening"))))
    e = a.where((F.col("of_all") <= 4) | (F.col("of_type") <= 2)).select("*", F.explode(F.array_compact(F.array(*parts))).alias("x")).select("paper_id", "atom_id", "atom_type", "minimal_claim", "topic_tags", "seq", "x.*")
    once = e.groupBy("paper_id", "k", "kind", "opening", "atom_id").agg(F.min(F.struct("place", "seq")).alias("at"), F.first("minimal_claim").alias("claim"), F.first("topic_tags").alias("tags"), F.first("atom_type").alias("atom_type"), F.first("seq").alias("seq"))
    g = once.groupBy("paper_id", "k", "kind", "opening").agg(F.array_sort(F.collect_list(F.struct("at", "atom_id", "claim", "tags"))).alias("s")).where("size(s) >= 2")  # at most five atoms
    first = F.transform(F.slice("s", 1, 3), lambda x: short_text(x["claim"], 120))
    tags = F.slice(string_list(F.flatten(F.transform("s", lambda x: x["tags"]))), 1, 8)
    limits = a.where("atom_type = 'limitation' and of_type <= 2").groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "minimal_claim"))), lambda x: short_text(x["minimal_claim"], 140)).alias("limits"))
    g = g.join(limits, "paper_id", "left")
    none = F.array().cast("array<string>")
    g = g.select("paper_id", "k", F.col("kind").alias("synthesis_type"), short_text(F.concat("opening", F.lit(": "), F.array_join(first, " | ")), 320).alias("claim"), F.slice(F.transform("s", lambda x: x["atom_id"]), 1, 4).alias("support"), short_text(F.concat(F.lit("The listed atoms connect "), F.array_join(first, "; "), F.lit(".")), 420).alias("reasoning"), short_text(F.concat(F.lit("Within this paper's evidence atoms"), F.when(F.size(tags) > 0, F.concat(F.lit(": "), F.array_join(tags, ", "))).otherwise(".")), 220).alias("scope"), F.when(F.col("kind") == "limitation_scope", F.coalesce("limits", none)).otherwise(none).alias("limitations"))
    g = g.withColumn("_r", F.row_number().over(Window.partitionBy("paper_id", "support").orderBy("k"))).where("_r = 1")
    return g.withColumn("nth", F.row_number().over(Window.partitionBy("paper_id").orderBy("k"))).drop("k", "_r")


def numbers_in(c: Column) -> Column:
    """Numbers of a text that no ASCII letter stands right before, `0` left out."""
    return F.filter(F.regexp_extract_all(squeeze(F.coalesce(c, F.lit(""))), F.lit(r"(?<![A-Za-z])(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x != "0")


def check_syntheses(syntheses: DataFrame, atoms: DataFrame) -> DataFrame:
    """(paper_id, syntheses, unknown_atoms, weak, scope_numbers, empty, bad_types, status): syntheses (paper_id, nth, synthesis_type, claim, support, reasoning, scope) against atoms (paper_id, atom_id, quote, minimal_claim)."""
    e = syntheses.select("paper_id", "nth", F.explode("support").alias("atom_id")).join(atoms.select("paper_id", "atom_id", numbers_in(F.concat_ws(" ", "quote", "minimal_claim")).alias("nums"), F.lit(True).alias("known")), ["paper_id", "atom_id"], "left")
    s = e.groupBy("paper_id", "nth").agg(F.count("*").alias("support_n"), F.sum(F.col("known").isNull().cast("int")).alias("unknown"), F.flatten(F.collect_list("nums")).alias("nums"))  # the atoms of one synthesis
    j = syntheses.join(s, ["paper_id", "nth"], "left")
    lacking = F.size(F.filter(numbers_in(F.col("scope")), lambda x: ~F.coalesce(F.array_contains("nums", x), F.lit(False))))
    blank = lambda c: (squeeze(F.coalesce(F.col(c), F.lit(""))) == "").cast("int")
    per = j.groupBy("paper_id").agg(F.count("*").alias("syntheses"), F.sum(F.coalesce("unknown", F.lit(0))).alias("unknown_atoms"), F.sum((F.coalesce("support_n", F.lit(0)) < 2).cast("int")).alias("weak"), F.sum(lacking).alias("scope_numbers"), F.sum(blank("claim") + blank("reasoning") + blank("scope")).alias("empty"), F.sum((~F.coalesce(F.col("synthesis_type").isin(SYNTHESIS_TYPES), F.lit(False))).cast("int")).alias("bad_types"))
    counts = ["unknown_atoms", "weak", "scope_numbers", "empty", "bad_types"]
    return per.withColumn("status", F.when(sum((F.col(c) for c in counts), F.lit(0)) == 0, "ok").otherwise("fail"))


def supported_scope(syntheses: DataFrame, atoms: DataFrame) -> DataFrame:
    """Syntheses with atoms added for the numbers of their scope that no supporting atom holds.

    What lacks is settled beforehand; each lacking number, in order, adds the first atom by id that holds it and isn't in yet, even where one added before holds it. No support stays no support. One paper's atoms are one value.
    """
    have = atoms.withColumn("nums", numbers_in(F.concat_ws(" ", "quote", "minimal_claim", F.array_join("topic_tags", " "))))
    held = have.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("atom_id", "nums"))).alias("held"))  # at most 24 atoms picked by rule, those of one paper else
    j = syntheses.join(held, "paper_id", "left").withColumn("held", F.coalesce("held", F.array().cast("array<struct<atom_id:string,nums:array<string>>>")))
    mine = F.flatten(F.transform(F.filter("held", lambda h: F.array_contains("support", h["atom_id"])), lambda h: h["nums"]))
    lacking = F.filter(numbers_in(F.col("scope")), lambda x: ~F.array_contains(mine, x))
    add = lambda got, x: F.filter("held", lambda h: F.array_contains(h["nums"], x) & ~F.array_contains(got, h["atom_id"]))
    grown = F.aggregate(lacking, F.col("support"), lambda got, x: F.concat(got, F.transform(F.slice(add(got, x), 1, 1), lambda h: h["atom_id"])))
    full = F.when((F.size("support") == 0) | (F.size(lacking) == 0), F.col("support")).otherwise(F.array_sort(F.array_distinct(grown)))
    return j.withColumn("support", full).drop("held")


def blob(*cols: str) -> Column:
    return F.lower(squeeze(F.concat_ws(" ", *cols)))


def theme_coverage(themes: DataFrame, syntheses: DataFrame, both: bool = True) -> DataFrame:
    """(paper_id, theme_id, covered, best, overlap, hits): for each theme (expected, term_groups, least_overlap, least_hits) the best synthesis of its paper (nth, claim, reasoning, scope, limitations, support).

    Covered if support and terms suffice (`both`), or either of them. The syntheses are looked at in order: one that covers where none did, has more overlap, or as much overlap and more hits takes the lead; `best` is 0 if none ever did.
    """
    s = syntheses.withColumn("blob", F.lower(squeeze(F.concat_ws(" ", "claim", "reasoning", "scope", F.array_join("limitations", " ")))))
    j = themes.join(s.select("paper_id", "nth", "support", "blob"), "paper_id", "left")
    overlap = F.coalesce(F.size(F.array_intersect(F.array_distinct("expected"), "support")), F.lit(0))
    hits = F.coalesce(F.size(F.filter("term_groups", lambda g: F.exists(g, lambda t: F.contains(F.col("blob"), F.lower(squeeze(t)))))), F.lit(0))
    j = j.withColumn("overlap", F.greatest(overlap, F.lit(0))).withColumn("hits", F.greatest(hits, F.lit(0)))
    a, b = F.col("overlap") >= F.col("least_overlap"), F.col("hits") >= F.col("least_hits")
    j = j.withColumn("covered", (a & b) if both else (a | b))
    per = j.groupBy("paper_id", "theme_id").agg(F.array_sort(F.collect_list(F.struct("nth", "covered", "overlap", "hits"))).alias("s"))  # at most five syntheses by rule
    start = F.struct(F.lit(0).alias("nth"), F.lit(False).alias("covered"), F.lit(0).alias("overlap"), F.lit(0).alias("hits"))
    leads = lambda m, x: (x["covered"] & ~m["covered"]) | (x["overlap"] > m["overlap"]) | ((x["overlap"] == m["overlap"]) & (x["hits"] > m["hits"]))
    won = F.aggregate("s", start, lambda m, x: F.when(x["nth"].isNotNull() & leads(m, x), F.struct(x["nth"].alias("nth"), x["covered"].alias("covered"), x["overlap"].alias("overlap"), x["hits"].alias("hits"))).otherwise(m))
    return per.select("paper_id", "theme_id", won.alias("m")).select("paper_id", "theme_id", "m.covered", F.col("m.nth").alias("best"), "m.overlap", "m.hits")


def theme_type(theme: Column) -> Column:
    """Synthesis type of a theme by its id and label: a ladder of words."""
    has = lambda *ws: E.any_of(theme, list(ws))
    return F.when(has("limitation", "scope", "future", "boundary", "validation"), "limitation_scope").when(has("mechanism", "exothermic", "collision", "transport", "permeability"), "mechanism_result_link").when(has("variable", "pressure", "temperature", "ranking", "order", "effect", "co2", "ch4"), "variable_effect").when(has("model", "method", "simulation", "gcmc", "review"), "method_result_link").otherwise("evidence_summary")


def canonical_syntheses(themes: DataFrame, atoms: DataFrame) -> DataFrame:
    """(paper_id, theme_id, synthesis_type, claim, support): one synthesis per theme that has at least two of its expected atoms."""
    e = themes.select("paper_id", "theme_id", "label", F.explode(F.array_distinct("expected")).alias("atom_id")).join(atoms.select("paper_id", "atom_id"), ["paper_id", "atom_id"])
    g = e.groupBy("paper_id", "theme_id", "label").agg(F.array_sort(F.collect_set("atom_id")).alias("support")).where("size(support) >= 2")
    return g.select("paper_id", "theme_id", theme_type(F.concat_ws(" ", "theme_id", "label")).alias("synthesis_type"), squeeze(F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("theme_id"))).alias("claim"), "support")


def signature(kind: Column, support: Column, claim: Column) -> Column:
    """Type, sorted support and the first 18 words of the claim without years and ids of syntheses and atoms."""
    t = F.lower(squeeze(claim))
    for p in (r"\b\d{4}\b", r"\b(s\d+)-syn-\d+\b", r"\b(s\d+)-evatom-\d+\b"):
        t = F.regexp_replace(t, p, "")
    return F.concat_ws("|", kind, F.array_join(F.array_sort(support), "+"), F.array_join(F.slice(F.split(squeeze(t), " "), 1, 18), " "))


def stability(rounds: DataFrame) -> DataFrame:
    """(paper_id, round, signatures, jaccard): Jaccard similarity of each round's signatures with the round before, four digits; null for the first, 1 where both are empty. `rounds`: paper_id, round, signature (null: none)."""
    s = rounds.groupBy("paper_id", "round").agg(F.collect_set("signature").alias("now"))  # the syntheses of one paper
    j = s.withColumn("before", F.lag("now").over(Window.partitionBy("paper_id").orderBy("round")))
    union = F.size(F.array_union("now", "before"))
    same = F.when(F.col("before").isNotNull(), F.when(union == 0, 1.0).otherwise(F.round(F.size(F.array_intersect("now", "before")) / union, 4)))
    return j.select("paper_id", "round", F.size("now").alias("signatures"), same.alias("jaccard"))


def content_terms(c: Column) -> Column:
    """Distinct lower-case words of three characters or more without stop words."""
    t = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([A-Za-z][A-Za-z0-9/+-]{2,})"), F.lit(1)), lambda x: F.lower(x))
    return F.array_distinct(F.filter(t, lambda x: ~x.isin(STOPWORDS)))


def best_blocks(queries: DataFrame, blocks: DataFrame, least: float = 0.18) -> DataFrame:
    """(query_id, id, recall): the block of the query's paper that holds most of its words, the first at ties, at least `least` of them. `queries`: query_id, paper_id, query."""
    b = blocks.where("coalesce(include, true)").where(~F.coalesce(F.col("reading_type").isin("page_header", "noise", "figure", "table", "formula"), F.lit(False)))
    b = b.select("paper_id", "id", "block_order", F.explode(content_terms(block_text())).alias("t"))
    q = queries.select("query_id", "paper_id", content_terms(F.col("query")).alias("terms")).where("size(terms) > 0")
    hit = q.select("query_id", "paper_id", F.size("terms").alias("n"), F.explode("terms").alias("t")).join(b, ["paper_id", "t"])
    s = hit.groupBy("query_id", "n", "id", "block_order").agg(F.count("*").alias("c"))
    best = s.groupBy("query_id", "n").agg(F.min_by(F.struct("id", "c"), F.struct((-F.col("c")).alias("c"), "block_order", "id")).alias("m"))
    return best.select("query_id", "m.id", (F.col("m.c") / F.col("n")).alias("recall")).where(F.col("recall") >= least)


def focused_quote(text: Column, query: Column, most: int = 280) -> Column:
    """The first sentence that holds a word of the query of more than three characters, else the head of the text, cut at `most`."""
    terms = F.filter(F.split(F.lower(query), r"\W+"), lambda t: F.length(t) > 3)
    hit = F.filter(E.sentences(text), lambda s: F.exists(terms, lambda t: F.contains(F.lower(s), t)))
    return short_text(F.coalesce(F.try_element_at(hit, F.lit(1)), squeeze(text)), most)


def even_sample(ids: DataFrame, key: str, n: int) -> DataFrame:
    """(key, pos): every step-th id in order, `n` in all, step = count // n (a sampling operator)."""
    places = ranked(ids.select(key), "pos", key).withColumn("pos", F.col("pos") - 1)
    step = max(1, places.count() // n)
    return places.where((F.col("pos") % step == 0) & (F.col("pos") < step * n)).select(key, "pos")
