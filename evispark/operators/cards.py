"""Paper cards: derivations, rule-based fields, slim cards, references, checks and acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.keys import short_text, squeeze
from evispark.operators import atoms as A
from evispark.operators import evidence as E

# Aspects of a study design with their words, in order.
DESIGN = [
    ("sample/material", ["sample", "coal seam", "bituminous coal", "collected"]),
    ("experiment/conditions", ["experiment", "isothermal", "adsorption apparatus", "pressure", "temperature"]),
    ("simulation/modeling", ["gcmc", "grand canonical", "molecular dynamics", "density functional", "dft", "md"]),
    ("model construction", ["molecular model", "coal model", "constructed", "optimized"]),
    ("analysis workflow", ["radial distribution", "interaction energy", "electrostatic", "adsorption energy"]),
]
# Phrases of findings that serve as keywords, in order; banner titles.
PHRASES = ["competitive adsorption", "adsorption selectivity", "interaction energy", "functional groups", "secondary adsorption sites", "temperature effect", "CO2 displacement"]
BANNERS = ["contents lists available at sciencedirect", "full length article", "article info", "abstract"]
#: Fields of a card built by rule: section kinds in which it is looked for, words of which one must stand in the block (none: any).
RULES = [
    ("core_question", ["abstract", "introduction"], ["aim", "objective", "this study", "in this work", "to test", "question"]),
    ("methods", ["methods"], []),
    ("key_findings", ["results", "results_discussion", "discussion"], []),
    ("mechanisms", ["results", "discussion", "results_discussion"], A.E.MECHANISMS),
    ("limitations", ["discussion", "conclusion"], ["limitation", "future", "uncertainty", "only", "delays"]),
    ("conclusion", ["conclusion", "abstract"], []),
]


def first_with(blocks: DataFrame, wants: list[tuple[str, Column]]) -> DataFrame:
    """(paper_id, want, id): for each want (name, condition) in turn the first block of a paper that fulfils it and serves no earlier want."""
    flags = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, (_, c) in enumerate(wants)]))
    b = blocks.select("paper_id", "id", "block_order", flags.alias("f")).where("size(f) > 0")
    # Of each want, the first blocks suffice: one per want that may have been taken before.
    w = Window.partitionBy("paper_id", "k").orderBy("block_order", "id")
    near = b.select("paper_id", "id", "block_order", F.explode("f").alias("k")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= len(wants))
    per = near.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("k", "block_order", "id"))).alias("c"))  # at most wants squared
    pick = lambda got, k: F.slice(F.filter("c", lambda x: (x["k"] == k) & ~F.exists(got, lambda g: g["id"] == x["id"])), 1, 1)
    start = F.array().cast("array<struct<k:int,block_order:int,id:string>>")
    got = F.aggregate(F.array(*map(F.lit, range(len(wants)))), start, lambda a, k: F.concat(a, pick(a, k)))
    names = F.array(*[F.lit(n) for n, _ in wants])
    return per.select("paper_id", F.explode(got).alias("g")).select("paper_id", F.element_at(names, F.col("g.k") + 1).alias("want"), "g.id")


def study_design(blocks: DataFrame) -> DataFrame:
    """(paper_id, aspect, id, detail): the block of each aspect of a study's design: the first included paragraph or list item with one of its words that no earlier aspect took."""
    b = blocks.where("coalesce(include, true) and reading_type in ('paragraph', 'list_item')").withColumn("t", squeeze(A.block_text()))
    found = first_with(b, [(name, E.any_of(F.col("t"), words)) for name, words in DESIGN])
    return found.withColumnRenamed("want", "aspect").join(b.select("id", short_text(F.col("t"), 320).alias("detail")), "id").select("paper_id", "aspect", "id", "detail")


def keywords(cards: DataFrame, most: int = 12) -> DataFrame:
    """(paper_id, rank, keyword, reason): distinct keywords of a card by lower case: its tags of objects, methods and domains, then phrases that its findings hold; the first `most`."""
    part = lambda k, c, why: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(k).alias("k"), i.alias("i"), F.lit(0).alias("j"), squeeze(x).alias("keyword"), F.lit(why).alias("reason")))
    tags = [part(k, F.col(c), f"Classification tag from {c}.") for k, c in enumerate(("research_objects", "methods", "domain_tags"))]
    phrases = F.array(*[F.struct(F.lit(n).alias("j"), F.lit(p).alias("p")) for n, p in enumerate(PHRASES)])
    held = lambda x, i: F.transform(F.filter(phrases, lambda p: F.contains(F.lower(x), F.lower(p["p"]))), lambda p: F.struct(F.lit(9).alias("k"), i.alias("i"), p["j"].alias("j"), p["p"].alias("keyword"), F.lit("Finding-oriented discovery keyword.").alias("reason")))
    found = F.flatten(F.transform(F.coalesce("main_findings", F.array().cast("array<string>")), held))
    e = cards.select("paper_id", F.explode(F.concat(*tags, found)).alias("x")).select("paper_id", "x.*").where("keyword <> ''")
    once = e.groupBy("paper_id", F.lower("keyword").alias("low")).agg(F.min(F.struct("k", "i", "j", "keyword", "reason")).alias("m")).select("paper_id", "m.*")
    rank = F.row_number().over(Window.partitionBy("paper_id").orderBy("k", "i", "j"))
    return once.withColumn("rank", rank).where(F.col("rank") <= most).select("paper_id", "rank", "keyword", "reason")


def review_section(objects: Column, methods: Column, domains: Column, gases: Column | None = None) -> Column:
    """The section of a review that a card belongs to, from its tags."""
    text = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")
    g = text(gases) if gases is not None else F.lit("")
    o, m, d = text(objects), text(methods), text(domains)
    ladder = F.when((g != "") | (o != ""), F.concat(F.when(g == "", "gas adsorption").otherwise(g), F.lit(" in "), F.when(o == "", "porous media").otherwise(o)))
    return ladder.when((m != "") & (d != ""), F.concat(m, F.lit(" for "), d)).when(m != "", F.concat(m, F.lit(" methods"))).when(d != "", d).otherwise("paper-specific evidence synthesis")


def first_by_kind(blocks: DataFrame, kinds: list[str]) -> DataFrame:
    """(paper_id, section_kind, id): the first included block with text of each section kind."""
    b = blocks.where("coalesce(include, true)").where(F.col("section_kind").isin(kinds)).where(squeeze(A.block_text()) != "")
    return b.groupBy("paper_id", "section_kind").agg(F.min_by("id", F.struct("block_order", "id")).alias("id"))


def rule_card(blocks: DataFrame) -> DataFrame:
    """(paper_id, field, id, quote): a card built by rule: each field of RULES stands on the first block of its sections with one of its words; fields that no earlier one took."""
    b = blocks.where("coalesce(include, true) and reading_type in ('paragraph', 'list_item')").withColumn("t", squeeze(A.block_text())).where("t <> ''")
    wants = [(n, F.col("section_kind").isin(kinds) & (E.any_of(F.col("t"), words) if words else F.lit(True))) for n, kinds, words in RULES]
    return first_with(b, wants).withColumnRenamed("want", "field").join(b.select("id", short_text(F.col("t"), 260).alias("quote")), "id").select("paper_id", "field", "id", "quote")


def banner(title: Column) -> Column:
    """Whether a title is a banner of the page instead."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "))
    return t.isin(BANNERS) | t.contains("journal homepage") | t.contains("elsevier com locate")


def slim_cards(cards: DataFrame) -> DataFrame:
    """Slim cards with defaults, clean lists and `warnings`, `status`.

    `cards`: paper_id, title, doi, year, journal, paper_type, objective, research_objects, methods, domain_tags, main_findings and meta_title, meta_doi, meta_year, meta_journal. Metadata fill or replace doi, year and journal
    where they have any; the title only if it is blank or a banner. Lists lose blank entries, null ones are empty.
    """
    clean = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: squeeze(x)), lambda x: x.isNotNull() & (x != ""))
    text = lambda c: squeeze(F.coalesce(F.col(c), F.lit("")))
    meta = lambda c: F.coalesce(F.nullif(text(f"meta_{c}"), F.lit("")), F.col(c), F.lit(""))
    title = F.when((text("meta_title") != "") & ((text("title") == "") | banner(F.col("title"))), text("meta_title")).otherwise(F.coalesce("title", F.lit("")))
    c = cards.select("paper_id", title.alias("title"), *[meta(x).alias(x) for x in ("doi", "year", "journal")], F.coalesce("paper_type", F.lit("unknown")).alias("paper_type"), F.coalesce("objective", F.lit("")).alias("objective"), *[clean(F.col(x)).alias(x) for x in ("research_objects", "methods", "domain_tags", "main_findings")])
    warn = F.array_compact(F.array(F.when(F.size("domain_tags") == 0, "classification_empty"), F.when(squeeze(F.col("objective")) == "", "summary_objective_empty"), F.when(F.size("main_findings") == 0, "summary_main_findings_empty"), F.when(squeeze(F.col("title")) == "", "title_empty")))
    return c.withColumn("warnings", warn).withColumn("status", F.when(F.size("warnings") == 0, "ok").otherwise("needs_fix"))


def check_cards(cards: DataFrame, fields: DataFrame, blocks: DataFrame) -> DataFrame:
    """(paper_id, fields, unknown_refs, ungrounded, no_design, no_tags, bad_title, status) of cards (paper_id, title, domain_tags, methods, research_objects) with fields (paper_id, field, id, quote) on blocks."""
    b = blocks.select("id", squeeze(A.block_text()).alias("t"), F.col("paper_id").alias("of"))
    quote = F.regexp_replace(F.col("quote"), r"\.\.\.$", "")
    j = fields.join(b, "id", "left").select("paper_id", F.coalesce(F.col("of") == F.col("paper_id"), F.lit(False)).alias("known"), F.coalesce(F.contains(F.col("t"), quote), F.lit(False)).alias("in"), (F.col("field") == "methods").alias("design"))
    n = lambda c: F.sum(c.cast("int"))
    per = j.groupBy("paper_id").agg(F.count("*").alias("fields"), n(~F.col("known")).alias("unknown_refs"), n(F.col("known") & ~F.col("in")).alias("ungrounded"), n(F.col("design")).alias("designs"))
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    title = squeeze(F.coalesce("title", F.lit("")))
    out = cards.select("paper_id", F.greatest(size("domain_tags"), size("methods"), size("research_objects"), F.lit(0)).alias("tags"), ((title == "") | banner(title)).cast("int").alias("bad_title")).join(per, "paper_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = out.select("paper_id", *[zero(c).alias(c) for c in ("fields", "unknown_refs", "ungrounded")], (zero("designs") == 0).cast("int").alias("no_design"), (F.col("tags") == 0).cast("int").alias("no_tags"), "bad_title")
    faults = F.col("unknown_refs") + F.col("ungrounded") + F.col("no_design") + F.col("no_tags") + F.col("bad_title")
    return out.withColumn("status", F.when((F.col("fields") > 0) & (faults == 0), "ok").otherwise("needs_fix"))


def references(evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """Evidence references settled: (paper_id, seq, reading_block_id, source_ids, page_start, page_end, quote).

    As for atoms the block is found by id, else by the first source; sources are the block's, an own choice is kept where the block has any of it. A quote is left as it is; without one the head of the block stands, 260 characters. What
    fits no block stays as given.
    """
    n = A.normalise_atoms(evidence, blocks)
    raw = evidence.select("paper_id", "seq", F.coalesce("quote", F.lit("")).alias("_q"))
    head = blocks.select(F.col("id").alias("reading_block_id"), short_text(A.block_text(), 260).alias("_head"))
    j = n.drop("quote").join(raw, ["paper_id", "seq"]).join(head, "reading_block_id", "left")
    return j.select("paper_id", "seq", "reading_block_id", "source_ids", "page_start", "page_end", F.when((F.col("_q") == "") & F.col("found"), F.col("_head")).otherwise(F.col("_q")).alias("quote"))


def verification(atoms: DataFrame, judged: DataFrame) -> DataFrame:
    """(paper_id, atoms, unjudged, drift): atoms without a verdict (judged: atom_id) and with drifted numbers."""
    j = atoms.join(judged.select("atom_id").distinct().withColumn("v", F.lit(True)), "atom_id", "left")
    n = lambda c: F.sum(c.cast("int"))
    return j.groupBy("paper_id").agg(F.count("*").alias("atoms"), n(F.col("v").isNull()).alias("unjudged"), n(F.size(A.drifted(F.col("minimal_claim"), F.col("quote"))) > 0).alias("drift"))


def accepted(attempts: DataFrame, fallback: DataFrame) -> DataFrame:
    """(paper_id, source, attempt): `model` with the first valid attempt (paper_id, attempt, status), else `fallback` if the rule-based package is valid, else `failed`."""
    first = attempts.where("status = 'ok'").groupBy("paper_id").agg(F.min("attempt").alias("attempt"))
    every = attempts.select("paper_id").unionAll(fallback.select("paper_id")).distinct()
    j = every.join(first, "paper_id", "left").join(fallback.select("paper_id", F.col("status").alias("fb")), "paper_id", "left")
    return j.select("paper_id", F.when(F.col("attempt").isNotNull(), "model").when(F.col("fb") == "ok", "fallback").otherwise("failed").alias("source"), "attempt")
