"""Authors and institutions of papers: affiliations on the first page, registry of institutions, authorship by source, countries, the single-paper view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.keys import norm_key
from evispark.operators import registry as R

# Fixed value: words by which a line is an affiliation.
AFFILIATION = r"University|Institute|Laboratory|College|Academy|School of"
# Facets of the single-paper view, and atom types of its older form.
ANALYSES, RESULTS, CONDITIONS = ["analysis", "simulation", "measurement", "characterization", "preparation"], ["finding"], ["condition"]
ANALYSIS_TYPES, RESULT_TYPES = ["method", "variable", "mechanism"], ["result", "quantitative_result"]


def front_page(blocks: DataFrame, scan: int = 12, most: int = 6) -> DataFrame:
    """(paper_id, affiliations): distinct trimmed lines of the first `scan` blocks of a paper that name an institution, in order, `most` at most. `blocks`: paper_id, place, text."""
    w = Window.partitionBy("paper_id").orderBy("place")
    b = blocks.withColumn("r", F.row_number().over(w)).where(F.col("r") <= scan)
    line = b.select("paper_id", "r", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r\n|\r|\n")).alias("k", "line")).select("paper_id", "r", "k", F.trim("line").alias("line")).where(F.col("line").rlike(AFFILIATION))
    first = line.groupBy("paper_id", "line").agg(F.min(F.struct("r", "k")).alias("at"))
    kept = first.withColumn("n", F.row_number().over(Window.partitionBy("paper_id").orderBy("at"))).where(F.col("n") <= most)
    return kept.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("affiliations"))


def resolve(rows: DataFrame, elements: DataFrame, finals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with institution_ids, new entries) of rows (row, names array): each name led to an institution by name or alias, else to a new one.

    Names equal by norm_key are one institution, created under the first spelling to arrive (`row`, place). ids are distinct, in order of the names; blank names count for nothing.
    """
    e = rows.select("row", F.posexplode("names").alias("k", "name")).select("row", "k", F.trim("name").alias("surface")).where("surface <> ''").withColumn("facet", F.lit("institution"))
    found = R.find(e, elements, finals).withColumn("key", norm_key(F.col("surface")))
    first = found.where("element_id is null").groupBy("key").agg(F.min(F.struct("row", "k", "surface")).alias("m"))
    new = R.create_entries(elements.select("element_id"), first.select(F.lit("institution").alias("facet"), F.col("m.surface").alias("display_name"), F.struct("m.row", "m.k").alias("arrival")))
    made = new.select(norm_key(F.col("display_name")).alias("key"), F.col("element_id").alias("made"))
    ids = found.join(made, "key", "left").select("row", "k", F.coalesce("element_id", "made").alias("id")).groupBy("row", "id").agg(F.min("k").alias("k"))
    g = ids.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("institution_ids"))  # the institutions of one paper
    return rows.join(g, "row", "left").withColumn("institution_ids", F.coalesce("institution_ids", F.array().cast("array<string>"))), new


def population(papers: DataFrame, fetched: DataFrame, front: DataFrame, existing: DataFrame) -> DataFrame:
    """(paper_id, status): skipped_existing, skipped_no_doi, populated (fetched: doi_key with a record), pdf_fallback (lines on the front page), else failed; the first that holds."""
    key = F.lower(F.trim(F.coalesce("doi", F.lit(""))))
    j = papers.select("paper_id", key.alias("doi_key")).join(existing.select("paper_id").distinct().withColumn("old", F.lit(True)), "paper_id", "left").join(fetched.select("doi_key").distinct().withColumn("got", F.lit(True)), "doi_key", "left").join(front.select("paper_id", F.lit(True).alias("page")), "paper_id", "left")
    status = F.when(F.col("old"), "skipped_existing").when(F.col("doi_key") == "", "skipped_no_doi").when(F.col("got"), "populated").when(F.col("page"), "pdf_fallback").otherwise("failed")
    return j.select("paper_id", status.alias("status"))


def card_authors(cards: DataFrame, existing: DataFrame, institutions: DataFrame) -> DataFrame:
    """(paper_id, position, name, institution_ids) from cards (paper_id, authors: array of name, affiliations) of papers without authorship.

    An affiliation is known by its trimmed lower-case name (institutions: element_id, display_name), else it gets an id of its slug, 60 characters at most.
    """
    c = cards.join(existing.select("paper_id").distinct(), "paper_id", "left_anti").select("paper_id", F.posexplode("authors").alias("at", "a"))
    names = institutions.where("display_name is not null").groupBy(F.lower(F.trim("display_name")).alias("key")).agg(F.min("element_id").alias("known"))
    e = c.select("paper_id", "at", F.posexplode("a.affiliations").alias("k", "aff")).withColumn("key", F.lower(F.trim("aff"))).where("key <> ''").join(names, "key", "left")
    slug = F.left(F.regexp_replace(F.regexp_replace(F.lower("aff"), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(60))
    made = F.concat(F.lit("elem:institution/"), F.when(slug == "", "unknown").otherwise(slug))
    ids = e.groupBy("paper_id", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("known", made).alias("id")))), lambda x: x["id"]).alias("institution_ids"))  # one author's affiliations
    return c.join(ids, ["paper_id", "at"], "left").select("paper_id", (F.col("at") + 1).alias("position"), F.trim("a.name").alias("name"), F.coalesce("institution_ids", F.array().cast("array<string>")).alias("institution_ids"))


def countries(institutions: DataFrame, found: DataFrame, force: bool = False) -> DataFrame:
    """(element_id, country, state) of institutions (element_id, display_name, country, redirect_to) by a lookup (name, country): skipped (has one), matched, no_country, no_hit. Redirected entries are left out."""
    f = found.select(F.col("name").alias("display_name"), F.col("country").alias("found"), F.lit(True).alias("hit")).dropDuplicates(["display_name"])
    j = institutions.where("redirect_to is null").join(f, "display_name", "left")
    has = (F.coalesce("country", F.lit("")) != "") & F.lit(not force)
    state = F.when(has, "skipped").when(F.col("hit").isNull(), "no_hit").when(F.coalesce("found", F.lit("")) == "", "no_country").otherwise("matched")
    return j.select("element_id", F.when(state == "matched", F.upper("found")).otherwise(F.col("country")).alias("country"), state.alias("state"))


def decomposition(rows: DataFrame, atoms: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper_id, source, part, id, kind, claim): the single-paper view.

    `rows`: paper_id, place, role, facet, surface. Used rows of the facets above are numbered `EL-0000` in order, as analysis, result or condition. A paper with neither analysis nor result shows its atoms by type instead (source `legacy`),
    without conditions. Main findings are relations `MF-00` of the first source.
    """
    part = F.when(F.col("facet").isin(ANALYSES), "analysis").when(F.col("facet").isin(RESULTS), "result").when(F.col("facet").isin(CONDITIONS), "condition")
    u = rows.where("role = 'used'").withColumn("part", part).where("part is not null")
    n = F.row_number().over(Window.partitionBy("paper_id").orderBy("place")) - 1  # one paper's rows
    u = u.select("paper_id", F.lit("elements").alias("source"), "part", F.concat(F.lit("EL-"), F.format_string("%04d", n)).alias("id"), F.col("facet").alias("kind"), "surface")
    whole = u.where("part <> 'condition'").select("paper_id").distinct()
    shown = u.join(whole, "paper_id", "left_semi").withColumnRenamed("surface", "claim")
    old = F.when(F.col("atom_type").isin(ANALYSIS_TYPES), "analysis").when(F.col("atom_type").isin(RESULT_TYPES), "result")
    legacy = atoms.withColumn("part", old).where("part is not null").join(whole, "paper_id", "left_anti").select("paper_id", F.lit("legacy").alias("source"), "part", F.col("atom_id").alias("id"), F.col("atom_type").alias("kind"), F.col("minimal_claim").alias("claim"))
    mf = papers.select("paper_id", F.posexplode("main_findings").alias("i", "claim")).join(whole, "paper_id", "left_semi")
    relations = mf.select("paper_id", F.lit("elements").alias("source"), F.lit("relation").alias("part"), F.concat(F.lit("MF-"), F.format_string("%02d", F.col("i"))).alias("id"), F.lit("main_finding").alias("kind"), "claim")
    return shown.unionByName(legacy).unionByName(relations)


def backfill_targets(papers: DataFrame, authorship: DataFrame, blocks: DataFrame) -> DataFrame:
    """(paper_id, reason, text) of papers without authorship (missing) or without any institution in it (no_institution), with the text of their first page: 30 blocks and 6,000 characters at most.

    `authorship`: paper_id, institution_ids; `blocks`: paper_id, place, page (counted from 1 within the paper), text.
    """
    a = authorship.groupBy("paper_id").agg(F.max((F.coalesce(F.size("institution_ids"), F.lit(0)) > 0).cast("int")).alias("has"))
    j = papers.select("paper_id").join(a, "paper_id", "left").where("coalesce(has, 0) = 0")
    b = blocks.where("page = 1 and text <> ''").withColumn("r", F.row_number().over(Window.partitionBy("paper_id").orderBy("place"))).where("r <= 30")
    t = b.groupBy("paper_id").agg(F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), "\n"), F.lit(6000)).alias("text"))  # 30 blocks
    return j.join(t, "paper_id", "left").select("paper_id", F.when(F.col("has").isNull(), "missing").otherwise("no_institution").alias("reason"), F.coalesce("text", F.lit("")).alias("text"))
