"""From document items to reading blocks: cleaning, headings, tables, metadata, plans of sections and reading, joined paragraphs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.keys import squeeze
from evispark.operators.evidence import continues, dangling, incomplete
from evispark.session import cut

# Labels of text items, labels that are dropped, block types with text, reading types, section kinds.
TEXT_LABELS = ["text", "section_header", "list_item", "caption", "formula", "footnote"]
DROPPED_LABELS = ["page_header", "page_footer"]
TEXT_TYPES = ["text", "heading_candidate", "caption", "formula", "footnote", "list_item"]
READING_TYPES = ["front_matter", "section_heading", "paragraph", "keywords", "list_item", "figure", "table", "formula", "caption", "footnote", "page_header", "noise", "reference_entry", "other"]
SECTION_KINDS = ["front_matter", "abstract", "keywords", "introduction", "methods", "results", "discussion", "results_discussion", "conclusion", "acknowledgements", "references", "appendix", "other"]
# Section kinds whose paragraphs are never joined; titles that are headings without a number; lines that are noise.
CLOSED_KINDS = ["front_matter", "keywords", "references", "acknowledgements", "appendix"]
HEADINGS = ["abstract", "a_b_s_t_r_a_c_t", "keywords", "references", "acknowledgements", "acknowledgments", "conclusion", "conclusions", "summary"]
NOISE_LINES = ["contents lists available at sciencedirect", "available online", "article info", "a r t i c l e i n f o"]
#: Blocks that may stand between the parts of one paragraph.
MOST_SKIPS = 8


def title_key(title: Column) -> Column:
    """A title without leading numbering, lower case, other runs than letters and digits as `_`; `section` if nothing is left."""
    t = F.regexp_replace(F.trim(F.coalesce(title, F.lit(""))), r"^\d+(\.\d+)*\.?\s*", "")
    t = F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(t == "", "section").otherwise(t)


def numbered(title: Column) -> Column:
    return F.coalesce(F.trim(title).rlike(r"^\d+(?:\.\d+)*\.?\s+\S"), F.lit(False))


def real_heading(title: Column) -> Column:
    return numbered(title) | title_key(title).isin(HEADINGS)


def front_matter_heading(title: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    return title_key(title).isin("article_info", "a_r_t_i_c_l_e_i_n_f_o") | low.rlike("^(http://|https://|doi)") | low.contains("journal homepage")


def heading_level(title: Column) -> Column:
    """Depth of the leading number; 1 without one."""
    n = F.regexp_extract(F.trim(F.coalesce(title, F.lit(""))), r"^(\d+(?:\.\d+)*)", 1)
    return F.when(n == "", 1).otherwise(F.size(F.split(n, r"\.")))


def is_noise(text: Column, label: Column) -> Column:
    v = squeeze(F.coalesce(text, F.lit("")))
    return (v == "") | F.coalesce(label.isin(DROPPED_LABELS), F.lit(False)) | v.rlike(r"^\d+$") | F.lower(v).isin(NOISE_LINES) | F.lower(v).contains("journal homepage:")


def clean_package(items: DataFrame) -> DataFrame:
    """(paper_id, block_id, evidence_id, type, page, text, caption, position): content blocks in body order, numbered from 1.

    `items`: paper_id, pos, kind (texts, pictures, tables), idx, label, layer, page, text, caption. Furniture, dropped labels, other labels and noise are left out.
    """
    label = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.lit("text"))
    i = items.withColumn("label", label)
    text = (F.col("kind") == "texts") & F.col("label").isin(TEXT_LABELS) & (F.coalesce("layer", F.lit("")) != "furniture") & ~is_noise(F.col("text"), F.col("label"))
    kept = i.where(text | F.col("kind").isin("pictures", "tables"))
    n = F.row_number().over(Window.partitionBy("paper_id").orderBy("pos"))  # the items of one document
    kind = F.when(F.col("kind") == "pictures", "figure").when(F.col("kind") == "tables", "table").when(F.col("label") == "section_header", "heading_candidate").otherwise(F.col("label"))
    prefix = F.when(F.col("kind") == "pictures", "FIG").when(F.col("kind") == "tables", "TAB").otherwise("TXT")
    four = lambda c: F.format_string("%04d", c)
    kept = kept.withColumn("position", n)
    return kept.select("paper_id", F.concat("paper_id", F.lit("-BLK-"), four(F.col("position"))).alias("block_id"), F.concat("paper_id", F.lit("-"), prefix, F.lit("-"), four(F.col("idx") + 1)).alias("evidence_id"), kind.alias("type"), "page", F.when(F.col("kind") == "texts", F.trim("text")).alias("text"), F.when(F.col("kind") != "texts", F.coalesce("caption", F.lit(""))).alias("caption"), "position")


def captions(refs: DataFrame, texts: DataFrame) -> DataFrame:
    """(item, caption, first_ref): texts of an item's caption references (item, pos, ref) joined by blanks, in order; blank and unknown ones are left out."""
    t = refs.join(texts.select("ref", F.trim("text").alias("text")), "ref").where("text <> ''")
    g = t.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "ref"))).alias("c"))  # the captions of one figure
    return g.select("item", F.array_join(F.transform("c", lambda x: x["text"]), " ").alias("caption"), F.col("c")[0]["ref"].alias("first_ref"))


def dense_cells(cells: DataFrame) -> DataFrame:
    """(table_id, row, col, text): every place of each table; a cell fills its span, the last one of those that overlap wins, places without a cell are empty.

    `cells`: table_id, cell (order), r0, r1, c0, c1 (ends exclusive, null: one), text, rows, cols. Spans beyond the table are cut.
    """
    c = cells.select("table_id", "cell", "rows", "cols", F.coalesce("text", F.lit("")).alias("text"), F.greatest(F.lit(0), F.coalesce("r0", F.lit(0))).alias("r0"), F.coalesce("r1", F.coalesce("r0", F.lit(0)) + 1).alias("r1"), F.greatest(F.lit(0), F.coalesce("c0", F.lit(0))).alias("c0"), F.coalesce("c1", F.coalesce("c0", F.lit(0)) + 1).alias("c1"))
    span = lambda lo, hi, most: F.when(F.least(hi, most) > lo, F.sequence(lo, F.least(hi, most) - 1)).otherwise(F.array().cast("array<int>"))
    at = c.withColumn("row", F.explode(span(F.col("r0"), F.col("r1"), F.col("rows")))).withColumn("col", F.explode(span(F.col("c0"), F.col("c1"), F.col("cols"))))
    filled = at.groupBy("table_id", "row", "col").agg(F.max_by("text", "cell").alias("text"))
    size = cells.groupBy("table_id").agg(F.max("rows").alias("rows"), F.max("cols").alias("cols")).where("rows > 0 and cols > 0")
    grid = size.select("table_id", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), "cols").select("table_id", "row", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))
    return grid.join(filled, ["table_id", "row", "col"], "left").select("table_id", "row", "col", F.coalesce("text", F.lit("")).alias("text"))


def markdown_tables(dense: DataFrame) -> DataFrame:
    """(table_id, markdown) of dense cells; pipes are escaped, line ends are blanks."""
    t = F.trim(F.regexp_replace(F.replace("text", F.lit("|"), F.lit("\\|")), "\n", " "))
    rows = dense.groupBy("table_id", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", t.alias("t")))), lambda x: x["t"]), " | ").alias("line"), F.count("*").alias("n"))
    line = F.concat(F.lit("| "), "line", F.lit(" |"))
    rule = F.concat(F.lit("\n| "), F.array_join(F.array_repeat(F.lit("---"), F.col("n").cast("int")), " | "), F.lit(" |"))
    rows = rows.select("table_id", "row", F.when(F.col("row") == 0, F.concat(line, rule)).otherwise(line).alias("line"))
    return rows.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("markdown"))


def fused_letters(c: Column) -> Column:
    """Runs of three or more single letters put together, white space squeezed: `j o u r n a l` is `journal`."""
    blank = F.struct(F.lit("").alias("out"), F.lit("").alias("run"), F.lit(0).alias("n"))
    add = lambda out, x: F.when(x == "", out).when(out == "", x).otherwise(F.concat(out, F.lit(" "), x))
    run = lambda a: F.when(a["n"] >= 3, F.replace(a["run"], F.lit(" "), F.lit(""))).otherwise(a["run"])

    def step(a: Column, x: Column) -> Column:
        single = x.rlike(r"^\p{L}$")
        out = F.when(single, a["out"]).otherwise(add(add(a["out"], run(a)), x))
        return F.struct(out.alias("out"), F.when(single, add(a["run"], x)).otherwise("").alias("run"), F.when(single, a["n"] + 1).otherwise(0).alias("n"))

    return F.aggregate(F.split(squeeze(c), " "), blank, step, lambda a: add(a["out"], run(a)))


def doi_in(c: Column) -> Column:
    """A DOI that stands in the text or follows from a publisher's article number in it; empty if none. The first rule that holds counts."""
    t = F.coalesce(c, F.lit(""))
    low = F.lower(t)
    plain = F.regexp_replace(F.regexp_extract(t, r"(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)", 1), r"\.+$", "")
    journal = r"(?:^|[^a-z0-9])j[._-]([a-z0-9]+)[._-]((?:19|20)\d{2})[._-]([a-z0-9]+(?:[._-][a-z0-9]+)*)"
    j, y, a = (F.regexp_extract(low, journal, k) for k in (1, 2, 3))
    rsc = F.upper(F.regexp_extract(t, r"(?i)(?:^|[^A-Z0-9])([A-Z]\d[A-Z]{2}\d{5}[A-Z]?)(?:$|[^A-Z0-9])", 1))
    number = lambda token: F.regexp_extract(low, rf"(?:^|[^a-z0-9]){token}[._-]([0-9]{{4,}})(?:$|[^0-9])", 1)
    spe = r"(?i)(?:^|[^0-9])(\d{5,6})[-_](PA|MS|SPE)(?:$|[^A-Z0-9])"
    ladder = F.when(plain != "", plain).when(j != "", F.concat(F.lit("10.1016/j."), j, F.lit("."), y, F.lit("."), F.regexp_replace(a, "[._-]+", "."))).when(rsc != "", F.concat(F.lit("10.1039/"), rsc))
    ladder = ladder.when(number("aic") != "", F.concat(F.lit("10.1002/aic."), number("aic"))).when(number("advs") != "", F.concat(F.lit("10.1002/advs."), number("advs")))
    return ladder.when(F.regexp_extract(t, spe, 1) != "", F.concat(F.lit("10.2118/"), F.regexp_extract(t, spe, 1), F.lit("-"), F.upper(F.regexp_extract(t, spe, 2)))).otherwise("")


def year_in(names: list[Column], texts: list[Column]) -> Column:
    """The first year of the file names, else by a copyright or publication mark in the texts in turn, else the first year of the texts; empty if none."""
    bare = r"(?:^|\D)((?:19|20)\d{2})(?!\d)"
    marks = [r"(?is)(?:copyright|©|&|Ó|V C)\s*\D{0,20}\b((?:19|20)\d{2})\b", r"(?is)\bAvailable online\b.*?\b((?:19|20)\d{2})\b", r"(?is)\bPublished\b.*?\b((?:19|20)\d{2})\b"]
    get = lambda c, p: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), p, 1), F.lit(""))
    found = [get(c, bare) for c in names] + [get(c, p) for c in texts for p in marks] + [get(c, bare) for c in texts]
    return F.coalesce(*found, F.lit(""))


def stem_title(stem: Column) -> Column:
    """Title from a file stem of parts between underscores: a leading id, year and author and trailing article numbers are taken off."""
    s = F.regexp_replace(F.coalesce(stem, F.lit("")), "^_+|_+$", "")
    s = F.regexp_replace(F.regexp_replace(s, "_+", "_"), r"(?i)^S\d+(?:_|$)", "")
    s = F.regexp_replace(s, r"(?i)^(?:(?:19|20)\d{2}|unknown-year)(?:_|$)", "")
    s = F.regexp_replace(s, r"^(?:[A-Z][A-Za-z-]{1,30}|unknown)(?:_|$)", "")
    tail = r"j\.[a-z0-9]+\.(?:19|20)\d{2}\.[a-z0-9]+(?:\.[a-z0-9]+)*|[a-z]\d[a-z]{2}\d{5}[a-z]?|(?:aic|advs)(?:\.\d{4,})?|zot-[^_]*"
    s = F.regexp_replace(s, rf"(?i)(?:(?:^|_)(?:{tail}))+$", "")
    return mended_title(F.regexp_replace(F.replace(s, F.lit("_"), F.lit(" ")), r"^[ ._-]+|[ ._-]+$", ""))


def mended_title(c: Column) -> Column:
    """A title with squeezed blanks and the words that a lost ligature parts put together."""
    t = squeeze(c)
    for a, b in (("fl ow", "flow"), ("fl uid", "fluid"), ("microfl uidic", "microfluidic")):
        t = F.regexp_replace(t, rf"(?i)\b{a}\b", b)
    return squeeze(t)


def bad_title(c: Column, journals: list[str]) -> Column:
    """Whether a candidate is no title: empty, over 220 characters, two points or more, a standing phrase or a journal name."""
    t = mended_title(F.coalesce(c, F.lit("")))
    low = F.replace(title_key(t), F.lit("_"), F.lit(" "))
    # Standing phrases of first pages.
    phrases = ["miniaturisation for chemistry physics biology materials science and bioengineering", "contents lists available at sciencedirect", "full length article", "article info", "abstract"]
    return (t == "") | (F.length(t) > 220) | (F.regexp_count(t, F.lit(r"\.")) >= 2) | low.isin(phrases) | F.lower(t).isin([j.lower() for j in journals]) | low.rlike("^(journal homepage|www |issn |volume )")


def check_sections(sections: DataFrame, content: DataFrame) -> DataFrame:
    """(paper_id, unknown, repeated, missing, bad_kinds, status) of a section plan: sections (paper_id, section_id, section_kind, block_ids) against content (paper_id, block_id)."""
    each = sections.select("paper_id", F.explode("block_ids").alias("block_id"))
    n = each.groupBy("paper_id", "block_id").agg(F.count("*").alias("n")).join(content.select("paper_id", "block_id", F.lit(True).alias("known")), ["paper_id", "block_id"], "full")
    one = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    per = n.groupBy("paper_id").agg(F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("unknown"), F.sum(F.coalesce(F.col("n") - 1, F.lit(0))).alias("repeated"), one(F.col("n").isNull()).alias("missing"))
    kinds = sections.groupBy("paper_id").agg(one(~F.coalesce(F.col("section_kind").isin(SECTION_KINDS), F.lit(False))).alias("bad_kinds"))
    j = per.join(kinds, "paper_id", "left").withColumn("bad_kinds", F.coalesce("bad_kinds", F.lit(0)))
    return j.withColumn("status", F.when(F.col("unknown") + F.col("repeated") + F.col("missing") + F.col("bad_kinds") == 0, "ok").otherwise("needs_fix"))


def check_plan(plan: DataFrame, content: DataFrame, sections: DataFrame) -> DataFrame:
    """(paper_id, unknown_section, bad_type, no_sources, unknown, misplaced, missing, repeated, status) of a reading plan (paper_id, idx, section_id, reading_type, source_ids).

    `content`: paper_id, block_id; `sections`: paper_id, section_id, block_ids. `unknown` and `repeated` count distinct ids, `misplaced` each use.
    """
    one = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    known = sections.select("paper_id", "section_id", F.lit(True).alias("section")).distinct()
    rows = plan.join(known, ["paper_id", "section_id"], "left").groupBy("paper_id").agg(one(F.col("section").isNull()).alias("unknown_section"), one(~F.coalesce(F.col("reading_type").isin(READING_TYPES), F.lit(False))).alias("bad_type"), one(F.coalesce(F.size("source_ids"), F.lit(0)) < 1).alias("no_sources"))
    of = sections.select("paper_id", F.col("section_id").alias("expected"), F.explode("block_ids").alias("block_id")).groupBy("paper_id", "block_id").agg(F.max("expected").alias("expected"))
    blocks = content.select("paper_id", "block_id").join(of, ["paper_id", "block_id"], "left").withColumn("known", F.lit(True))
    uses = plan.select("paper_id", "section_id", F.explode("source_ids").alias("block_id")).groupBy("paper_id", "block_id").agg(F.count("*").alias("n"), F.collect_list("section_id").alias("at"))  # uses of one block
    j = uses.join(blocks, ["paper_id", "block_id"], "full")
    misplaced = F.when(F.col("known"), F.size(F.filter("at", lambda s: ~s.eqNullSafe(F.col("expected"))))).otherwise(0)
    per = j.groupBy("paper_id").agg(one(F.col("known").isNull()).alias("unknown"), F.sum(F.coalesce(F.when(F.col("n").isNotNull(), misplaced), F.lit(0))).alias("misplaced"), one(F.col("n").isNull()).alias("missing"), one(F.col("n") > 1).alias("repeated"))
    counts = ["unknown_section", "bad_type", "no_sources", "unknown", "misplaced", "missing", "repeated"]
    out = per.join(rows, "paper_id", "full").select("paper_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    return out.withColumn("status", F.when(sum((F.col(c) for c in counts), F.lit(0)) == 0, "ok").otherwise("needs_fix"))


def covered_plan(plan: DataFrame, content: DataFrame, sections: DataFrame) -> DataFrame:
    """(paper_id, idx, section_id, reading_type, source_ids, join_reason, confidence): a reading plan that covers its content.

    Unknown ids and rows without any known one are dropped; blocks that no row uses are added at the end, each in its section (else the first one), with the
    reading type of its kind. `content`: paper_id, block_id, type, position; `sections`: paper_id, section_id, block_ids, pos.
    """
    known = content.select("paper_id", "block_id", F.lit(True).alias("known"))
    each = plan.select("paper_id", "idx", F.posexplode("source_ids").alias("at", "block_id")).join(known, ["paper_id", "block_id"])
    ids = each.groupBy("paper_id", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "block_id"))), lambda x: x["block_id"]).alias("source_ids"))  # ids of one row
    kept = plan.drop("source_ids").join(ids, ["paper_id", "idx"]).select("paper_id", "idx", "section_id", "reading_type", "source_ids", "join_reason", "confidence")
    missing = content.join(each.select("paper_id", "block_id").distinct(), ["paper_id", "block_id"], "left_anti")
    of = sections.select("paper_id", "section_id", "pos", F.explode("block_ids").alias("block_id")).groupBy("paper_id", "block_id").agg(F.max_by("section_id", "pos").alias("own"))
    first = sections.groupBy("paper_id").agg(F.min_by("section_id", "pos").alias("first"))
    kind = F.when(F.col("type").isin(READING_TYPES), F.col("type")).when(F.col("type") == "heading_candidate", "section_heading").when(F.col("type") == "text", "paragraph").otherwise("other")
    last = plan.groupBy("paper_id").agg(F.max("idx").alias("last"))
    more = missing.join(of, ["paper_id", "block_id"], "left").join(first, "paper_id", "left").join(last, "paper_id", "left")
    at = F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy("paper_id").orderBy("position"))  # the blocks of one document
    added = more.select("paper_id", at.alias("idx"), F.coalesce("own", "first", F.lit("")).alias("section_id"), kind.alias("reading_type"), F.array("block_id").alias("source_ids"), F.lit("auto-added missing source block after plan coverage validation").alias("join_reason"), F.lit(1.0).alias("confidence"))
    return kept.unionByName(added)


def joined(parts: Column) -> Column:
    """Fragments joined by a blank, without one before closing punctuation and after an opening bracket, slash or hyphen; blank fragments are left out."""
    clean = F.filter(F.transform(parts, lambda p: squeeze(F.coalesce(p, F.lit("")))), lambda p: p != "")
    tight = lambda a, x: x.rlike(r"^[,.;:)\]}%]") | a.rlike(r"[(\[{/-]$")
    return F.aggregate(clean, F.lit(""), lambda a, x: F.when(a == "", x).when(tight(a, x), F.concat(a, x)).otherwise(F.concat(a, F.lit(" "), x)))


def page_header(c: Column) -> Column:
    return F.coalesce(squeeze(c).rlike(r"^[A-Z]\.\s+[A-Z][A-Za-z'\-]+ et al\.$"), F.lit(False))


def lead_in(c: Column) -> Column:
    return F.coalesce(F.lower(squeeze(c)).rlike(r"\b(calculated|defined|expressed|written|given|shown|obtained|computed)\s+as\b.*:$"), F.lit(False))


def explanation(c: Column) -> Column:
    return F.coalesce(F.lower(squeeze(c)).rlike(r"^(where |wherein |where, |here |here, )"), F.lit(False))


def connector(c: Column) -> Column:
    return F.coalesce(F.lower(squeeze(c)).rlike(r"^(and|or|where|then|therefore)\s*,?$"), F.lit(False))


def formula_continues(c: Column) -> Column:
    return F.coalesce(F.lower(squeeze(c)).rlike(r"^(represents |denotes |indicates |corresponds |is |are )"), F.lit(False))


def clamped(c: Column) -> Column:
    """A confidence as a number from 0 to 1; 1 where it is none."""
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c.cast("double"))), F.lit(1.0))


def materialise(plan: DataFrame, content: DataFrame, sections: DataFrame) -> DataFrame:
    """Reading blocks of a plan: paper_id, ord, section_id, section_title, section_kind, reading_type, include, page_start, page_end, source_ids, text, raw_text, caption, removed, confidence, join_reason.

    Sources are joined in the order of the plan; phrases that are a page header by themselves elsewhere in the paper are taken out of longer texts, the longest first. `content`: paper_id,
    block_id, type, page, text, caption. Rows whose sources are all unknown have no block.
    """
    phrases = content.where(F.col("type").isin(TEXT_TYPES) & page_header(F.col("text"))).groupBy("paper_id").agg(F.collect_set(squeeze(F.col("text"))).alias("p"))  # the headers of one paper
    phrases = phrases.select("paper_id", F.transform(F.array_sort(F.transform("p", lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"]).alias("phrases"))
    each = plan.select("paper_id", "idx", F.posexplode("source_ids").alias("at", "block_id")).join(content, ["paper_id", "block_id"])
    visual = F.col("type").isin("figure", "table")
    held = F.struct("at", "block_id", "type", "page", F.when(visual, "").otherwise(F.coalesce("text", F.lit(""))).alias("text"), F.when(visual, F.coalesce("caption", F.lit(""))).otherwise("").alias("caption"))
    g = each.groupBy("paper_id", "idx").agg(F.array_sort(F.collect_list(held)).alias("s"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))  # the sources of one block
    g = g.join(plan.drop("source_ids"), ["paper_id", "idx"]).join(sections.select("paper_id", "section_id", "section_title", "section_kind").dropDuplicates(["paper_id", "section_id"]), ["paper_id", "section_id"], "left").join(phrases, "paper_id", "left")
    g = g.withColumn("raw_text", joined(F.transform(F.filter("s", lambda x: x["type"].isin(TEXT_TYPES)), lambda x: x["text"]))).withColumn("phrases", F.coalesce("phrases", F.array().cast("array<string>")))
    takes = lambda a, p: F.contains(a["t"], p) & (squeeze(a["t"]) != p)
    start = F.struct(F.col("raw_text").alias("t"), F.lit(0).alias("n"))
    cleaned = F.aggregate("phrases", start, lambda a, p: F.when(takes(a, p), F.struct(F.replace(a["t"], p, F.lit(" ")).alias("t"), (a["n"] + 1).alias("n"))).otherwise(a))
    g = g.withColumn("c", cleaned).withColumn("text", squeeze(F.col("c.t")))
    every = F.forall("s", lambda x: page_header(x["text"]))
    kind = F.when(every, "page_header").when((F.col("reading_type") == "paragraph") & connector(F.col("text")), "formula").otherwise(F.col("reading_type"))
    g = g.withColumn("reading_type", kind)
    return g.select("paper_id", F.col("idx").alias("ord"), "section_id", "section_title", "section_kind", "reading_type", (~F.col("reading_type").isin("page_header", "noise")).alias("include"), "page_start", "page_end", F.transform("s", lambda x: x["block_id"]).alias("source_ids"), "text", "raw_text", joined(F.transform("s", lambda x: x["caption"])).alias("caption"), F.col("c.n").alias("removed"), clamped(F.col("confidence")).alias("confidence"), F.coalesce("join_reason", F.lit("")).alias("join_reason"))


FLAGS = {"incomplete": incomplete, "dangling": dangling, "continues": continues, "lead_in": lead_in, "explanation": explanation, "formula_continues": formula_continues}
COLUMNS = ["paper_id", "ord", "into", "reason"]


def _merges(rows: list[dict]) -> list[tuple[int, int, str]]:
    """(row, row it joins, reason) within one run of a section. Rows are in order, with their flags; a row that took another keeps the flags of the joined text."""
    gone: dict[int, int] = {}
    merged: list[tuple[int, int, str]] = []
    is_text = lambda r: r["include"] and r["reading_type"] == "paragraph"
    passes = lambda r: not r["include"] or r["reading_type"] in ("figure", "table", "caption")

    def take(into: int, row: int, reason: str) -> None:
        gone[row] = into
        merged.append((row, into, reason))
        a, b = rows[into], rows[row]
        for end in ("incomplete", "dangling", "lead_in"):  # how a text ends
            a[end] = b[end]
        a["incomplete"] = b["incomplete_joined"]

    def ahead(i: int) -> int | None:
        me, skipped = rows[i], 0
        for k in range(i + 1, len(rows)):
            r = rows[k]
            if is_text(r):
                skip = me["dangling"] and (r["lead_in"] or r["explanation"])
                if not skip:
                    fits = not r["explanation"] and (r["continues"] or me["dangling"])
                    return k if fits else None
            else:
                skip = passes(r) or me["dangling"] and r["reading_type"] in ("section_heading", "formula", "table", "figure", "page_header", "noise")
            if not skip:
                return None
            skipped += 1
            if skipped > MOST_SKIPS:
                return None
        return None

    def behind(i: int, unfinished: bool) -> int | None:
        me, skipped = rows[i], 0
        for k in range(i - 1, -1, -1):
            if k in gone:
                continue
            r = rows[k]
            if is_text(r):
                if r["explanation"] and me["formula_continues"] or not r["explanation"] and (r["incomplete"] or not unfinished):
                    return k
            elif not (passes(r) or r["reading_type"] == "section_heading"):
                return None
            skipped += 1
            if skipped > MOST_SKIPS:
                return None
        return None

    open_ = lambda i: i not in gone and is_text(rows[i]) and rows[i]["section_kind"] not in CLOSED_KINDS
    for i in range(len(rows)):
        if open_(i) and rows[i]["incomplete"] and (k := ahead(i)) is not None and k not in gone:
            take(i, k, "auto-merged incomplete paragraph across layout interruption")
    for i in range(len(rows)):
        if open_(i) and rows[i]["continues"] and not rows[i]["explanation"]:
            k = behind(i, True)
            k = behind(i, False) if k is None else k
            if k is not None:
                take(k, i, "auto-merged continuation paragraph across layout interruption")
    return merged


def coalesce_paragraphs(blocks: DataFrame) -> DataFrame:
    """Reading blocks with interrupted paragraphs joined and the blocks numbered anew (ord).

    `blocks`: paper_id, ord, section_id, section_kind, reading_type, include, page_start, page_end, source_ids, text, join_reason, confidence. First each unfinished paragraph takes the next one of its section that goes on
    with it, then each one that starts like the rest of another joins the nearest before; at most MOST_SKIPS blocks lie between. Nothing crosses a section, so the papers are sorted streams of which one run of a section is held at a time.
    Joined blocks have all sources, the outer pages, all reasons and a confidence of at most 0.75.
    """
    w = Window.partitionBy("paper_id").orderBy("ord")
    new = F.when(F.col("section_id").eqNullSafe(F.lag("section_id").over(w)), 0).otherwise(1)
    runs = cut(blocks.withColumn("_new", new).withColumn("section_run", F.sum("_new").over(w).cast("int")).drop("_new"))
    t = F.coalesce("text", F.lit(""))
    last = F.when(F.size(F.split(squeeze(t), " ")) < 4, ~squeeze(t).rlike(r"[.?!;:)\]}]$")).otherwise(incomplete(t))  # as the end of a longer text
    flagged = runs.select("paper_id", "section_run", "ord", "section_kind", "reading_type", F.coalesce("include", F.lit(True)).alias("include"), *[f(t).alias(n) for n, f in FLAGS.items()], last.alias("incomplete_joined"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run: list[dict] = []  # the open run of one section: all that is held
        for pdf in frames:
            found = []
            for r in pdf.to_dict("records"):
                if run and (r["paper_id"], r["section_run"]) != (run[0]["paper_id"], run[0]["section_run"]):
                    found += settle(run)
                    run = []
                run.append(r)
            yield pd.DataFrame(found, columns=COLUMNS)
        yield pd.DataFrame(settle(run), columns=COLUMNS)

    def settle(run: list[dict]) -> list[tuple]:
        return [(run[0]["paper_id"], run[a]["ord"], run[b]["ord"], why) for a, b, why in _merges(run)]

    moved = cut(flagged.repartition("paper_id").sortWithinPartitions("paper_id", "ord").mapInPandas(read, "paper_id string, ord int, into int, reason string"))
    # a block may take one that had taken others: two steps lead to the last, as the second pass only joins what the first left
    step = moved.select("paper_id", F.col("ord").alias("into"), F.col("into").alias("next"))
    final = moved.join(step, ["paper_id", "into"], "left").select("paper_id", "ord", F.coalesce("next", "into").alias("into"), "reason")
    final = final.join(step, ["paper_id", "into"], "left").select("paper_id", "ord", F.coalesce("next", "into").alias("into"), "reason")
    j = runs.join(final, ["paper_id", "ord"], "left").withColumn("head", F.coalesce("into", "ord"))
    part = F.struct("ord", "section_id", "section_kind", "reading_type", "include", "source_ids", "text", "join_reason", "reason", "page_start", "page_end", "confidence")
    g = j.groupBy("paper_id", "head").agg(F.array_sort(F.collect_list(part)).alias("p"), F.min(F.least("page_start", "page_end")).alias("lo"), F.max(F.greatest("page_start", "page_end")).alias("hi"), F.min(clamped(F.col("confidence"))).alias("conf"))  # the parts of one paragraph
    first, many = F.col("p")[0], F.size("p") > 1
    reasons = F.array_distinct(F.filter(F.transform(F.split(F.concat_ws(";", F.transform("p", lambda x: x["join_reason"]), F.transform("p", lambda x: x["reason"])), ";"), lambda r: F.trim(r)), lambda r: r != ""))
    n = F.row_number().over(Window.partitionBy("paper_id").orderBy("head"))
    return g.select("paper_id", n.alias("ord"), first["section_id"].alias("section_id"), first["section_kind"].alias("section_kind"), first["reading_type"].alias("reading_type"), first["include"].alias("include"), F.when(many, F.col("lo")).otherwise(first["page_start"]).alias("page_start"), F.when(many, F.col("hi")).otherwise(first["page_end"]).alias("page_end"), F.flatten(F.transform("p", lambda x: x["source_ids"])).alias("source_ids"), F.when(many, joined(F.transform("p", lambda x: x["text"]))).otherwise(first["text"]).alias("text"), F.when(many, F.array_join(reasons, "; ")).otherwise(first["join_reason"]).alias("join_reason"), F.when(many, F.least(F.col("conf"), F.lit(0.75))).otherwise(clamped(first["confidence"])).alias("confidence"))


def untangle_first_page(blocks: DataFrame, content: DataFrame) -> DataFrame:
    """Blocks in which the last source of a first-page abstract that belongs to the introduction is moved there.

    An abstract paragraph on page 1 with two sources or more, whose last source starts like the rest of another text or is unfinished, gives it to the first unfinished introduction paragraph on page
    1 or 2 among the next eleven blocks; without one it stays as it is. `content`: paper_id, block_id, page, text.
    """
    t = F.coalesce("text", F.lit(""))
    para = F.coalesce("include", F.lit(True)) & (F.col("reading_type") == "paragraph")
    w = Window.partitionBy("paper_id").orderBy("ord").rowsBetween(1, 11)
    target = F.when(para & (F.col("section_kind") == "introduction") & F.col("page_start").isin(1, 2) & incomplete(t), F.col("ord"))
    b = blocks.withColumn("target", F.min(target).over(w)).withColumn("last_id", F.element_at("source_ids", -1))
    giver = b.where(para & (F.col("section_kind") == "abstract") & (F.col("page_start") == 1) & (F.size("source_ids") > 1) & F.col("target").isNotNull())
    last = giver.select("paper_id", "ord", "target", F.col("last_id").alias("block_id"), "confidence").join(content.select("paper_id", "block_id", F.col("page").alias("last_page"), F.col("text").alias("last_text")), ["paper_id", "block_id"])
    last = last.where(F.coalesce(squeeze(F.col("last_text")), F.lit("")) != "").where(continues(F.col("last_text")) | incomplete(F.col("last_text")))
    given = last.select("paper_id", "ord", F.col("block_id").alias("given"))
    got = last.groupBy("paper_id", F.col("target").alias("ord")).agg(F.array_sort(F.collect_list(F.struct(F.col("ord").alias("from"), "block_id", "last_text", "last_page", "confidence"))).alias("got"))  # what one paragraph takes
    rest = blocks.join(given, ["paper_id", "ord"]).select("paper_id", "ord", F.posexplode(F.slice("source_ids", F.lit(1), F.size("source_ids") - 1)).alias("at", "block_id")).join(content.select("paper_id", "block_id", "page", F.col("text").alias("part")), ["paper_id", "block_id"])
    rest = rest.groupBy("paper_id", "ord").agg(joined(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])).alias("rest"), F.min("page").alias("rest_lo"), F.max("page").alias("rest_hi"))
    j = blocks.join(given, ["paper_id", "ord"], "left").join(rest, ["paper_id", "ord"], "left").join(got, ["paper_id", "ord"], "left")
    gave, took = F.col("given").isNotNull(), F.col("got").isNotNull()
    pages = F.transform("got", lambda x: x["last_page"])
    reason = "auto-split cross-section page-one continuation; auto-repaired page-one abstract/introduction interleaving"
    text = F.when(gave, F.col("rest")).when(took, joined(F.concat(F.array("text"), F.transform("got", lambda x: x["last_text"])))).otherwise(F.col("text"))
    changed = {"source_ids": F.when(gave, F.slice("source_ids", F.lit(1), F.size("source_ids") - 1)).when(took, F.concat("source_ids", F.transform("got", lambda x: x["block_id"]))).otherwise(F.col("source_ids")), "text": text, "page_start": F.when(gave, F.col("rest_lo")).when(took, F.least("page_start", F.array_min(pages))).otherwise(F.col("page_start")), "page_end": F.when(gave, F.col("rest_hi")).when(took, F.greatest("page_end", F.array_max(pages))).otherwise(F.col("page_end")), "join_reason": F.when(took, F.concat_ws("; ", F.nullif(F.col("join_reason"), F.lit("")), F.lit(reason))).otherwise(F.col("join_reason")), "confidence": F.when(took, F.least(clamped(F.col("confidence")), F.lit(0.65))).otherwise(F.col("confidence"))}
    return j.withColumns(changed).select(*blocks.columns)
