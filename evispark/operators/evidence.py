"""Text predicates, block relevance, sentences, atom types, values and quotes: all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.keys import squeeze

# Fixed values of the relevance score: section groups, block types, words.
FRONT_SECTIONS = ["front_matter", "keywords", "abstract", "conclusion"]
CORE_SECTIONS = ["methods", "results", "discussion", "results_discussion"]
SKIPPED_TYPES = ["page_header", "noise", "formula"]
RELEVANT_WORDS = ["this study", "in this work", "aim", "objective", "method", "experiment", "simulation", "pressure", "temperature", "mpa", "adsorption", "diffusion", "results suggested", "conclude", "limitation", "recommended"]
# Weights of words in the sentence score.
SENTENCE_WEIGHTS = {"this study": 35, "this paper": 30, "in this work": 30, "employed": 25, "used": 15, "method": 15, "experiment": 20, "simulation": 20, "model": 15, "pressure": 20, "temperature": 20, "mpa": 20, "adsorption": 25, "diffusion": 25, "tortuosity": 25, "methane": 15, "carbon dioxide": 15, "ch4": 15, "co2": 15, "result": 25, "suggest": 25, "found": 20, "increase": 20, "decrease": 20, "higher": 15, "lower": 15, "greater": 15, "conclude": 25, "limitation": 30, "future": 15}
# Word groups of the atom types.
LIMITS, RANGES = ["limitation", "future work", "uncertainty", "not representative"], ["pressure", "temperature", "mpa", "range", "ratio"]
CHANGES = ["result", "increase", "decrease", "greater", "higher", "lower"]
METHODS, MECHANISMS = ["method", "employed", "used", "experiment", "simulation", "model"], ["mechanism", "interaction", "pathway", "heterogeneity", "confinement"]
RESULTS = ["result", "suggest", "found", "increase", "decrease", "higher", "lower", "greater", "conclude"]
# The units of the short value parser.
VALUE_UNITS = r"°C|°F|K\b|MPa|GPa|kPa|bar\b|atm\b|psi\b|rpm\b|wt\.?%|vol\.?%|%|nm\b|µm|μm|mm\b|cm³/g|cm3/g|mmol/g|mg/g|m²/g|m2/g|h\b|hr\b|hours?\b|min\b"
VALUE = rf"(?<![\d.\-])(\d+(?:\.\d+)?(?:\s*[-–—~]\s*\d+(?:\.\d+)?)?)\s*({VALUE_UNITS})"
# Endings that leave a phrase hanging, and words that go on with one.
DANGLING = [" due to the", " because of the", " attributed to the", " resulting from the", " leading to the", " with the", " for the", " in the", " of the", " as a", " using", " include", " includes", " including", " to better characterize gas density distribution and adsorption", " gas adsorption capacity"]
CONTINUING = ["and", "or", "but", "which", "whereas", "thereby", "therefore", "resulting", "leading"]


def any_of(c: Column, words: list[str]) -> Column:
    """Whether the lower-case text contains one of the words anywhere."""
    low = F.lower(c)
    found = F.lit(False)
    for w in words:
        found = found | low.contains(w)
    return found


def section_kind(title: Column) -> Column:
    """Kind of a section by its title without leading numbering; null counts as empty."""
    t = F.regexp_replace(F.trim(F.coalesce(title, F.lit(""))), r"^\d+(\.\d+)*\.?\s*", "")
    t = F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    has = lambda *ws: any_of(t, list(ws))
    ladder = F.when(t.isin("abstract", "a_b_s_t_r_a_c_t"), "abstract").when(has("keyword"), "keywords").when(has("introduction"), "introduction")
    ladder = ladder.when(has("method", "experiment", "simulation", "computational"), "methods").when(has("result", "discussion", "analysis"), "results_discussion")
    return ladder.when(has("conclusion", "summary"), "conclusion").when(has("reference"), "references").otherwise("body")


def relevant_blocks(blocks: DataFrame, limit: int = 140) -> DataFrame:
    """The `limit` blocks of each paper that score highest for a card (a top-k report), earliest first at ties. Needs id, paper_id, block_order, text, caption, section_kind, reading_type, include."""
    text = squeeze(F.concat_ws(" ", F.col("text"), F.col("caption")))
    kept = blocks.withColumn("t", text).where("coalesce(include, true) and t <> ''").where(~F.coalesce(F.col("reading_type").isin(SKIPPED_TYPES), F.lit(False)))
    add = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    score = add(F.col("section_kind").isin(FRONT_SECTIONS), 100) + add(F.col("section_kind").isin(CORE_SECTIONS), 80) + add(F.col("reading_type").isin("section_heading", "keywords"), 40)
    score = score + add(F.col("reading_type").isin("table", "figure"), 35) + add(any_of(F.col("t"), RELEVANT_WORDS), 30) + add(F.col("t").rlike("[0-9]"), 10)
    w = Window.partitionBy("paper_id").orderBy(F.desc("score"), "block_order", "id")
    return kept.withColumn("score", score).where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("t")


def sentences(c: Column) -> Column:
    """Sentences of five words or more; a single one of over 450 characters is parted at semicolons."""
    v = squeeze(c)
    first = F.split(v, r"(?<=[.!?])\s+(?=[A-Z0-9(])")
    parts = F.when((F.size(first) == 1) & (F.length(v) > 450), F.split(v, r";\s+")).otherwise(first)
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.size(F.split(s, r"\s+")) >= 5)


def sentence_score(sentence: Column, kind: Column) -> Column:
    """Additive score of a sentence by section, digits and words."""
    score = F.when(kind.isin("abstract", "conclusion"), 40).when(kind.isin(CORE_SECTIONS), 30).otherwise(0) + F.when(sentence.rlike("[0-9]"), 15).otherwise(0)
    low = F.lower(sentence)
    for w, n in SENTENCE_WEIGHTS.items():
        score = score + F.when(low.contains(w), n).otherwise(0)
    return score


def atom_type(sentence: Column, kind: Column) -> Column:
    """Type of an evidence atom: a ladder of word groups, then the section."""
    digit = F.when(sentence.rlike("[0-9]"), "quantitative_result").otherwise("result")
    ladder = F.when(any_of(sentence, LIMITS), "limitation").when(any_of(sentence, RANGES) & any_of(sentence, CHANGES), digit).when(any_of(sentence, RANGES), "variable")
    ladder = ladder.when((kind == "methods") | any_of(sentence, METHODS), "method").when(any_of(sentence, MECHANISMS), "mechanism").when(any_of(sentence, RESULTS), digit)
    return ladder.when(kind.isin("abstract", "conclusion", "results", "discussion", "results_discussion"), "result").when(kind == "introduction", "background").otherwise("other")


def parse_values(c: Column) -> Column:
    """array<struct<num, unit>> of numbers with one of the short parser's units; signed numbers are skipped, range dashes become hyphens."""
    pattern = F.lit(VALUE)
    nums, units = F.regexp_extract_all(c, pattern, F.lit(1)), F.regexp_extract_all(c, pattern, F.lit(2))
    return F.arrays_zip(F.transform(nums, lambda x: F.regexp_replace(x, r"\s*[-–—~]\s*", "-")).alias("num"), units.alias("unit"))


def incomplete(c: Column) -> Column:
    """A paragraph of four words or more that ends without closing punctuation; long ones that end in a name count as complete."""
    v = squeeze(F.coalesce(c, F.lit("")))
    n = F.size(F.split(v, " "))
    name = (n > 120) & v.rlike(r"\b[A-Z][a-z]+(?:\s+and\s+[A-Z][a-z]+)?$")
    return (v != "") & (n >= 4) & ~v.rlike(r"[.?!;:)\]}]$") & ~name


def dangling(c: Column) -> Column:
    v = F.lower(squeeze(F.coalesce(c, F.lit(""))))
    found = F.lit(False)
    for e in DANGLING:
        found = found | v.endswith(e)
    return found


def continues(c: Column) -> Column:
    """Whether a paragraph starts like the rest of another."""
    v = squeeze(F.coalesce(c, F.lit("")))
    word = F.lower(F.regexp_replace(F.split(v, " ")[0], r"^[ ,;:()\[\]{}]+|[ ,;:()\[\]{}]+$", ""))
    return (v != "") & (v.rlike(r"^\[\d+(?:,\d+)*\]\.|^\d{4}[a-z]?\s*[;,)]|^\p{Ll}") | word.isin(CONTINUING))


def cjk_share_all(c: Column) -> Column:
    """CJK characters over all characters; 0 for empty and null. Deferred above 0.05."""
    n = F.regexp_count(F.coalesce(c, F.lit("")), F.lit("[㐀-鿿]"))
    return F.when(F.length(c) > 0, n / F.length(c)).otherwise(0.0)


def cjk_share_letters(c: Column) -> Column:
    """CJK characters over CJK and ASCII letters, four digits; 0 where there are neither. Deferred from 0.15."""
    t = F.coalesce(c, F.lit(""))
    n, a = F.regexp_count(t, F.lit("[㐀-鿿]")), F.regexp_count(t, F.lit("[A-Za-z]"))
    return F.when(n + a > 0, F.round(n / (n + a), 4)).otherwise(0.0)


def author_key(name: Column) -> Column:
    """`family_initial` of a name by its comma form or its last word; ASCII letters only after folding by NFD is left to the caller."""
    n = squeeze(name)
    comma = n.contains(",")
    family = F.when(comma, F.substring_index(n, ",", 1)).otherwise(F.regexp_extract(n, r"(\S+)$", 1))
    given = F.when(comma, F.regexp_replace(n, "^[^,]*,", "")).otherwise(F.regexp_replace(n, r"\s*\S+$", ""))
    letters = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    f, g = letters(family), F.substring(letters(given), 1, 1)
    return F.when(f == "", "").when(g == "", f).otherwise(F.concat(f, F.lit("_"), g))
