"""Quotes against their blocks: two-level verification, grounding, repair by the best sentence, and the checks of extracted items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.keys import nfkc, norm_loose, norm_tight, short_text, squeeze
from evispark.operators.evidence import parse_values, sentences

# Fixed value: the least number of characters that a fragment of a quote must have to count.
LEAST_FRAGMENT = 12


def fragments(quote: Column) -> Column:
    """Parts of a quote between ellipses."""
    return F.split(F.replace(quote, F.lit("…"), F.lit("...")), r"\.\.\.")


def _inside(quote: Column, text: Column, norm) -> tuple[Column, Column]:
    """(whether there is a fragment long enough, whether all of them are in the text)."""
    parts = F.filter(F.transform(fragments(quote), norm), lambda f: F.length(f) >= LEAST_FRAGMENT)
    return F.size(parts) > 0, F.forall(parts, lambda f: F.contains(text, f))


def verified(df: DataFrame, quote: str, text: str) -> DataFrame:
    """`df` with quote_verified, digits_verified and quote_reason (too_short, not_found or empty).

    Letters alone must agree for the first, letters and digits for the second; a null quote or text counts as empty. Compatibility forms are folded first.
    """
    q, t = nfkc(F.coalesce(F.col(quote), F.lit(""))), nfkc(F.coalesce(F.col(text), F.lit("")))
    d = df.withColumns({"_q": q, "_t": t}).withColumns({"_loose": norm_loose(F.col("_t")), "_tight": norm_tight(F.col("_t"))})
    has, ok = _inside(F.col("_q"), F.col("_loose"), norm_loose)
    has_digits, ok_digits = _inside(F.col("_q"), F.col("_tight"), norm_tight)
    out = d.withColumn("quote_reason", F.when(~has, "too_short").when(~ok, "not_found").otherwise(""))
    out = out.withColumn("quote_verified", F.col("quote_reason") == "").withColumn("digits_verified", F.col("quote_verified") & has_digits & ok_digits)
    return out.drop("_q", "_t", "_loose", "_tight")


def checked_items(items: DataFrame, blocks: DataFrame, facets: DataFrame) -> DataFrame:
    """Extracted items with `reason` (empty: accepted), the settled facet, the quote cut at 300 characters and its values.

    `items`: facet, proposed_facet, surface, quote, reading_block_id, role, and `item` (false where the answer held no object). `blocks`: reading_block_id, text, caption.
    The first reason counts: bad_item, bad_facet, bad_role, unknown_block, too_short, quote_not_found. `other` with a proposal is `proposed:...`. Values are
    read only from verified conditions. Repeats are kept on purpose.
    """
    trimmed = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    known = facets.select(F.col("facet").alias("_facet")).where("facet is not null").distinct()
    text = blocks.where("reading_block_id is not null").select(F.col("reading_block_id").alias("_id"), F.coalesce(F.expr("nullif(text, '')"), F.col("caption"), F.lit("")).alias("_text")).dropDuplicates(["_id"])
    i = items.withColumns({c: trimmed(c) for c in ("facet", "proposed_facet", "surface", "role", "reading_block_id")}).withColumn("quote", F.substring(trimmed("quote"), 1, 300))
    proposed = (F.col("facet") == "other") & (F.col("proposed_facet") != "")
    j = i.join(F.broadcast(known), F.col("facet") == F.col("_facet"), "left").join(text, F.col("reading_block_id") == F.col("_id"), "left")  # a facet list is a few names
    j = verified(j.withColumn("facet", F.when(proposed, F.concat(F.lit("proposed:"), "proposed_facet")).otherwise(F.col("facet"))), "quote", "_text")
    fine = F.col("_facet").isNotNull() | F.col("facet").startswith("proposed:")
    reason = F.when(~F.coalesce("item", F.lit(True)), "bad_item").when(~fine, "bad_facet").when(~F.col("role").isin("used", "mentioned"), "bad_role").when(F.col("_id").isNull(), "unknown_block")
    reason = reason.when(F.col("quote_reason") == "not_found", "quote_not_found").otherwise(F.col("quote_reason"))
    empty = F.array().cast("array<struct<num:string,unit:string>>")
    values = F.when((reason == "") & (F.col("facet") == "condition") & F.col("digits_verified"), parse_values(F.col("quote"))).otherwise(empty)
    return j.withColumn("reason", reason).withColumn("values", values).drop("_facet", "_id", "_text", "quote_reason")


def backfilled(old: DataFrame, found: DataFrame) -> DataFrame:
    """Occurrences with their findings replaced by the accepted findings of `found`; running it again changes nothing. Both need `facet`; `found` also `reason`."""
    return old.where("facet is null or facet <> 'finding'").unionByName(found.where("facet = 'finding' and reason = ''").select(*old.columns))


# Fixed value: what counts as a term of a quote.
TERM = r"([A-Za-z0-9𝛒𝛟𝛉𝛋𝛑ηρφθκπ][A-Za-z0-9𝛒𝛟𝛉𝛋𝛑ηρφθκπ/*.+-]*)"


def terms(c: Column) -> Column:
    """Distinct lower-case terms of two characters or more."""
    t = F.regexp_extract_all(squeeze(F.coalesce(c, F.lit(""))), F.lit(TERM), F.lit(1))
    return F.array_distinct(F.transform(F.filter(t, lambda x: F.length(x) >= 2), lambda x: F.lower(x)))


def overlap(a: Column, b: Column) -> Column:
    """Share of the terms of `a` that `b` has; 0 where `a` has none."""
    return F.when(F.size(terms(a)) > 0, F.size(F.array_intersect(terms(a), terms(b))) / F.size(terms(a))).otherwise(0.0)


def in_block(quote: Column, text: Column) -> Column:
    """Whether a quote stands in a text, white space aside."""
    q = squeeze(F.coalesce(quote, F.lit("")))
    return (q != "") & F.contains(squeeze(F.coalesce(text, F.lit(""))), q)


def repaired_quote(quote: Column, text: Column, least: float = 0.55) -> Column:
    """The quote if it stands in the text, else the first sentence that shares most of its terms (cut at 520), if at least `least` of them; else the quote as it is."""
    scored = F.transform(sentences(text), lambda s, i: F.struct(overlap(quote, s).alias("score"), (-i).alias("at"), s.alias("s")))
    best = F.array_max(scored)
    return F.when(in_block(quote, text), squeeze(quote)).when(best["score"] >= least, short_text(best["s"], 520)).otherwise(squeeze(quote))


def grounded(quotes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(card, quotes, in_cited, elsewhere, ungrounded, rate) of quotes (card, reading_block_id, quote) against blocks (card, id, place, text).

    By letters alone, fragments of LEAST_FRAGMENT letters or more; quotes without one don't count. `elsewhere`: all fragments stand in the paper's text as a whole, but not in the cited block.
    """
    b = blocks.select("card", "id", "place", norm_loose(F.coalesce("text", F.lit(""))).alias("t"))
    whole = b.groupBy("card").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id", "t"))), lambda x: x["t"]), "").alias("whole"))  # one paper's text
    q = quotes.select("card", F.col("reading_block_id").alias("id"), F.filter(F.transform(fragments(F.coalesce("quote", F.lit(""))), norm_loose), lambda f: F.length(f) >= LEAST_FRAGMENT).alias("f")).where("size(f) > 0")
    j = q.join(whole, "card").join(b.select("card", "id", "t"), ["card", "id"], "left")
    cited = F.forall("f", lambda f: F.contains(F.coalesce("t", F.lit("")), f))
    far = F.forall("f", lambda f: F.contains(F.col("whole"), f))
    where = F.when(cited, "c").when(far, "e").otherwise("u")
    g = j.withColumn("w", where).groupBy("card").agg(F.count("*").alias("quotes"), *[F.sum((F.col("w") == k).cast("int")).alias(n) for k, n in (("c", "in_cited"), ("e", "elsewhere"), ("u", "ungrounded"))])
    return g.withColumn("rate", F.round(F.col("in_cited") / F.col("quotes"), 3))
