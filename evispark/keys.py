"""Identity and key functions as Column expressions; only Unicode folding, which Spark lacks, goes through Arrow."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_key(c: Column) -> Column:
    """Lower case, each run of other characters than a-z and 0-9 as one blank, trimmed. Null stays null."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def slugify(c: Column) -> Column:
    """Unicode letters and digits kept, other runs one hyphen, `unnamed` if nothing is left."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", "unnamed").otherwise(s)


def element_id(facet: Column, name: Column) -> Column:
    return F.concat(F.lit("elem:"), facet, F.lit("/"), slugify(name))


def facet_of(element: Column) -> Column:
    return F.regexp_extract(element, "^[^:]*:([^/]*)/", 1)


def slug_of(element: Column) -> Column:
    return F.regexp_extract(element, "^[^/]*/(.*)$", 1)


def dedupe_key(c: Column) -> Column:
    """`norm_key` with a cautious singular of each token."""

    def one(t: Column) -> Column:
        plural = (F.length(t) > 3) & t.endswith("s") & ~t.rlike("(ss|us|is)$")
        return F.when(plural, F.regexp_replace(t, "s$", "")).otherwise(t)

    return F.array_join(F.transform(F.split(norm_key(c), " "), one), " ")


def norm_loose(c: Column) -> Column:
    """Letters only, lower case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}]", "")


def norm_tight(c: Column) -> Column:
    """Letters and digits, lower case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def squeeze(c: Column) -> Column:
    """White-space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def short_text(c: Column, n: int) -> Column:
    """Squeezed text, cut to n-1 characters and an ellipsis of three dots where it is longer than n."""
    s = squeeze(c)
    return F.when(F.length(s) > n, F.concat(F.rtrim(F.substring(s, 1, n - 1)), F.lit("..."))).otherwise(s)


def _folded(form: str, marks: bool):
    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        one = lambda t: t if t is None or t.isascii() else "".join(ch for ch in unicodedata.normalize(form, t) if marks or not unicodedata.combining(ch))
        return s.map(one, na_action="ignore")

    return fold


def nfkc(c: Column) -> Column:
    """Compatibility forms (ligatures, full-width letters, superscripts) as plain characters. Null stays null."""
    return _folded("NFKC", True)(c)


def unaccented(c: Column) -> Column:
    """Letters without their marks (canonical decomposition). Null stays null."""
    return _folded("NFD", False)(c)
