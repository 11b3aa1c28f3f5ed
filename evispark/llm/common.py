"""Small shared expressions of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pairs_of(array: str) -> str:
    """SQL: all ordered pairs (x before y) of a sorted, bounded array column, as array<struct<x,y>>."""
    return f"flatten(transform({array}, (v, i) -> transform(slice({array}, i + 2, size({array})), w -> struct(v as x, w as y))))"


def trimmed_lower(c: Column) -> Column:
    """Lower case without outer white space."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
