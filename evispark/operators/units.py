"""Quantities recorded in different units: link entities across recordings, estimate scale and offset, snap, propagate.

A source is a unit spelling: everything recorded under it shares one (unknown) affine map to the common unit. The same
entity recorded under two spellings links them. For each linked pair a robust scale and offset is estimated from the
entities' quantiles, snapped to the nearest known conversion, and the snapped maps are carried from the common unit
through the graph of spellings along its best-supported links. A spelling whose text is itself a known unit has that one
conversion as its only candidate, so the estimate can confirm it but never move it; an unknown spelling takes what its
links say, if they agree.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evispark.functions.quantities import KNOWN, mentions
from evispark.session import cut

MENTION = T.ArrayType(
    T.StructType(
        [
            T.StructField("lo", T.DoubleType()),
            T.StructField("hi", T.DoubleType()),
            T.StructField("unit", T.StringType()),
            T.StructField("part", T.DoubleType()),
            T.StructField("part_unit", T.StringType()),
        ]
    )
)
#: Spellings the graph on the driver may have. Unit spellings don't grow with the rows; more of them is a wrong input.
MAX_SPELLINGS = 5_000
#: Decades between a known conversion and the estimate from which the estimate may refuse it, and the (entities, values) of a link that may.
REFUSED, STRONG = 1.5, (8, 200)
#: Rows the list of wanted quantities may have; more raise an error.
MAX_TARGETS = 1_000


def stated(df: DataFrame, key: str, entity: str, text: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, entity, lo, hi, unit, part, part_unit): one row per stated value of each text.

    Texts without a digit never leave the JVM. Null and empty texts state nothing. `extra`: spellings to read besides the known ones.
    """

    @F.pandas_udf(MENTION)
    def read(s: pd.Series) -> pd.Series:
        return s.map(lambda t: mentions(t, extra))

    digits = df.where(F.col(f"`{text}`").rlike("[0-9]")).select(F.col(f"`{key}`").alias("key"), F.col(f"`{entity}`").alias("entity"), F.col(f"`{text}`").alias("_t"))
    return digits.select("key", "entity", F.explode(read("_t")).alias("m")).select("key", "entity", "m.*")


def unknown_spellings(df: DataFrame, values_json: str, least: int = 3) -> list[str]:
    """Spellings recorded as a unit in at least `least` value lists that are no known unit; fewer than three give no estimate.

    Null, empty and broken lists give none. The result is bounded by MAX_SPELLINGS; more raises an error instead of being cut.
    """
    units = F.expr(f"from_json(`{values_json}`, 'array<struct<raw:string,unit:string,num:string>>')")
    u = df.select(F.explode(units).alias("v")).select(F.trim("v.unit").alias("u")).where("u <> '' and u not rlike '[0-9]'")
    counts = u.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    names = [r["u"].replace("μ", "µ") for r in counts.limit(MAX_SPELLINGS + 1).collect()]
    if len(names) > MAX_SPELLINGS:
        raise ValueError("more unit spellings than MAX_SPELLINGS: values_json doesn't hold units")
    two_part = {f"{a} {b}" for a in ("wk", "d", "h", "hr", "min", "lb", "kg") for b in ("d", "h", "min", "s", "sec", "oz", "g")}
    return sorted(n for n in names if n not in KNOWN and n not in two_part)


def profiles(rows: DataFrame) -> DataFrame:
    """(entity, unit, n, q1, med, q3): robust summary of what each entity has under each spelling. A hot entity is combined on the map side."""
    mid = (F.col("lo") + F.col("hi")) / 2
    q = F.percentile_approx(mid, [0.25, 0.5, 0.75], 200)
    p = rows.where("part is null and entity is not null").groupBy("entity", "unit").agg(F.count("*").alias("n"), q.alias("q"))
    return p.select("entity", "unit", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("med"), F.col("q")[2].alias("q3"))


def pairwise(profile: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, entities, n, log_scale, disagree, med_a, med_b, spread_a, spread_b) for spellings a < b that share entities.

    log_scale is the median over the entities of log10(median under a / median under b), disagree the range of the middle four fifths of them. The join is on the entity, whose
    rows are already one per spelling.
    """
    p = profile.where(F.col("n") >= least)
    a = p.select("entity", *[F.col(c).alias(f"{c}_a") for c in ("unit", "n", "q1", "med", "q3")])
    b = p.select("entity", *[F.col(c).alias(f"{c}_b") for c in ("unit", "n", "q1", "med", "q3")])
    j = a.join(b, "entity").where("unit_a < unit_b")
    ratio = F.when((F.col("med_a") > 0) & (F.col("med_b") > 0), F.log10(F.col("med_a") / F.col("med_b")))
    return j.groupBy(F.col("unit_a").alias("a"), F.col("unit_b").alias("b")).agg(
        F.count("*").alias("entities"),
        F.sum(F.least("n_a", "n_b")).alias("n"),
        F.percentile_approx(ratio, 0.5, 1000).alias("log_scale"),
        (F.percentile_approx(ratio, 0.9, 1000) - F.percentile_approx(ratio, 0.1, 1000)).alias("disagree"),
        F.percentile_approx("med_a", 0.5, 1000).alias("med_a"),
        F.percentile_approx("med_b", 0.5, 1000).alias("med_b"),
        F.percentile_approx(F.col("q3_a") - F.col("q1_a"), 0.5, 1000).alias("spread_a"),
        F.percentile_approx(F.col("q3_b") - F.col("q1_b"), 0.5, 1000).alias("spread_b"),
    )


def propagate(links: list[dict], spellings: list[str], targets: dict[str, str], tolerance: float = 0.35) -> dict[str, tuple[str, float, float, str]]:
    """spelling -> (quantity, scale, offset, how), from the common units outwards over the best-supported links.

    Links are walked strongest first. At each step the estimate for the new spelling is the settled map of its neighbour
    composed with the pair's estimate; it is snapped to the nearest candidate conversion. how: `common` (the
    target itself), `confirmed` (known, and the estimate is within `tolerance` decades), `known` (known, no link or an estimate
    too coarse to say), `snapped` (unknown, and its links lead to one conversion), `refused` (known, but a link of at least STRONG entities and values, whose entities agree within `tolerance`, puts it REFUSED decades or more from its
    conversion and within `tolerance` of another of the quantity: it is used for that one). Spellings with neither are left out.
    """
    near: dict[str, list[tuple[float, str, dict, int]]] = {}
    for e in links:
        w = math.log1p(e["n"]) * math.sqrt(e["entities"])
        near.setdefault(e["a"], []).append((w, e["b"], e, 1))
        near.setdefault(e["b"], []).append((w, e["a"], e, -1))
    done: dict[str, tuple[str, float, float, str]] = {}
    queue: list[tuple[float, int, str, tuple[str, float, float, str]]] = []
    tick = 0
    for quantity, unit in targets.items():
        heapq.heappush(queue, (-math.inf, tick, unit, (quantity, 1.0, 0.0, "common")))
        tick += 1
    while queue:
        _, _, unit, settled = heapq.heappop(queue)
        if unit in done:
            continue
        done[unit] = settled
        quantity, scale, offset, _ = settled
        for w, other, e, way in near.get(unit, []):
            if other in done:
                continue
            guess = _estimate(scale, offset, e, way)
            known = KNOWN.get(other)
            options = {(s, o) for q, s, o in KNOWN.values() if q == quantity}
            best = min(options, key=lambda x: _gap(x, guess, e, way)) if guess else None
            if known:
                if known[0] != quantity:
                    continue  # an entity that holds two quantities links nothing
                off = _gap(known[1:], guess, e, way) if guess else 0.0
                if guess and not offset and off >= REFUSED and e["disagree"] <= tolerance and e["entities"] >= STRONG[0] and e["n"] >= STRONG[1] and _gap(best, guess, e, way) <= tolerance:
                    found = (quantity, *best, "refused")
                else:
                    found = (*known, "confirmed" if guess and abs(math.log10(guess[0] / known[1])) <= tolerance else "known")
            else:
                if not guess:
                    continue
                if _gap(best, guess, e, way) > tolerance:
                    continue
                found = (quantity, *best, "snapped")
            heapq.heappush(queue, (-w, tick, other, found))
            tick += 1
    for s in spellings:
        if s not in done and s in KNOWN:
            done[s] = (*KNOWN[s], "known")
    return done


def _estimate(scale: float, offset: float, e: dict, way: int) -> tuple[float, float] | None:
    """The map of the far end of link `e`, as seen from an end with the map (scale, offset)."""
    here, there = ("a", "b") if way == 1 else ("b", "a")
    if offset:  # an offset unit: the ratio of spreads is the scale, the medians give the offset
        if not e[f"spread_{here}"] or not e[f"spread_{there}"]:
            return None
        s = scale * e[f"spread_{here}"] / e[f"spread_{there}"]
        return s, scale * e[f"med_{here}"] + offset - s * e[f"med_{there}"]
    if e["log_scale"] is None:
        return None
    return scale * 10 ** (e["log_scale"] * way), 0.0


def _gap(option: tuple[float, float], guess: tuple[float, float], e: dict, way: int) -> float:
    """Decades between what a candidate and the estimate make of a typical value."""
    at = e["med_b" if way == 1 else "med_a"] or 1.0
    x, y = option[0] * at + option[1], guess[0] * at + guess[1]
    return abs(math.log10(x / y)) if x > 0 and y > 0 else math.inf


def unit_map(rows: DataFrame, targets: dict[str, str]) -> dict[str, tuple[str, float, float, str]]:
    """The conversion of each spelling in `rows` (columns entity, lo, hi, unit, part). Only per-spelling figures reach the driver, MAX_SPELLINGS squared at most."""
    spelt = rows.select(F.explode(F.array("unit", "part_unit")).alias("unit")).where("unit is not null").distinct()
    names = [r[0] for r in spelt.limit(MAX_SPELLINGS + 1).collect()]
    if len(names) > MAX_SPELLINGS:
        raise ValueError("more unit spellings than MAX_SPELLINGS")
    links = [r.asDict() for r in pairwise(profiles(rows)).collect()]
    known = propagate(links, names, targets)
    return {u: known[u] for u in names if u in known}


def convert(rows: DataFrame, conversions: dict[str, tuple[str, float, float, str]]) -> DataFrame:
    """(key, quantity, lo, hi) in common units; rows of spellings without a conversion are left out (they measure nothing listed).

    A value in two parts is the sum of both. lo <= hi always. Repeated rows stay repeated.
    """
    spark = rows.sparkSession
    schema = "unit string, quantity string, scale double, shift double"
    data = [(u, q, s, o) for u, (q, s, o, _) in sorted(conversions.items())]
    units = spark.createDataFrame(data, schema)
    extra = spark.createDataFrame([(u, s) for u, _, s, _ in data], "part_unit string, part_scale double")
    j = rows.join(F.broadcast(units), "unit").join(F.broadcast(extra), "part_unit", "left")  # at most MAX_SPELLINGS rows each
    more = F.coalesce(F.col("part") * F.col("part_scale"), F.lit(0.0))
    lo, hi = F.col("lo") * F.col("scale") + F.col("shift") + more, F.col("hi") * F.col("scale") + F.col("shift") + more
    return j.select("key", "quantity", lo.alias("lo"), hi.alias("hi"))


@F.pandas_udf(T.StringType())
def exponent_text(x: pd.Series) -> pd.Series:
    """`%.2e` as C prints it. Null stays null."""
    return x.map(lambda v: None if v is None or v != v else "%.2e" % v)


def harmonise(df: DataFrame, targets: DataFrame, key: str, entity: str, text: str, values_json: str) -> DataFrame:
    """All stated values of `text` in the common units of `targets` (quantity, common_unit): distinct (key, quantity, lo, hi) as doubles.

    `values_json` serves to find spellings that are no known unit; `entity` links recordings. Empty tables give no rows;
    a null text, an unreadable number and a quantity that isn't listed give no row; null keys are kept as null.
    """
    rows, conversions = conversions_of(df, targets, key, entity, text, values_json)
    return convert(rows, conversions).distinct()


def conversions_of(df: DataFrame, targets: DataFrame, key: str, entity: str, text: str, values_json: str) -> tuple[DataFrame, dict[str, tuple[str, float, float, str]]]:
    """(stated values, conversion of each spelling with how it was settled) for `harmonise`."""
    listed = targets.select("quantity", "common_unit").distinct().limit(MAX_TARGETS + 1).collect()
    if len(listed) > MAX_TARGETS:
        raise ValueError("more quantities than MAX_TARGETS")
    wanted = {r["quantity"]: r["common_unit"] for r in listed}
    extra = tuple(unknown_spellings(df, values_json))
    rows = cut(stated(df, key, entity, text, extra))
    return rows, {u: c for u, c in unit_map(rows, wanted).items() if c[0] in wanted}
