"""Intake: duplicate candidates by words, name profiles, download dedupe, id allocation, state logs, freshness of derived stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.keys import norm_key
from evispark.operators.grid import overlapping
from evispark.session import cut, shuffled


def token_overlap(df: DataFrame, key: str, text: str, least: float = 0.72) -> DataFrame:
    """(a, b, shared, smaller) with a < b: pairs whose word sets share at least `least` of the smaller one. Exact.

    A pair at the threshold shares one of the rarest words of its smaller set: only those of each set are looked up among all words, so
    a word that most texts have is looked up only by texts of hardly anything else. Null and empty texts have no pair.
    """
    words = df.select(F.col(key).alias("id"), F.array_distinct(F.split(norm_key(F.col(text)), " ")).alias("w")).where("id is not null").withColumn("w", F.array_remove("w", "")).where("size(w) > 0").dropDuplicates(["id"])
    tokens = words.select("id", F.size("w").alias("n"), F.explode("w").alias("t"))
    df_ = tokens.groupBy("t").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "t"))  # the words of one text
    rare = tokens.join(df_, "t").withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    hits = rare.select(F.col("id").alias("x"), F.col("n").alias("nx"), "t").join(tokens.select(F.col("id").alias("y"), F.col("n").alias("ny"), "t"), "t").where("x <> y and nx <= ny")
    pairs = hits.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    both = pairs.join(words.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a").join(words.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("wa", "wb")).alias("shared"), F.least(F.size("wa"), F.size("wb")).alias("smaller"))
    return both.where(F.col("shared") >= F.lit(least) * F.col("smaller") - 1e-9)


def best_overlap(df: DataFrame, key: str, texts: dict[str, Column], least: float = 0.72) -> DataFrame:
    """(a, b, best) with a < b: pairs whose word sets share at least `least` of the smaller one in any of `texts`, with the greatest share (see `token_overlap`), six digits. Made for tables where most pairs are results: no pair is shuffled."""
    one = df.select(F.col(key).cast("bigint").alias("id"), *[F.array_distinct(F.split(norm_key(c), " ")).alias(f) for f, c in texts.items()]).where("id is not null").dropDuplicates(["id"])
    words = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.array_remove(F.coalesce(f, F.array().cast("array<string>")), "").alias("w")) for f in texts]))
    tokens = cut(one.select("id", words.alias("t")).select("id", "t.f", F.explode("t.w").alias("word")))
    number = cut(tokens.select("word").distinct().withColumn("item", F.monotonically_increasing_id()))
    items = [F.collect_list(F.when(F.col("f") == f, F.col("item"))).alias(f) for f in texts]  # the words of one text
    return overlapping(tokens.join(shuffled(number), "word").groupBy("id").agg(*items), list(texts), least)


def profile(name: Column) -> Column:
    """Processing profile of a file or title text: index matter, other scripts, or mainline. Null counts as empty."""
    t = F.coalesce(name, F.lit(""))
    low = F.lower(t)
    words = F.filter(F.regexp_extract_all(t, F.lit("([A-Za-z]{3,})"), F.lit(1)), lambda w: ~F.lower(w).isin("pdf", "zot", "doi", "tokens", "s0066", "index"))
    strange = F.regexp_count(t, F.lit(r"[^\x00-\x7F]")) / F.greatest(F.lit(1), F.length(t))
    ladder = F.when(low.rlike("(?:^|[^a-z0-9])subject[\\s_.-]*index(?:$|[^a-z0-9])"), "subject_index").when(low.rlike(r"b97[89][\d.\-]") & low.rlike("(?:^|[^a-z0-9])index(?:$|[^a-z0-9])"), "book_index")
    ladder = ladder.when(t.rlike("[㐀-鿿]"), "cjk_filename").when((strange >= 0.15) & (F.size(words) < 4), "mostly_non_ascii_filename")
    return ladder.when(F.size(words) >= 4, "english_title_tokens").otherwise("no_defer_signal")


def first_of_each(df: DataFrame, hash_of: Column, order: str) -> DataFrame:
    """`status` of each row: kept for the first row of a content hash in `order`, else duplicate; no_full_text where there is no content. A hash that many rows share is settled by one aggregate."""
    h = df.withColumn("_h", hash_of)
    first = h.where("_h is not null").groupBy("_h").agg(F.min(order).alias("_first"))
    j = h.join(first, "_h", "left")
    return j.withColumn("status", F.when(F.col("_h").isNull(), "no_full_text").when(F.col(order) == F.col("_first"), "kept").otherwise("duplicate")).drop("_h", "_first")


def next_id(ids: DataFrame, col: str) -> DataFrame:
    """One row: the next free `S` number."""
    n = F.expr(f"try_cast(regexp_extract(`{col}`, '^S([0-9]+)$', 1) as bigint)")
    return ids.agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next"))


def stale(up: DataFrame, down: DataFrame, key: str, time: str) -> DataFrame:
    """(key, state) of each upstream key: missing, stale (older than its upstream) or fresh."""
    u = up.groupBy(key).agg(F.max(time).alias("u"))
    d = down.groupBy(key).agg(F.max(time).alias("d"))
    return u.where(F.col(key).isNotNull()).join(d, key, "left").select(key, F.when(F.col("d").isNull(), "missing").when(F.col("d") < F.col("u"), "stale").otherwise("fresh").alias("state"))
