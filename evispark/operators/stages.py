"""Stages of the pipeline: what each paper needs next, language gate, summaries, work selection, cache hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Stages in order.
STAGES = ["clean", "sections", "reading", "card", "elements", "card_tags"]


def next_stage(papers: DataFrame, done: DataFrame, failed: DataFrame, deferred: DataFrame) -> DataFrame:
    """(paper_id, next, state): the first stage in order without output (done: paper_id, stage), unless one before it has failed (failed: paper_id, stage) or the language gate holds the paper after the first stage (deferred: paper_id).

    state: `complete`, `failed`, `deferred` or `pending`; next is null for all but `pending` and `failed`.
    """
    have = done.where(F.col("stage").isin(STAGES)).groupBy("paper_id").agg(F.collect_set("stage").alias("have"))  # six stages
    bad = failed.groupBy("paper_id").agg(F.collect_set("stage").alias("bad"))
    j = papers.select("paper_id").join(have, "paper_id", "left").join(bad, "paper_id", "left").join(deferred.select("paper_id", F.lit(True).alias("held")).dropDuplicates(["paper_id"]), "paper_id", "left")
    empty = F.array().cast("array<string>")
    todo = F.try_element_at(F.array_except(F.array(*map(F.lit, STAGES)), F.coalesce("have", empty)), F.lit(1))
    j = j.withColumn("todo", todo)
    state = F.when(F.col("todo").isNull(), "complete").when(F.array_contains(F.coalesce("bad", empty), F.col("todo")), "failed").when(F.col("held") & (F.col("todo") != STAGES[0]), "deferred").otherwise("pending")
    return j.select("paper_id", F.when(state.isin("pending", "failed"), F.col("todo")).alias("next"), state.alias("state"))


def run_summary(completed: DataFrame, failed: DataFrame) -> DataFrame:
    """(paper_id): papers to validate: completed and without any failure."""
    return completed.select("paper_id").distinct().join(failed.select("paper_id").distinct(), "paper_id", "left_anti")


def select_work(manifest: DataFrame, ids: list[str] | None = None, everything: bool = False, duplicates: bool = False, deferred: bool = False) -> DataFrame:
    """(paper_id, state) of the papers asked for: by id, case aside (missing where unknown), or all active and deferred ones.

    state: `selected`, `deferred` (left out unless asked for; not tested for ids), `possible_duplicate` (left out unless asked for), `missing`. Neither ids nor all: no rows. `manifest`: paper_id, status, deferred, possible_duplicate_of (array).
    """
    dup = F.coalesce(F.size("possible_duplicate_of"), F.lit(0)) > 0
    twice = dup & F.lit(not duplicates)
    if ids:
        wanted = manifest.sparkSession.createDataFrame([(i.upper(),) for i in dict.fromkeys(ids)], "id string")
        j = wanted.join(manifest.withColumn("id", F.upper("paper_id")), "id", "left")
        return j.select(F.coalesce("paper_id", "id").alias("paper_id"), F.when(F.col("paper_id").isNull(), "missing").when(twice, "possible_duplicate").otherwise("selected").alias("state"))
    if not everything:
        return manifest.limit(0).select("paper_id", F.lit("").alias("state"))
    held = (F.coalesce("deferred", F.lit(False)) | (F.col("status") == "deferred")) & F.lit(not deferred)
    return manifest.where("status in ('active', 'deferred')").select("paper_id", F.when(held, "deferred").when(twice, "possible_duplicate").otherwise("selected").alias("state"))


def cache_hits(runs: DataFrame, cached: DataFrame, outputs: DataFrame) -> DataFrame:
    """(paper_id, stage, hit): a run (paper_id, stage, fingerprint, needs: array) is a hit if its cached fingerprint (paper_id, stage, fingerprint) is the same and all outputs it needs (outputs: paper_id, name) are there."""
    have = outputs.groupBy("paper_id").agg(F.collect_set("name").alias("have"))  # one paper's outputs
    c = cached.groupBy("paper_id", "stage").agg(F.max("fingerprint").alias("was"))
    j = runs.join(c, ["paper_id", "stage"], "left").join(have, "paper_id", "left")
    there = F.size(F.array_except("needs", F.coalesce("have", F.array().cast("array<string>")))) == 0
    return j.select("paper_id", "stage", (F.coalesce(F.col("was") == F.col("fingerprint"), F.lit(False)) & there).alias("hit"))
