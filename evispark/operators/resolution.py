"""Resolving surfaces to entries in bulk: chunks for judging, verdicts, topics, tag enrichment, vocabularies of tags, bootstrap."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.keys import norm_key
from evispark.operators import registry as R
from evispark.session import cut


def pack_chunks(items: DataFrame, most: int = 30, candidates: int = 120) -> DataFrame:
    """(facet, key, chunk): greedy chunks, in order of key, of at most `most` items and `candidates` distinct candidates; an item with more has a chunk alone.

    `items`: facet, key, ids (array of candidate ids). Each facet is a sorted stream: only the open chunk is held, however long the facet is.
    """

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        facet, chunk, n, held = None, 0, 0, set()
        for pdf in frames:
            out = []
            for f, k, ids in zip(pdf["facet"], pdf["key"], pdf["ids"]):
                mine = set(ids) if ids is not None else set()
                if f != facet:
                    facet, chunk, n, held = f, 1, 0, set()
                elif n >= most or len(held | mine) > candidates:
                    chunk, n, held = chunk + 1, 0, set()
                n += 1
                held |= mine
                out.append((f, k, chunk))
            yield pd.DataFrame(out, columns=["facet", "key", "chunk"])

    rows = items.where("facet is not null and key is not null").select("facet", "key", "ids")
    return rows.repartition("facet").sortWithinPartitions("facet", "key").mapInPandas(pack, "facet string, key string, chunk int")


def commit(groups: DataFrame, verdicts: DataFrame, failed: DataFrame, elements: DataFrame, finals: DataFrame) -> DataFrame:
    """(facet, key, surface, state, element_id) of unresolved groups (facet, key, surface, arrival).

    Keys of failed chunks (facet, key) are `skipped` and come again in a later run. A verdict (facet, key, element_id) is `matched` only if its entry exists in the same
    facet, redirects followed; all others are `created`, ids in order of arrival.
    """
    real = verdicts.where("element_id is not null").join(elements.select("element_id", F.col("facet").alias("_f")), "element_id").where("facet = _f").join(finals, "element_id").groupBy("facet", "key").agg(F.max("final").alias("hit"))
    j = cut(groups.join(failed.select("facet", "key").distinct().withColumn("failed", F.lit(True)), ["facet", "key"], "left").join(real, ["facet", "key"], "left"))
    new = R.create_entries(elements, j.where("failed is null and hit is null").select("facet", F.col("surface").alias("display_name"), "arrival"))
    j = j.join(new.select("facet", F.col("display_name").alias("surface"), F.col("element_id").alias("made"), "arrival"), ["facet", "surface", "arrival"], "left")
    state = F.when(F.col("failed"), "skipped").when(F.col("hit").isNotNull(), "matched").otherwise("created")
    return j.select("facet", "key", "surface", state.alias("state"), F.when(state != "skipped", F.coalesce("hit", "made")).alias("element_id"))


def resolve_topics(cards: DataFrame, elements: DataFrame, finals: DataFrame, proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tags, cards): tags (tag, element_id, how) of the whole library, and (paper_id, topic_ids) in the order of each card's tags.

    `cards`: paper_id, domain_tags. A tag is its trimmed lower-case text, the first spelling by paper stands for it. how: `exact` by name or alias of a topic, `proposed`
    where `proposals` (tag, element_id) names an entry of the registry, `created` else. Cards without tags have no row.
    """
    t = cards.select("paper_id", F.posexplode("domain_tags").alias("pos", "raw")).select("paper_id", "pos", F.trim("raw").alias("surface"), F.lower(F.trim("raw")).alias("tag")).where("tag <> ''")
    first = t.groupBy("tag").agg(F.min(F.struct("paper_id", "pos", "surface")).alias("m")).select("tag", "m.surface", F.struct("m.paper_id", "m.pos").alias("arrival"), F.lit("topic").alias("facet"))
    found = R.find(first, elements, finals)
    said = proposals.join(finals, "element_id").groupBy("tag").agg(F.min("final").alias("said"))
    j = cut(found.join(said, "tag", "left"))
    new = R.create_entries(elements, j.where("element_id is null and said is null").select("facet", F.col("surface").alias("display_name"), "arrival"))
    j = j.join(new.select("arrival", F.col("element_id").alias("made")), "arrival", "left")
    tags = cut(j.select("tag", F.coalesce("element_id", "said", "made").alias("element_id"), F.when(F.col("element_id").isNotNull(), "exact").when(F.col("said").isNotNull(), "proposed").otherwise("created").alias("how")))
    placed = t.join(tags, "tag").groupBy("paper_id", "element_id").agg(F.min("pos").alias("pos"))
    ids = placed.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "element_id"))), lambda x: x["element_id"]).alias("topic_ids"))  # one card's tags
    return tags, ids


def import_vocabulary(concepts: DataFrame, elements: DataFrame, finals: DataFrame) -> DataFrame:
    """(canonical, element_id, how, aliased): each concept (canonical, members, arrival) led to a topic by name or created, and how many members became aliases.

    Members equal by norm_key to the entry's name, its aliases or an earlier member add nothing.
    """
    v = concepts.where("canonical <> ''").select(F.lit("topic").alias("facet"), F.col("canonical").alias("surface"), "members", "arrival")
    j = cut(R.find(v, elements, finals))
    new = R.create_entries(elements, j.where("element_id is null").select("facet", F.col("surface").alias("display_name"), "arrival"))
    j = j.join(new.select("arrival", F.col("element_id").alias("made")), "arrival", "left").withColumn("id", F.coalesce("element_id", "made"))
    own = R.names_of(elements).groupBy("element_id").agg(F.collect_set("key").alias("own")).withColumnRenamed("element_id", "id")  # one entry's names
    j = j.join(own, "id", "left").withColumn("own", F.coalesce("own", F.array(norm_key(F.col("surface")))))
    keys = F.array_distinct(F.transform(F.filter("members", lambda m: (m != "") & (m != F.col("surface"))), norm_key))
    how = F.when(F.col("element_id").isNotNull(), "already").otherwise("created")
    return j.select(F.col("surface").alias("canonical"), F.col("id").alias("element_id"), how.alias("how"), F.size(F.array_except(keys, "own")).alias("aliased"))


def enriched_tags(tags: Column, more: Column, most: int = 9) -> Column:
    """Tags with further ones appended, equal ones by lower case left out, up to `most` in all; existing ones are kept in full. Null lists count as empty."""
    empty = F.array().cast("array<string>")
    tags, more = F.coalesce(tags, empty), F.transform(F.coalesce(more, empty), lambda x: F.trim(x))
    low = F.transform(tags, lambda x: F.lower(F.trim(x)))
    fresh = F.filter(more, lambda x: x.isNotNull() & (x != "") & ~F.coalesce(F.array_contains(low, F.lower(x)), F.lit(False)))
    once = F.filter(fresh, lambda x, i: F.array_position(F.transform(fresh, lambda y: F.lower(y)), F.lower(x)) == i + 1)
    return F.concat(tags, F.slice(once, 1, F.greatest(F.lit(0), F.lit(most) - F.size(tags))))


def tag_counts(cards: DataFrame, facets: list[str]) -> DataFrame:
    """(facet, tag, cards): trimmed lower-case tags of each facet's array with the cards that hold them."""
    parts = [cards.select("paper_id", F.lit(f).alias("facet"), F.explode(f).alias("v")) for f in facets]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    return every.select("paper_id", "facet", F.lower(F.trim("v")).alias("tag")).where("tag <> ''").distinct().groupBy("facet", "tag").agg(F.count("*").alias("cards"))


def tag_vocabulary(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(facet, tag, canonical, cards, dropped): each tag led to one concept.

    `groups`: facet, canonical, members, ordinal, as proposed; they may overlap. The group with more members, then with more cards, then the earlier one takes a tag. A tag in no group
    is its own concept (dropped).
    """
    m = groups.select("facet", F.lower(F.trim("canonical")).alias("canonical"), F.array_distinct(F.filter(F.transform("members", lambda x: F.lower(F.trim(x))), lambda x: x != "")).alias("members"), "ordinal").where("canonical <> '' and size(members) > 0")
    each = m.select("facet", "canonical", "ordinal", F.size("members").alias("size"), F.explode("members").alias("tag")).join(counts, ["facet", "tag"], "left")
    weight = each.groupBy("facet", "ordinal").agg(F.sum(F.coalesce("cards", F.lit(0))).alias("weight"))
    best = each.join(weight, ["facet", "ordinal"]).groupBy("facet", "tag").agg(F.min_by("canonical", F.struct((-F.col("size")).alias("s"), (-F.col("weight")).alias("w"), "ordinal")).alias("canonical"))
    j = counts.join(best, ["facet", "tag"], "left")
    return j.select("facet", "tag", F.coalesce("canonical", "tag").alias("canonical"), "cards", F.col("canonical").isNull().alias("dropped"))


def bootstrap(surfaces: DataFrame, groups: DataFrame, elements: DataFrame, finals: DataFrame, chunk: int = 150) -> tuple[DataFrame, DataFrame]:
    """(chunks, entries) of a first run over `surfaces` (facet, surface, n) with the proposed `groups` (facet, canonical, members).

    chunks: facet, surface, chunk - surfaces by count, `chunk` at a time. entries: facet, key, display_name, how (`found`, `created`, `leftover`), members. The first 8
    members of a group become aliases of its canonical name; surfaces that no entry has afterwards become entries of their own, one per norm_key.
    All groups are settled before the leftovers.
    """
    order = Window.partitionBy("facet").orderBy(F.desc("n"), "surface")
    numbered = surfaces.select("facet", "surface", (F.floor((F.row_number().over(order) - 1) / chunk) + 1).cast("int").alias("chunk"))
    g = groups.select("facet", F.trim("canonical").alias("surface"), F.slice(F.filter(F.transform("members", lambda m: F.trim(m)), lambda m: m != ""), 1, 8).alias("members")).where("surface <> '' and size(members) > 0")
    g = R.find(g, elements, finals).withColumn("key", norm_key(F.col("surface")))
    named = g.groupBy("facet", "key").agg(F.min("surface").alias("display_name"), F.max("element_id").alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("members"))  # groups of one name
    held = named.select("facet", F.explode("members").alias("m")).select("facet", norm_key(F.col("m")).alias("key")).unionAll(named.select("facet", "key")).distinct()
    rest = R.find(surfaces, elements, finals).where("element_id is null").withColumn("key", norm_key(F.col("surface"))).join(held, ["facet", "key"], "left_anti")
    left = rest.groupBy("facet", "key").agg(F.min_by("surface", F.struct((-F.col("n")).alias("n"), "surface")).alias("display_name"))
    a = named.select("facet", "key", "display_name", F.when(F.col("hit").isNotNull(), "found").otherwise("created").alias("how"), F.size("members").alias("members"))
    return numbered, a.unionAll(left.select("facet", "key", "display_name", F.lit("leftover").alias("how"), F.lit(0).alias("members")))
