"""The registry of canonical elements: lookup, shortlists, duplicates, coverage, derived tags and vocabularies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.keys import dedupe_key, element_id, norm_key
from evispark.operators.components import connected_components
from evispark.session import cut


def aliases(elements: DataFrame) -> DataFrame:
    """(element_id, facet, name, key, canonical): display names and aliases with their norm_key; empty keys left out. Broken alias lists count as empty."""
    a = F.coalesce(F.from_json("aliases_json", "array<string>"), F.array().cast("array<string>"))
    named = elements.select("element_id", "facet", F.explode(F.concat(F.array(F.struct(F.col("display_name").alias("name"), F.lit(True).alias("canonical"))), F.transform(a, lambda x: F.struct(x.alias("name"), F.lit(False).alias("canonical"))))).alias("x"))
    return named.select("element_id", "facet", "x.name", norm_key(F.col("x.name")).alias("key"), "x.canonical").where("key <> ''")


def lookup(values: DataFrame, elements: DataFrame) -> DataFrame:
    """(facet, surface, element_id): exact match of norm_key on display name or alias in the same facet, the least id where several match; null if none."""
    best = aliases(elements).groupBy("facet", "key").agg(F.min("element_id").alias("element_id"))
    return values.withColumn("key", norm_key(F.col("surface"))).join(best, ["facet", "key"], "left").drop("key")


def unresolved(values: DataFrame, elements: DataFrame) -> DataFrame:
    """(facet, key, first_surface, occurrences) of the values that have no entry: an id that is absent from the registry counts as none (dangling), then `lookup` is tried.

    `values`: facet, surface, element_id and position (arrival, comparable); the first surface to arrive stands for its key.
    """
    known = elements.select(F.col("element_id").alias("known")).distinct()
    v = values.join(known, F.col("element_id") == F.col("known"), "left").where("known is null").select("facet", "surface", "position")
    miss = lookup(v, elements).where("element_id is null").withColumn("key", norm_key(F.col("surface")))
    return miss.where("facet is not null and key is not null").groupBy("facet", "key").agg(F.min_by("surface", F.struct("position", "surface")).alias("first_surface"), F.count("*").alias("occurrences"))


def shortlist(keys: DataFrame, elements: DataFrame, k: int = 8) -> DataFrame:
    """(facet, key, element_id, overlap, rank): entries of the facet by the greatest word overlap of any of their names with the key."""
    words = lambda c: F.array_distinct(F.split(c, " "))
    mine = keys.select("facet", "key", F.explode(words("key")).alias("t"))
    names = aliases(elements).select("element_id", "facet", F.col("key").alias("name_key")).distinct().select("*", F.explode(words("name_key")).alias("t"))
    hits = mine.join(names, ["facet", "t"]).groupBy("facet", "key", "element_id", "name_key").agg(F.count("*").alias("n"))
    best = hits.groupBy("facet", "key", "element_id").agg(F.max("n").alias("overlap"))
    named = best.join(elements.select("element_id", "display_name"), "element_id")
    rank = F.row_number().over(Window.partitionBy("facet", "key").orderBy(F.desc("overlap"), "display_name", "element_id"))
    return named.withColumn("rank", rank).where(F.col("rank") <= k)


def duplicates(elements: DataFrame) -> DataFrame:
    """(facet, dkey, target, sources, kept): entries with one dedupe_key, redirected ones left out.

    The target is locked first, then a seed, then has most aliases, then the least id. Locked entries are never a source: `kept` counts those left to people.
    `elements`: element_id, facet, display_name, aliases (array), origin, human_locked, redirect_to.
    """
    n = F.coalesce(F.size("aliases"), F.lit(0))
    e = elements.where("redirect_to is null").select("element_id", "facet", dedupe_key(F.col("display_name")).alias("dkey"), F.coalesce("human_locked", F.lit(0)).alias("locked"), (F.coalesce("origin", F.lit("")) == "seed").alias("seed"), n.alias("n"))
    g = e.groupBy("facet", "dkey").agg(F.count("*").alias("size"), F.min_by("element_id", F.struct((-F.col("locked")).alias("l"), (~F.col("seed")).alias("s"), (-F.col("n")).alias("n"), "element_id")).alias("target")).where("size > 1")
    m = e.join(g, ["facet", "dkey"]).where("element_id <> target")
    free = F.when(F.col("locked") == 0, F.col("element_id"))
    return m.groupBy("facet", "dkey", "target").agg(F.array_join(F.array_sort(F.collect_set(free)), ",").alias("sources"), F.sum((F.col("locked") != 0).cast("int")).alias("kept"))


def merge_duplicates(elements: DataFrame) -> DataFrame:
    """The registry with the sources of `duplicates` redirected to their targets."""
    d = duplicates(elements).select(F.explode(F.split("sources", ",")).alias("element_id"), F.col("target").alias("_to")).where("element_id <> ''")
    return elements.join(d, "element_id", "left").withColumn("redirect_to", F.coalesce("_to", "redirect_to")).drop("_to")


def from_seeds(seeds: DataFrame) -> DataFrame:
    """Registry of seed families (facet, canonical, aliases, ordinal): aliases equal to their canonical name by norm_key are left out; of families with one id the last counts."""
    keep = F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: norm_key(a) != norm_key(F.col("canonical")))
    e = seeds.select(element_id(F.col("facet"), F.col("canonical")).alias("element_id"), "facet", F.col("canonical").alias("display_name"), keep.alias("aliases"), "ordinal")
    last = e.groupBy("element_id").agg(F.max_by(F.struct("facet", "display_name", "aliases"), "ordinal").alias("e"), F.min("ordinal").alias("ordinal"))
    return last.select("element_id", "e.*", F.lit(None).cast("string").alias("redirect_to"), F.lit("seed").alias("origin"), F.lit(0).alias("human_locked"), "ordinal")


def resolve_redirects(elements: DataFrame, rounds: int = 64) -> DataFrame:
    """(element_id, final): redirects (redirect_to) followed to their end. An id outside the registry ends a chain; a circle ends at the id by which it is entered.

    Each round moves only the chains that are still open, so the cost follows the longest chain; more than `rounds` steps raise an error.
    """
    step = cut(elements.where("redirect_to is not null").select(F.col("element_id").alias("at"), F.col("redirect_to").alias("next")))
    open_ = step.select(F.col("at").alias("element_id"), F.col("next").alias("at"), F.array("at").alias("path"))
    done = elements.where("redirect_to is null").select("element_id", F.col("element_id").alias("final"))
    for _ in range(rounds):
        j = open_.join(step, "at", "left").withColumn("end", F.col("next").isNull() | F.array_contains("path", F.col("at")))
        j = cut(j)
        done = done.unionAll(j.where("end").select("element_id", F.col("at").alias("final")))
        open_ = j.where("not end").select("element_id", F.col("next").alias("at"), F.concat("path", F.array("at")).alias("path"))
        if open_.isEmpty():
            return done
    raise ValueError(f"a redirect chain of more than {rounds} steps")


def find(values: DataFrame, elements: DataFrame, finals: DataFrame) -> DataFrame:
    """`values` (facet, surface, ...) with `element_id`: the first entry of the facet, in order of `ordinal`, with that norm_key as name or alias, redirects followed; null if none."""
    best = names_of(elements).groupBy("facet", "key").agg(F.min_by("element_id", "ordinal").alias("hit")).join(finals.withColumnRenamed("element_id", "hit"), "hit").select("facet", "key", F.col("final").alias("element_id"))
    return values.withColumn("key", norm_key(F.col("surface"))).join(best, ["facet", "key"], "left").drop("key")


def names_of(elements: DataFrame) -> DataFrame:
    """(element_id, facet, ordinal, key): norm_keys of display name and aliases (array) of each entry; empty keys left out."""
    every = F.concat(F.array("display_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return elements.select("element_id", "facet", "ordinal", F.explode(F.array_distinct(F.transform(every, norm_key))).alias("key")).where("key <> ''")


def create_entries(elements: DataFrame, new: DataFrame) -> DataFrame:
    """(element_id, facet, display_name, arrival) of new entries (facet, display_name, arrival: comparable, unique per facet and base id).

    An id that is taken gets `-2`, `-3` and so on in order of arrival, over the numbers the registry already has. Where a new name's own slug ends in a number
    that another needs, the later arrival moves on to its next free number in a further round.
    """
    base = element_id(F.col("facet"), F.col("display_name"))
    n = new.select("facet", "display_name", "arrival", base.alias("base"))
    taken = elements.select(F.col("element_id").alias("id"))
    wanted = n.select("base").distinct()
    own = taken.select(F.col("id").alias("base"), F.lit(1).alias("k")).join(wanted, "base", "left_semi")
    later = taken.select(F.regexp_replace("id", "-[0-9]+$", "").alias("base"), F.expr("try_cast(regexp_extract(id, '-([0-9]+)$', 1) as int)").alias("k")).where("k > 1").join(wanted, "base", "left_semi")
    used = own.unionAll(later).groupBy("base").agg(F.collect_set("k").alias("used"))  # the numbers of one name
    w = Window.partitionBy("base").orderBy("arrival")
    ranked = n.join(used, "base", "left").withColumn("used", F.coalesce("used", F.array().cast("array<int>"))).withColumn("r", F.row_number().over(w))
    free = F.array_except(F.sequence(F.lit(1), F.col("r") + F.size("used")), F.col("used"))
    ranked = ranked.withColumn("k", F.element_at(free, F.col("r")))
    out = cut(ranked.select(F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), "k")).alias("element_id"), "facet", "display_name", "arrival", "base"))
    twice = out.groupBy("element_id").agg(F.count("*").alias("c"), F.min("arrival").alias("first")).where("c > 1")
    clash = cut(out.join(twice, "element_id").where("arrival > first").select("base", "arrival"))
    if clash.isEmpty():
        return out.drop("base")
    settled = cut(out.join(clash, ["base", "arrival"], "left_anti").select("element_id", "facet", "display_name", "arrival"))
    rest = n.join(clash, ["base", "arrival"], "left_semi").select("facet", "display_name", "arrival")
    return settled.unionByName(create_entries(taken.select(F.col("id").alias("element_id")).unionAll(settled.select("element_id")), rest))


EVENT_RESULT = "element_id string, display_name string, aliases array<string>, redirect_to string, human_locked int"


def fold_events(elements: DataFrame, events: DataFrame) -> DataFrame:
    """(element_id, display_name, aliases, redirect_to, human_locked) after the log `events`: seq, event, element_id, detail, source.

    alias: added unless equal by norm_key to the name or an alias. rename: the old name becomes an alias, the entry is locked; nothing if equal. merge: redirect to
    the target as it resolves at that moment; a person's merge locks the target; a merge into itself or an unknown entry changes nothing. Events of
    unknown entries are left out. Only entries joined by merges act on each other, so each component of the merge graph is folded on its own. An entry never loses
    a key, so of the aliases of one key only the first changes anything and the rest are left out before.
    """
    merges = events.where("event = 'merge' and element_id is not null and detail is not null").select(F.col("element_id").alias("a"), F.col("detail").alias("b"))
    redirected = elements.where("redirect_to is not null").select(F.col("element_id").alias("a"), F.col("redirect_to").alias("b"))
    comp = connected_components(merges.unionAll(redirected).distinct(), "a", "b").select(F.col("node").alias("element_id"), F.col("component").cast("string").alias("component"))
    e = elements.join(comp, "element_id", "left").withColumn("component", F.coalesce("component", "element_id"))
    state = e.select("component", "element_id", "display_name", "aliases", "redirect_to", F.coalesce("human_locked", F.lit(0)).alias("human_locked"), F.lit(-1).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("event"), F.lit(None).cast("string").alias("detail"), F.lit(None).cast("string").alias("source"))
    none = lambda t: F.lit(None).cast(t)
    alias = events.where("event = 'alias'").withColumn("_key", F.coalesce(norm_key(F.col("detail")), F.lit("")))
    firsts = alias.groupBy("element_id", "_key").agg(F.min_by(F.struct("detail", "source", "seq"), F.coalesce("seq", F.lit(2**63 - 1))).alias("x")).select("x.seq", F.lit("alias").alias("event"), "element_id", "x.detail", "x.source")
    events = events.where("event <> 'alias'").select("seq", "event", "element_id", "detail", "source").unionByName(firsts)
    log = events.join(e.select("element_id", "component"), "element_id").select("component", "element_id", none("string").alias("display_name"), none("array<string>").alias("aliases"), none("string").alias("redirect_to"), none("int").alias("human_locked"), F.col("seq").cast("bigint"), "event", "detail", "source")
    key = lambda s: " ".join("".join(ch if ch in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for ch in (s or "").lower()).split())

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: dict[str, list] = {}
        keys: dict[str, set[str]] = {}
        now = None
        rows = lambda: pd.DataFrame([(i, *v) for i, v in at.items()], columns=["element_id", "display_name", "aliases", "redirect_to", "human_locked"])
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if r.component != now:
                    if len(at) > 1_000:
                        yield rows()
                        at, keys = {}, {}
                    now = r.component
                if r.event is None:
                    at[r.element_id] = [r.display_name, list(r.aliases) if r.aliases is not None else [], r.redirect_to, int(r.human_locked)]
                    keys[r.element_id] = {key(r.display_name), *map(key, at[r.element_id][1])}
                    continue
                mine, known = at[r.element_id], keys[r.element_id]
                if r.event == "alias" and key(r.detail) not in known:
                    mine[1].append(r.detail)
                    known.add(key(r.detail))
                elif r.event == "rename" and key(r.detail) != key(mine[0]):
                    if key(mine[0]) not in set(map(key, mine[1])):
                        mine[1].append(mine[0])
                    mine[0], mine[3] = r.detail, 1
                    known.add(key(r.detail))
                elif r.event == "merge" and r.detail in at:
                    to, seen = r.detail, set()
                    while to in at and at[to][2] and to not in seen:
                        seen.add(to)
                        to = at[to][2]
                    if to != r.element_id:
                        mine[2] = to
                        if r.source == "human" and to in at:
                            at[to][3] = 1
        yield rows()

    tasks = int(elements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return state.unionByName(log).repartition(tasks, "component").sortWithinPartitions("component", F.col("event").isNotNull(), F.asc_nulls_last("seq")).mapInPandas(fold, EVENT_RESULT)


def derived_tags(rows: DataFrame, elements: DataFrame, kinds: dict[str, list[str]], limits: dict[str, int]) -> DataFrame:
    """(paper_id, kind, rank, tag, n, in_finding): tags of a paper by kind, grouped by display name.

    Order: entries whose name or an alias stands as whole words in one of the paper's findings, then count, then seeds, then name. The entry of a name is
    the one met first in the paper (least id). `elements` has `origin`; rows are used by role, findings by any.
    """
    kind = F.lit(None).cast("string")
    for k, facets in kinds.items():
        kind = F.when(F.col("facet").isin(facets), k).otherwise(kind)
    used = rows.where("role = 'used'").join(elements.select("element_id", "facet", "display_name", "origin"), "element_id").withColumn("kind", kind).where("kind is not null")
    n = used.groupBy("paper_id", "kind", "display_name").agg(F.count("*").alias("n"), F.min_by(F.struct("element_id", "origin"), "element_id").alias("e"))
    n = n.select("paper_id", "kind", "display_name", "n", F.col("e.element_id").alias("element_id"), (F.col("e.origin") == "seed").alias("seed"))
    findings = rows.where("occ_facet = 'finding' and surface is not null").groupBy("paper_id").agg(F.concat(F.lit(" "), F.array_join(F.array_sort(F.collect_set(norm_key(F.col("surface")))), " "), F.lit(" ")).alias("text"))  # one paper's findings
    names = aliases(elements).groupBy("element_id").agg(F.collect_set("key").alias("keys"))  # one entry's names
    j = n.join(findings, "paper_id", "left").join(names, "element_id", "left")
    j = j.withColumn("in_finding", F.coalesce(F.exists("keys", lambda k: F.col("text").contains(F.concat(F.lit(" "), k, F.lit(" ")))), F.lit(False)))
    ranked = j.withColumn("rank", F.row_number().over(Window.partitionBy("paper_id", "kind").orderBy(F.desc("in_finding"), F.desc("n"), F.desc("seed"), "display_name")))
    most = F.lit(0)
    for k, m in limits.items():
        most = F.when(F.col("kind") == k, m).otherwise(most)
    return ranked.where(F.col("rank") <= most).select("paper_id", "kind", "rank", F.col("display_name").alias("tag"), "n", "in_finding")


def vocabulary(elements: DataFrame, facets: dict[str, list[str]]) -> DataFrame:
    """(out_facet, member, canonical, collisions): lower-case members led to their first canonical name, locked entries first, then by name."""
    out = F.lit(None).cast("string")
    for k, fs in facets.items():
        out = F.when(F.col("facet").isin(fs), k).otherwise(out)
    m = aliases(elements).join(elements.select("element_id", "display_name", F.coalesce("human_locked", F.lit(0)).alias("locked")), "element_id")
    m = m.withColumn("out_facet", out).where("out_facet is not null").select("out_facet", F.lower(F.trim("name")).alias("member"), "display_name", "locked", "element_id")
    w = Window.partitionBy("out_facet", "member")
    first = F.first("display_name").over(w.orderBy(F.desc("locked"), "display_name", "element_id"))
    return m.withColumn("canonical", first).groupBy("out_facet", "member", "canonical").agg((F.countDistinct("display_name") - 1).alias("collisions"))
