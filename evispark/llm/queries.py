"""The pN_ queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.llm import canonical, cooccurrence, leakage, matching, names, packing, scans, setjoin, subjects
from evispark.llm.common import trimmed_lower
from evispark.session import cut, shuffled
from evispark.tables import latest, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Each matching citation and article with its confidence."""
    fields = ["title", "doi", "year", "journal", "authors"]
    cit = latest(table(spark, sf, "citations"), ["citation_id"], "harvested_at", fields)
    art = latest(table(spark, sf, "articles"), ["article_id"], "exported_at", fields)
    return matching.match_works(cit, art, "citation_id", "article_id")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_matches(spark, sf).select("citation_id", "article_id")


def _names(spark: SparkSession, sf: str) -> DataFrame:
    lists = [table(spark, sf, t).select(F.explode("authors").alias("name")) for t in ("authors", "articles")]
    return names.entities(lists[0].unionAll(lists[1]))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.variant_pairs(_names(spark, sf))


def p2_entities(spark: SparkSession, sf: str) -> DataFrame:
    """One row per spelling with its entity and the number of spellings that entity has."""
    named = _names(spark, sf)
    return named.join(named.groupBy("entity").agg(F.count("*").alias("spellings")), "entity").select("name", "entity", "spellings")


def _p3(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    occ = table(spark, sf, "occurrences").where("element_id is null and occ_id is not null")
    typed = F.struct(F.coalesce("facet", F.lit("")).alias("facet"), F.coalesce("surface", F.lit("")).alias("surface"))
    rows = occ.groupBy("occ_id").agg(F.max_by(typed, "loaded_at").alias("v")).select("occ_id", "v.*")
    return rows, canonical.map_values(occ.select("facet", "surface").where("facet is not null and surface is not null"), table(spark, sf, "elements"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    rows, mapped = _p3(spark, sf)
    return rows.join(mapped, ["facet", "surface"], "left").select("occ_id", F.coalesce("element_id", F.lit(canonical.UNMATCHED)).alias("element_id"))


def p3_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """The values without an entry and the number of rows that hold each."""
    rows, mapped = _p3(spark, sf)
    counts = rows.groupBy("facet", "surface").agg(F.count("*").alias("rows"))
    return counts.join(mapped.where(F.col("element_id") != canonical.UNMATCHED), ["facet", "surface"], "left_anti")


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    fields = ["paper_id", "section_title", "text", "page_start", "page_end"]
    rows = latest(table(spark, sf, "reading_blocks"), ["reading_block_id"], "loaded_at", fields).where("reading_block_id is not null")
    return rows.toDF("id", "paper", "title", "text", "first", "last")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    _, items = scans.repairs(_blocks(spark, sf))
    return items.select(F.col("id").alias("reading_block_id"), "field", "kind", "item").distinct()


def p5_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Title and text of each block as continuous readable paragraphs."""
    return scans.repaired(*scans.repairs(_blocks(spark, sf))).withColumnRenamed("id", "reading_block_id")


def _p6(spark: SparkSession, sf: str) -> DataFrame:
    occ = table(spark, sf, "occurrences").where(trimmed_lower(F.col("role")) == "used")
    rows = occ.select(F.col("paper_id").alias("basket"), F.col("element_id").alias("item"))
    return cooccurrence.cooccurring_pairs(rows, table(spark, sf, "elements").select(F.col("element_id").alias("item")))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p6(spark, sf).select(F.col("item_a").alias("element_a"), F.col("item_b").alias("element_b"))


def p6_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _p6(spark, sf).select(F.col("item_a").alias("element_a"), F.col("item_b").alias("element_b"), "n", "n_a", "n_b", "n_ab", F.round("lift", 6).alias("lift"), F.round("conviction", 6).alias("conviction"))


_P6 = r"""
with used as (select distinct paper_id, o.element_id from occurrences o join (select distinct element_id from elements) e on o.element_id = e.element_id
              where lower(regexp_replace(role, '^\s+|\s+$', '', 'g')) = 'used' and paper_id is not null),
 total as (select count(distinct paper_id) n from used), c as (select element_id, count(*) c from used group by 1),
 ab as (select a.element_id element_a, b.element_id element_b, count(*) n_ab from used a join used b on a.paper_id = b.paper_id and a.element_id < b.element_id group by 1, 2),
 hit as (select element_a, element_b, n, x.c n_a, y.c n_b, n_ab from ab join c x on x.element_id = element_a join c y on y.element_id = element_b, total
         where n_ab >= 5 and n_ab * n >= 4 * x.c * y.c)
"""


def _papers(spark: SparkSession, sf: str) -> DataFrame:
    arrays = ["domain_tags", "methods", "research_objects"]
    rows = latest(table(spark, sf, "papers"), ["paper_id"], "loaded_at", arrays).where("paper_id is not null")
    return setjoin.tag_sets(rows, "paper_id", arrays).where("size(tags) > 1")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    membership, links = setjoin.similar_classes(_papers(spark, sf), "paper_id")
    return setjoin.expand(membership, links, "paper_id").toDF("paper_a", "paper_b")


def p7_links(spark: SparkSession, sf: str) -> DataFrame:
    """One row per paper with a tag set of 2 or more: its class and the number of other classes it is similar to."""
    membership, links = setjoin.similar_classes(_papers(spark, sf), "paper_id")
    ends = links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    first = membership.groupBy("cls").agg(F.min("paper_id").alias("class_id"), F.count("*").alias("class_size"))
    out = membership.join(shuffled(first), "cls").join(shuffled(ends), "cls", "left")
    return out.select("paper_id", "class_id", "class_size", F.coalesce("links", F.lit(0)).alias("links"))


_TAGS = r"""
with last as (select paper_id, arg_max(struct_pack(d := domain_tags, m := methods, r := research_objects), loaded_at) x from papers where paper_id is not null group by 1),
 t as (select distinct paper_id, trim(regexp_replace(lower(v), '[^a-z0-9]+', ' ', 'g')) tag from last,
        unnest(list_concat(coalesce(x.d, []), coalesce(x.m, []), coalesce(x.r, []))) u(v) where v is not null),
 tags as (select * from t where tag <> ''), n as (select paper_id, count(*) n from tags group by 1 having count(*) > 1),
 shared as (select a.paper_id pa, b.paper_id pb, count(*) s from tags a join tags b on a.tag = b.tag and a.paper_id < b.paper_id group by 1, 2),
 hit as (select pa, pb from shared join n x on x.paper_id = pa join n y on y.paper_id = pb where s >= 0.6 * (x.n + y.n - s))
"""

CAPACITY = 2048
#: Folder of the public tokenizers' files.
TOKENIZERS = "/opt/tokenizers"


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, "doc_id")
    return packing.pack(packing.token_counts(docs, "doc_id", "text", TOKENIZERS), CAPACITY)


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    """The container of each piece of each text, in containers of CAPACITY tokens."""
    return _packed(spark, sf).select(F.col("key").alias("doc_id"), "piece", "start", "size", "container")


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers are, and how many pieces stand in fitted patterns."""
    return packing.fill(_packed(spark, sf), CAPACITY)


def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Each affected document and item with the share of the item found and whether its answer stands near."""
    docs = table(spark, sf, "documents").select("doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, "doc_id")
    return leakage.leaks(docs, table(spark, sf, "eval_items"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_leaks(spark, sf).select("doc_id", "item_id")


def p10_subjects(spark: SparkSession, sf: str) -> DataFrame:
    """Each document and subject with its probability."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source", "section_kind")
    return subjects.assign(docs, table(spark, sf, "doc_labels"), table(spark, sf, "subject_areas"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_subjects(spark, sf).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Documents per subject and their share of all documents that have one."""
    found = cut(p10_found(spark, sf))
    total = found.select("doc_id").distinct().count()
    return found.groupBy("subject").agg(F.count("*").alias("documents")).withColumn("share", F.col("documents") / F.lit(max(1, total)))


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_matches": p1_matches, "p2_found": p2_found, "p2_entities": p2_entities, "p3_found": p3_found, "p3_unmatched": p3_unmatched, "p5_found": p5_found, "p5_repaired": p5_repaired, "p6_found": p6_found, "p6_pairs": p6_pairs, "p7_found": p7_found, "p7_links": p7_links, "p8_pack": p8_pack, "p8_fill": p8_fill, "p9_found": p9_found, "p9_leaks": p9_leaks, "p10_found": p10_found, "p10_subjects": p10_subjects, "p10_composition": p10_composition}
SQL: dict[str, str] = {
    "p6_found": _P6 + "select element_a, element_b from hit",
    "p6_pairs": _P6 + """select element_a, element_b, n, n_a, n_b, n_ab, round(n_ab * n / (n_a * n_b), 6) lift,
        round(case when n_ab < n_a then (1 - n_b / n) / (1 - n_ab / n_a) end, 6) conviction from hit""",
    "p7_found": _TAGS + "select pa paper_a, pb paper_b from hit",
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
