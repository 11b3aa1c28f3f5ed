"""Structured documents, external libraries, remote records, figures and sinks."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = "path string, pos int, kind string, idx int, label string, layer string, page int, text string, caption string"


def _walk(doc: dict) -> list[tuple[str, int, dict]]:
    """(kind, index, item) of a document's body in reading order: groups are opened in place, every item and group once; references to nothing are left out."""
    seen: set[str] = set()
    stack, out = [c.get("$ref") for c in reversed((doc.get("body") or {}).get("children") or []) if isinstance(c, dict)], []
    while stack:
        ref = stack.pop()
        m = re.fullmatch(r"#/(texts|pictures|tables|groups)/(\d+)", ref or "")
        held = (doc.get(m[1]) or []) if m else []
        if not m or ref in seen or int(m[2]) >= len(held):
            continue
        seen.add(ref)
        item = held[int(m[2])]
        if m[1] == "groups":
            stack += [c.get("$ref") for c in reversed(item.get("children") or []) if isinstance(c, dict)]
        else:
            out.append((m[1], int(m[2]), item))
    return out


def read_items(spark: SparkSession, pattern: str) -> DataFrame:
    """Document items of the JSON files of `pattern` in body order: path, pos, kind, idx, label, layer, page, text, caption. Broken files and files that hold no object have no rows; captions are the texts that an item refers to, joined by blanks."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for path, value in zip(pdf["path"], pdf["value"]):
                try:
                    doc = json.loads(value)
                except ValueError:
                    continue
                if not isinstance(doc, dict):
                    continue
                said = lambda x: (x.get("text") or x.get("orig") or "").strip()
                for pos, (kind, idx, item) in enumerate(_walk(doc)):
                    refs = [re.fullmatch(r"#/texts/(\d+)", c.get("$ref") or "") for c in item.get("captions") or [] if isinstance(c, dict)]
                    texts = [said(doc["texts"][int(m[1])]) for m in refs if m and int(m[1]) < len(doc.get("texts") or [])]
                    page = next((p.get("page_no") for p in item.get("prov") or [] if isinstance(p, dict)), None)
                    out.append((path, pos, kind, idx, item.get("label"), item.get("content_layer"), page, said(item), " ".join(t for t in texts if t)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ITEMS.split(", ")]).astype({"page": "Int32"})

    files = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInPandas(read, ITEMS)


def attachments(items: DataFrame, attached: DataFrame, values: DataFrame, fields: list[str]) -> DataFrame:
    """Attachments of an external reference manager: (item, key, path, parent, parent_count, and one column per field of the parent).

    `items`: item, key; `attached`: item, parent, path (kept where it names a PDF); `values`: item, field, value (of repeated fields the least). Attachments without a parent keep null fields.
    """
    pdf = attached.where(F.lower(F.coalesce("path", F.lit(""))).contains(".pdf"))
    n = attached.where("parent is not null").groupBy("parent").agg(F.count("*").alias("parent_count"))
    wide = values.where(F.col("field").isin(fields)).groupBy(F.col("item").alias("parent")).pivot("field", fields).agg(F.min("value"))
    return pdf.join(items, "item").join(n, "parent", "left").join(wide, "parent", "left").select("item", "key", "path", "parent", F.coalesce("parent_count", F.lit(0)).alias("parent_count"), *fields)


DATE = "struct<`date-parts`:array<array<int>>>"
CROSSREF = f"DOI string, title array<string>, `container-title` array<string>, author array<struct<family:string,given:string>>, `published-print` {DATE}, `published-online` {DATE}, issued {DATE}, created {DATE}"
OPENALEX = "doi string, authorships array<struct<author:struct<display_name:string>,author_position:string,raw_affiliation_strings:array<string>,institutions:array<struct<id:string,display_name:string>>>>"


def crossref_records(raw: DataFrame, col: str = "value") -> DataFrame:
    """(doi, title, journal, year, authors) of records as JSON texts: first title and journal, year of the first date that has one (print, online, issued, created), authors as `Family, Given`."""
    r = raw.select(F.from_json(F.col(col), CROSSREF).alias("r")).where("r is not null").select("r.*")
    year = F.coalesce(*[F.try_element_at(F.try_element_at(F.col(f"`{d}`.`date-parts`"), F.lit(1)), F.lit(1)) for d in ("published-print", "published-online", "issued", "created")])
    who = F.transform(F.coalesce("author", F.array().cast("array<struct<family:string,given:string>>")), lambda a: F.concat_ws(", ", F.nullif(F.trim(a["family"]), F.lit("")), F.nullif(F.trim(a["given"]), F.lit(""))))
    first = lambda c: F.coalesce(F.try_element_at(F.col(f"`{c}`"), F.lit(1)), F.lit(""))
    return r.select(F.lower(F.coalesce("DOI", F.lit(""))).alias("doi"), first("title").alias("title"), first("container-title").alias("journal"), year.cast("string").alias("year"), F.filter(who, lambda x: x != "").alias("authors"))


def openalex_authorship(raw: DataFrame, col: str = "value") -> DataFrame:
    """(doi, position, name, is_senior, raw_affiliations) of records as JSON texts; the last authorship is the senior one."""
    r = raw.select(F.from_json(F.col(col), OPENALEX).alias("r")).where("r is not null").select("r.*")
    doi = F.lower(F.regexp_replace(F.coalesce("doi", F.lit("")), "^https?://(dx\\.)?doi\\.org/", ""))
    a = r.select(doi.alias("doi"), F.size("authorships").alias("n"), F.posexplode("authorships").alias("i", "a"))
    return a.select("doi", (F.col("i") + 1).alias("position"), F.coalesce("a.author.display_name", F.lit("")).alias("name"), (F.col("i") == F.col("n") - 1).alias("is_senior"), F.coalesce("a.raw_affiliation_strings", F.array().cast("array<string>")).alias("raw_affiliations"))


class Sources:
    """Source plug-ins by capability, in order of registration."""

    def __init__(self) -> None:
        self._held: dict[str, dict[str, Callable]] = {}

    def register(self, name: str, **capabilities: Callable) -> None:
        for what, call in capabilities.items():
            self._held.setdefault(what, {})[name] = call

    def of(self, capability: str) -> dict[str, Callable]:
        return dict(self._held.get(capability, {}))


def write_json(df: DataFrame, path: str) -> None:
    """Replace a folder of JSON lines; the committer shows all of it or nothing."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Replace a folder of CSV files with header and byte order mark, as spreadsheets expect them."""
    head = df.columns[0]
    df.withColumnRenamed(head, "﻿" + head).write.mode("overwrite").option("header", True).csv(path)


# Endings of figures; a figure smaller than these is junk without a caption, one larger is kept on the first page.
FIGURES, LEAST_SIDE, LEAST_AREA, LARGE = ["png", "jpg", "jpeg", "webp", "svg", "gif"], 80, 16_000, 120_000


def figures(spark: SparkSession, pattern: str, meta: DataFrame) -> DataFrame:
    """(paper_id, name, page, caption, width, height, hidden) of figure files under `paper/figures/`; `meta`: paper_id, name, page, caption.

    Hidden: without a caption, and small, or on the first page and not large. Width and height are read from PNG headers; other files have none.
    """
    b = spark.read.format("binaryFile").load(pattern).select(F.regexp_extract("path", "([^/]+)/[^/]+/[^/]+$", 1).alias("paper_id"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.substring("content", 1, 24).alias("head"))
    b = b.where(F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(FIGURES))
    at = lambda k: F.conv(F.hex(F.expr(f"substring(head, {k}, 4)")), 16, 10).cast("bigint")
    png = F.hex(F.expr("substring(head, 1, 8)")) == "89504E470D0A1A0A"
    size = b.select("paper_id", "name", F.when(png & (at(17) > 0), at(17)).alias("width"), F.when(png & (at(21) > 0), at(21)).alias("height"))
    j = size.join(meta, ["paper_id", "name"], "left").withColumn("caption", F.trim(F.coalesce("caption", F.lit(""))))
    area = F.col("width") * F.col("height")
    small = F.coalesce((F.least("width", "height") < LEAST_SIDE) | (area < LEAST_AREA), F.lit(False))
    first = F.coalesce(F.col("page") == 1, F.lit(False)) & ~F.coalesce(area >= LARGE, F.lit(False))
    return j.select("paper_id", "name", "page", "caption", "width", "height", ((F.col("caption") == "") & (small | first)).alias("hidden"))


def reading_markdown(blocks: DataFrame) -> DataFrame:
    """(paper_id, markdown): included blocks of each paper in order; headings as `##`, captions of figures and tables in italics, lists with a dash."""
    t, cap = F.trim(F.coalesce("text", F.lit(""))), F.trim(F.coalesce("caption", F.lit("")))
    kind = F.col("reading_type")
    line = F.when(kind == "section_heading", F.concat(F.lit("## "), t)).when(kind.isin("figure", "table"), F.concat(F.lit("*"), F.when(cap == "", t).otherwise(cap), F.lit("*"))).when(kind == "list_item", F.concat(F.lit("- "), t)).otherwise(t)
    b = blocks.where("coalesce(include, true)").where((t != "") | (cap != "")).select("paper_id", "block_order", "id", line.alias("line"))
    return b.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_order", "id", "line"))), lambda x: x["line"]), "\n\n").alias("markdown"))  # one paper's text
