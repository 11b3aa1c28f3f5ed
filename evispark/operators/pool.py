"""The pool of files: health and body checks, import candidates, promotion with free names, names and identities, manifests, resolution of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.keys import norm_key, squeeze
from evispark.session import cut

# Flags of file names and of first texts with the class they mean, in order.
NAME_FLAGS = [
    ("supplement", "supplement", r"\b(supplement|supplementary|supporting[-_ ]information|supporting[-_ ]material|si)\b"),
    ("correction_or_erratum", "correction_or_erratum", r"\b(correction|erratum|corrigendum|retraction)\b"),
    ("graphical_abstract", "graphical_abstract", r"\b(graphical[-_ ]abstract|graphicalabstract)\b"),
    ("cover_or_toc", "cover_or_toc", r"\b(cover|table[-_ ]of[-_ ]contents|contents|toc|front[-_ ]matter)\b"),
    ("highlights", "graphical_abstract", r"\b(highlights?)\b"),
]
TEXT_FLAGS = [
    ("supplement", "supplement", r"\b(supporting information|supplementary material|supplemental material)\b"),
    ("correction_or_erratum", "correction_or_erratum", r"\b(correction|erratum|corrigendum|retraction notice)\b"),
    ("graphical_abstract", "graphical_abstract", r"\bgraphical abstract\b"),
    ("cover_or_toc", "cover_or_toc", r"\b(table of contents|front matter)\b"),
]
# Classes of a body by words of its name and first text, in order; the smallest healthy file; characters of a first text.
BODY_CLASSES = [
    ("review_article", r"\b(review|综述|advances in|recent advances|progress in)\b"),
    ("method_article", r"\b(method|protocol|workflow|benchmark|database|dataset|algorithm)\b"),
    ("thesis_or_dissertation", r"\b(thesis|dissertation|学位论文|硕士|博士)\b"),
    ("report_or_preprint", r"\b(preprint|arxiv|technical report|working paper)\b"),
]
SMALL, FIRST_TEXT = 50 * 1024, 4000
FORBIDDEN = r'[<>:"/\\|?*\x00-\x1f]'


def flags(c: Column, patterns: list[tuple[str, str, str]]) -> Column:
    """array of (flag, class) that match the lower-case text, in order."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.struct(F.lit(n).alias("flag"), F.lit(k).alias("class"))) for n, k, p in patterns]))


def probe(files: DataFrame) -> DataFrame:
    """`files` with document_class, decision, reason, warnings. Columns: name, exists, size, magic, encrypted, pages, text (of the first pages); nulls count as missing.

    Broken: missing, empty, without the magic bytes, encrypted, without pages. No body: a flag in the name, or one in the first 1,500 characters of a text of at most two pages. By hand: one page under 500 characters, or
    under 300 in all. Everything else is a candidate.
    """
    text = F.left(squeeze(F.coalesce("text", F.lit(""))), F.lit(FIRST_TEXT))
    f = files.withColumns({"_t": text, "_nf": flags(F.col("name"), NAME_FLAGS)}).withColumn("_tf", flags(F.left("_t", F.lit(1500)), TEXT_FLAGS))
    both = F.lower(F.concat_ws(" ", "name", F.left("_t", F.lit(1200))))
    body = F.lit("main_article")
    for k, p in reversed(BODY_CLASSES):
        body = F.when(both.rlike(p), k).otherwise(body)
    n, chars = F.coalesce("pages", F.lit(0)), F.length("_t")
    named, told = F.col("_nf")[0]["class"], F.col("_tf")[0]["class"]
    steps = [
        (~F.coalesce("exists", F.lit(False)), "reject_broken_pdf", F.lit("unknown"), F.lit("file_missing")), (F.coalesce("size", F.lit(0)) <= 0, "reject_broken_pdf", F.lit("unknown"), F.lit("empty_file")),
        (~F.coalesce("magic", F.lit(False)), "reject_broken_pdf", F.lit("unknown"), F.lit("missing_pdf_magic")), (F.coalesce("encrypted", F.lit(False)), "reject_broken_pdf", F.lit("unknown"), F.lit("encrypted_pdf")), (n <= 0, "reject_broken_pdf", F.lit("unknown"), F.lit("no_pages")),
        (F.size("_nf") > 0, "reject_non_literature_body", named, F.concat(F.lit("filename_indicates_"), named)), ((F.size("_tf") > 0) & (n <= 2), "reject_non_literature_body", told, F.concat(F.lit("short_pdf_text_indicates_"), told)),
        ((n <= 1) & (chars < 500), "needs_manual_review", F.lit("unknown"), F.lit("single_page_low_text")), (chars < 300, "needs_manual_review", F.lit("unknown"), F.lit("low_extractable_text")),
    ]
    out = F.struct(F.lit("candidate_for_pool").alias("decision"), body.alias("document_class"), F.lit("pdf_looks_like_literature_body").alias("reason"))
    for cond, decision, kind, why in reversed(steps):
        out = F.when(cond, F.struct(F.lit(decision).alias("decision"), kind.alias("document_class"), why.alias("reason"))).otherwise(out)
    small = (F.coalesce("size", F.lit(0)) > 0) & (F.col("size") < SMALL)
    return f.withColumn("_o", out).withColumn("warnings", F.when(F.coalesce(small, F.lit(False)), F.array(F.lit("small_pdf_file"))).otherwise(F.array().cast("array<string>"))).select(*files.columns, "_o.*", "warnings")


def audit(probed: DataFrame) -> DataFrame:
    """(kind, value, n): counts by decision, class and warning, files that share a hash, and groups of such files. `probed` also has sha."""
    one = lambda kind, c: probed.groupBy(c.cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    w = probed.select(F.explode("warnings").alias("value")).groupBy("value").agg(F.count("*").alias("n")).select(F.lit("warning").alias("kind"), "value", "n")
    groups = probed.where("sha is not null").groupBy("sha").agg(F.count("*").alias("c")).where("c > 1")
    d = groups.agg(F.count("*").alias("g"), F.coalesce(F.sum("c"), F.lit(0)).alias("f"))
    pair = d.select(F.explode(F.array(F.struct(F.lit("groups").alias("value"), F.col("g").alias("n")), F.struct(F.lit("files").alias("value"), F.col("f").alias("n")))).alias("x")).select(F.lit("duplicate").alias("kind"), "x.value", "x.n")
    return one("decision", F.col("decision")).unionAll(one("class", F.col("document_class"))).unionAll(w).unionAll(pair)


def doi_keys(name: Column) -> Column:
    """Key of a publisher's article number at the end of a file stem: journal, year and number without punctuation; empty if none."""
    p = r"(?:10[._-]1016[._-])?j[._-]([a-z0-9]+)[._-]((?:19|20)\d{2})[._-]([a-z0-9._-]+)$"
    low = F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"\.[^./\\]{1,5}$", ""))
    j, y, s = (F.regexp_extract(low, p, k) for k in (1, 2, 3))
    return F.when(F.regexp_replace(s, "[^a-z0-9]", "") == "", "").otherwise(F.concat(j, y, F.regexp_replace(s, "[^a-z0-9]", "")))


def parent_key(doi: Column) -> Column:
    """The same key from a parent's DOI."""
    p = r"10\.1016/j\.([a-z0-9]+)\.((?:19|20)\d{2})\.([a-z0-9.]+)"
    low = F.lower(F.coalesce(doi, F.lit("")))
    j, y, s = (F.regexp_extract(low, p, k) for k in (1, 2, 3))
    return F.when(F.regexp_replace(s, "[^a-z0-9]", "") == "", "").otherwise(F.concat(j, y, F.regexp_replace(s, "[^a-z0-9]", "")))


def candidates(files: DataFrame, pool: DataFrame, overload: int = 3) -> DataFrame:
    """(sha, candidate_id, status, files, names, parents, dois, titles, in_pool, conflict, overloaded, warnings): one row per distinct content.

    `files`: sha, name, parent, parent_doi, parent_title, parent_count, decision; `pool`: sha. Overloaded: a parent with more than `overload` attachments. Conflict: a key of the name and one of a parent's DOI, and none in common.
    """
    sets = lambda c: F.array_sort(F.collect_set(F.when(F.trim(c) != "", F.trim(c))))
    k = files.withColumn("fk", doi_keys(F.col("name"))).withColumn("pk", parent_key(F.col("parent_doi")))
    g = k.where("sha is not null").groupBy("sha").agg(F.count("*").alias("files"), sets("name").alias("names"), sets("parent").alias("parents"), sets("parent_doi").alias("dois"), sets("parent_title").alias("titles"), sets("fk").alias("fks"), sets("pk").alias("pks"), F.max(F.coalesce("parent_count", F.lit(0)) > overload).alias("overloaded"), F.min_by("decision", "name").alias("decision"))  # files of one content
    j = g.join(pool.select("sha").distinct().withColumn("in_pool", F.lit(True)), "sha", "left").withColumn("in_pool", F.coalesce("in_pool", F.lit(False)))
    conflict = (F.size("fks") > 0) & (F.size("pks") > 0) & ~F.arrays_overlap("fks", "pks")
    j = j.withColumn("conflict", conflict)
    status = F.when(F.col("in_pool"), "exact_duplicate_in_pool").when(F.col("decision").isin("reject_broken_pdf", "reject_non_literature_body", "candidate_for_pool"), F.col("decision")).otherwise("needs_manual_review")
    warn = F.array_compact(F.array(F.when(F.col("files") > 1, "internal_duplicates"), F.when(F.col("overloaded"), "parent_attachment_overload"), F.when(F.col("conflict"), "filename_parent_doi_conflict"), F.when(F.size("fks") == 0, "no_filename_doi_key")))
    return j.select("sha", F.concat(F.lit("ZOT-"), F.left("sha", F.lit(12))).alias("candidate_id"), status.alias("status"), "files", "names", "parents", "dois", "titles", "in_pool", "conflict", "overloaded", warn.alias("warnings"))


def overloaded_parents(files: DataFrame, overload: int = 3) -> DataFrame:
    """(parent, attachments, contents) of parents with more than `overload` attachments."""
    return files.where("parent <> ''").groupBy("parent").agg(F.max("parent_count").alias("attachments"), F.countDistinct("sha").alias("contents")).where(F.col("attachments") > overload)


def eligible(records: DataFrame, manual: bool = False, ids: list[str] | None = None) -> DataFrame:
    """Candidates that may be promoted: new to the pool, of an allowed status, of the given ids if any."""
    allowed = ["candidate_for_pool", *(["needs_manual_review"] if manual else [])]
    r = records.where(~F.col("in_pool") & F.col("status").isin(allowed))
    return r.where(F.col("candidate_id").isin(ids)) if ids else r


def clean_name(c: Column, most: int = 180) -> Column:
    """A file name without forbidden characters, squeezed, cut at `most`; `untitled` if nothing is left."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), FORBIDDEN, "_"), r"\s+", " ")
    t = F.regexp_replace(t, r"^[ ._]+|[ ._]+$", "")
    t = F.when(F.length(t) > most, F.regexp_replace(F.left(t, F.lit(most)), r"[ ._]+$", "")).otherwise(t)
    return F.when(t == "", "untitled").otherwise(t)


def clean_author(c: Column) -> Column:
    """First author of a file name's author part; of Latin names the first word; `unknown` if none."""
    t = F.trim(F.split(F.trim(F.coalesce(c, F.lit(""))), r"(?i)\s+等\b|等\b|\s+et\s+al\.?\b|\s+and\s+|和|&|,", 2)[0])
    t = F.when(t.rlike("[A-Za-z]") & F.contains(t, F.lit(" ")), F.split(t, r"\s+")[0]).otherwise(t)
    return F.when(t == "", "unknown").otherwise(clean_name(t, 40))


def name_parts(name: Column) -> Column:
    """struct year, author, title of a file name: `Author - 2024 - Title`, `2019-Title_Author`, `Title_Author` (author of 20 characters at most), else the stem as title with any year in it."""
    stem = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\.[A-Za-z0-9]{1,5}$", ""))
    ex = lambda p, k: F.regexp_extract(stem, p, k)
    a, b, c = r"^(.+?)\s+-\s+((?:19|20)\d{2})\s+-\s+(.+)$", r"^((?:19|20)\d{2})[-_](.+)$", r"^(.*\S.*)_([^_]*[^_\s][^_]*)$"
    body = F.trim(ex(b, 2))
    bt, ba = F.trim(F.regexp_extract(body, c, 1)), F.trim(F.regexp_extract(body, c, 2))
    year = ex(r"((?:19|20)\d{2})", 1)
    row = lambda y, w, t: F.struct(y.alias("year"), w.alias("author"), t.alias("title"))
    ladder = F.when(ex(a, 2) != "", row(ex(a, 2), clean_author(ex(a, 1)), F.trim(ex(a, 3)))).when((ex(b, 1) != "") & (ba != ""), row(ex(b, 1), clean_author(ba), bt)).when(ex(b, 1) != "", row(ex(b, 1), F.lit("unknown"), body))
    return ladder.when((ex(c, 2) != "") & (F.length(F.trim(ex(c, 2))) <= 20), row(year, clean_author(ex(c, 2)), F.trim(ex(c, 1)))).otherwise(row(year, F.lit("unknown"), stem))


def pool_name(records: DataFrame) -> DataFrame:
    """`records` (names, titles, dois, conflict, overloaded, candidate_id) with `target`: year, author, title and suffix; a parent's title and DOI are used only if unique, unconflicted and not overloaded."""
    parts = name_parts(F.col("names")[0])
    trusted = ~F.col("conflict") & ~F.col("overloaded")
    one = lambda c: F.when(trusted & (F.size(c) == 1), F.col(c)[0])
    r = records.withColumn("_p", parts)
    title = F.coalesce(one("titles"), F.nullif(F.col("_p.title"), F.lit("")), F.lit("untitled"))
    year = F.coalesce(F.nullif(F.col("_p.year"), F.lit("")), F.nullif(F.regexp_extract(title, r"((?:19|20)\d{2})", 1), F.lit("")), F.lit("unknown-year"))
    suffix = F.coalesce(clean_name(F.substring_index(one("dois"), "/", -1), 80), F.col("candidate_id"))
    suffix = F.when(one("dois").isNull(), F.col("candidate_id")).otherwise(suffix)
    return r.withColumn("target", clean_name(F.concat(year, F.lit("_"), F.col("_p.author"), F.lit("_"), clean_name(title, 80), F.lit("_"), suffix, F.lit(".pdf")), 220)).drop("_p")


def promotion_plan(records: DataFrame, pool: DataFrame, missing: DataFrame, conflict: str = "suffix") -> DataFrame:
    """(candidate_id, action, target): what to do with each record (candidate_id, sha, target, arrival).

    skip_missing_source (missing: candidate_id), skip_hash_already_in_pool (pool: sha, name), else `ready` under a name no other file has, case aside. A taken name goes by policy: `error`, `skip`, or `suffix`: the first 12 of
    the hash, then that and `_2`, `_3` in order of arrival. Records of one name and hash prefix are numbered together.
    """
    j = records.join(missing.select("candidate_id", F.lit(True).alias("gone")), "candidate_id", "left").join(pool.select("sha", F.lit(True).alias("had")).dropDuplicates(["sha"]), "sha", "left")
    j = j.withColumn("skip", F.when(F.col("gone"), "skip_missing_source").when(F.col("had"), "skip_hash_already_in_pool"))
    taken = pool.select(F.lower("name").alias("low")).distinct().withColumn("taken", F.lit(1))
    j = j.withColumn("low", F.lower("target")).join(taken, "low", "left")
    n = F.when(F.col("skip").isNull(), F.row_number().over(Window.partitionBy("low", F.col("skip").isNull()).orderBy("arrival"))).otherwise(0) + F.coalesce("taken", F.lit(0))
    j = j.withColumn("n", n)
    stem = clean_name(F.regexp_replace("target", r"\.pdf$", ""))
    twin = F.row_number().over(Window.partitionBy("low", F.left("sha", F.lit(12)), (F.col("n") > 1) & F.col("skip").isNull()).orderBy("arrival"))
    extra = F.when(twin == 1, F.left("sha", F.lit(12))).otherwise(F.concat(F.left("sha", F.lit(12)), F.lit("_"), twin))
    busy = F.col("skip").isNull() & (F.col("n") > 1)
    if conflict == "suffix":
        return j.select("candidate_id", F.coalesce("skip", F.lit("ready")).alias("action"), F.when(busy, clean_name(F.concat(stem, F.lit("_"), extra, F.lit(".pdf")), 220)).otherwise(F.col("target")).alias("target"))
    return j.select("candidate_id", F.coalesce("skip", F.when(busy, f"{conflict}_conflict").otherwise("ready")).alias("action"), "target")


def identity(name: Column, stopwords: list[str]) -> Column:
    """`doi:` and the key of the article number in a name, else `tokens:` and its first 16 words of three letters or more in order, if there are four; empty else."""
    low = F.lower(F.coalesce(name, F.lit("")))
    j, y, s = (F.regexp_extract(low, r"j[._-]([a-z0-9]+)[._-](\d{4})[._-]([a-z0-9]+)", k) for k in (1, 2, 3))
    t = F.array_sort(F.array_distinct(F.filter(F.split(norm_key(name), " "), lambda w: (F.length(w) >= 3) & ~w.isin(stopwords))))
    return F.when(j != "", F.concat(F.lit("doi:"), j, y, s)).when(F.size(t) >= 4, F.concat(F.lit("tokens:"), F.array_join(F.slice(t, 1, 16), "-"))).otherwise("")


def ingest(files: DataFrame, manifest: DataFrame, library: DataFrame, reserved: DataFrame) -> DataFrame:
    """(file, paper_id, status, possible_duplicates) of new files (file, sha, identity, arrival).

    A known hash is `duplicate_manifest`, else `duplicate_library`, with the first paper that has it. Others get the free `S` numbers from the greatest one on, reserved ones (paper_id) left out, in order of arrival: a file whose hash
    came before in the same run is `duplicate_manifest` too. Papers of the manifest (paper_id, sha, identity) with one identity are possible duplicates.
    """
    first = lambda d, name: d.where("sha <> ''").groupBy("sha").agg(F.min("paper_id").alias(name))
    j = files.join(first(manifest, "m"), "sha", "left").join(first(library, "l"), "sha", "left")
    known = F.coalesce("m", "l")
    j = j.withColumn("twin", F.when(known.isNull(), F.row_number().over(Window.partitionBy("sha", known.isNull()).orderBy("arrival"))))
    new = j.where("twin = 1")
    number = lambda d: d.select(F.expr("try_cast(regexp_extract(paper_id, '^S([0-9]+)$', 1) as bigint)").alias("k")).where("k is not null")
    used = number(manifest.select("paper_id").unionAll(library.select("paper_id"))).unionAll(number(reserved)).distinct()
    start = number(manifest.select("paper_id").unionAll(library.select("paper_id"))).agg(F.coalesce(F.max("k"), F.lit(0)).alias("top"))
    ranked = new.select("sha", F.row_number().over(Window.orderBy("arrival")).alias("r"))  # the files of one run
    room = start.crossJoin(new.agg(F.count("*").alias("c"))).crossJoin(used.agg(F.count("*").alias("u"))).where("c > 0")  # one row
    free = room.select(F.explode(F.sequence(F.col("top") + 1, F.col("top") + F.col("c") + F.col("u"))).alias("k")).join(used, "k", "left_anti").select("k", F.row_number().over(Window.orderBy("k")).alias("r"))
    given = ranked.join(free, "r").select("sha", F.concat(F.lit("S"), F.when(F.col("k") < 10, F.format_string("%02d", "k")).otherwise(F.col("k").cast("string"))).alias("made"))
    alike = manifest.where("identity <> ''").groupBy("identity").agg(F.array_join(F.array_sort(F.collect_set("paper_id")), ",").alias("same"))  # papers of one identity
    out = j.join(given, "sha", "left").join(alike, "identity", "left")
    status = F.when(F.col("m").isNotNull(), "duplicate_manifest").when(F.col("l").isNotNull(), "duplicate_library").when(F.col("twin") > 1, "duplicate_manifest").otherwise("active")
    return out.select("file", F.coalesce("m", "l", "made").alias("paper_id"), status.alias("status"), F.when(status == "active", F.coalesce("same", F.lit(""))).otherwise("").alias("possible_duplicates"))


def refreshed(records: DataFrame, refs: DataFrame) -> DataFrame:
    """(paper_id, identity, possible_duplicates): records (paper_id, identity, old: array) with other papers of their identity (refs: paper_id, identity) after the old ones, each once, itself left out."""
    r = refs.where("identity <> ''").groupBy("identity").agg(F.array_sort(F.collect_set("paper_id")).alias("same"))  # papers of one identity
    empty = F.array().cast("array<string>")
    j = records.join(r, "identity", "left")
    return j.select("paper_id", "identity", F.array_remove(F.array_distinct(F.concat(F.coalesce("old", empty), F.coalesce("same", empty))), F.col("paper_id")).alias("possible_duplicates"))


def resolve_sources(wanted: DataFrame, files: DataFrame, stopwords: list[str]) -> DataFrame:
    """(paper_id, file, how): the file of each paper (paper_id, name): of exactly its name, else the only one of its article number, else the one that holds most of its words: 0.6 of them, and 0.15 ahead of the next."""
    exact = wanted.join(files.select(F.col("file").alias("name"), "file"), "name").groupBy("paper_id").agg(F.min("file").alias("file"), F.lit(1).alias("k"))
    key = lambda c: F.regexp_extract(F.lower(c), r"\bj[._-]([a-z0-9]+[._-]\d{4}[._-][a-z0-9]+)", 1)
    k = wanted.withColumn("key", F.regexp_replace(key("name"), "[._-]", "")).where("key <> ''").join(files.select("file", F.regexp_replace(key("file"), "[._-]", "").alias("key")), "key").groupBy("paper_id").agg(F.min("file").alias("file"), F.count("*").alias("c")).where("c = 1").select("paper_id", "file", F.lit(2).alias("k"))
    words = lambda c: F.array_distinct(F.filter(F.split(norm_key(F.regexp_replace(c, r"\.[A-Za-z0-9]{1,5}$", "")), " "), lambda w: (F.length(w) >= 3) & ~w.isin(stopwords)))
    held = cut(files.select("file", words("file").alias("fs")).distinct())
    posts = held.select("file", F.explode("fs").alias("t"))
    df = posts.groupBy("t").agg(F.count("*").alias("df"))
    todo = wanted.join(exact.unionByName(k), "paper_id", "left_anti").select("paper_id", words("name").alias("ws")).where("size(ws) > 0").distinct()
    named = cut(todo.groupBy("ws").agg(F.collect_list("paper_id").alias("papers")).withColumn("w", F.xxhash64("ws")))  # papers of one name
    t = named.select("w", "ws", F.size("ws").alias("n"), F.explode("ws").alias("t")).join(df, "t", "left")
    t = cut(t.withColumn("r", F.row_number().over(Window.partitionBy("w", "ws").orderBy(F.coalesce("df", F.lit(0)), "t"))))  # the words of one name

    def near(rows: DataFrame, least: float) -> DataFrame:
        """Files that hold at least `least` of the words of a name: they hold one of its n - ceil(n least) + 1 rarest."""
        rare = rows.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).join(posts, "t").select("w", "ws", "n", "file").distinct()
        return rare.join(held, "file").select("ws", "file", (F.size(F.array_intersect("ws", "fs")) / F.col("n")).alias("score")).where(F.col("score") >= least)

    full = cut(near(t, 1.0).groupBy("ws").agg(F.count("*").alias("c")))  # two files with all words: neither leads, and who else holds many can't change it
    once = t.join(full.where("c = 1"), "ws", "left_semi")
    s = near(once, 0.85).unionByName(near(t.join(full, "ws", "left_anti"), 0.6))
    order = Window.partitionBy("ws").orderBy(F.desc("score"), "file")
    s = s.withColumn("r", F.row_number().over(order)).withColumn("next", F.lead("score").over(order)).where("r = 1 and (next is null or score > next + 0.15)")
    s = s.join(named.select("ws", F.explode("papers").alias("paper_id")), "ws").select("paper_id", "file", F.lit(3).alias("k"))
    best = exact.unionByName(k).unionByName(s).groupBy("paper_id").agg(F.min_by(F.struct("file", "k"), "k").alias("m"))
    return wanted.select("paper_id").join(best, "paper_id", "left").select("paper_id", F.col("m.file").alias("file"), F.when(F.col("m.k") == 1, "origin_filename").when(F.col("m.k") == 2, "doi_key").when(F.col("m.k") == 3, "title_tokens").alias("how"))


def target_name(title: Column, authors: Column, year: Column, doi: Column, pii: Column, index: Column) -> Column:
    """File name from a record: year, first author's family name, title of 80 characters, end of the DOI (else article number, else index)."""
    a = F.trim(F.coalesce(F.try_element_at(authors, F.lit(1)), F.lit("")))
    family = F.when(a == "", "unknown").when(F.contains(a, F.lit(",")), F.trim(F.substring_index(a, ",", 1))).otherwise(F.split(a, r"\s+")[0])
    part = lambda c, none, n=120: clean_name(F.when(F.coalesce(c, F.lit("")) == "", none).otherwise(c), n)
    suffix = F.coalesce(F.nullif(F.substring_index(doi, "/", -1), F.lit("")), F.nullif(pii, F.lit("")), index.cast("string"))
    return clean_name(F.concat(part(year, "unknown-year"), F.lit("_"), part(family, "unknown"), F.lit("_"), part(title, "untitled", 80), F.lit("_"), clean_name(suffix, 120), F.lit(".pdf")), 220)


def to_fetch(articles: DataFrame, files: DataFrame, state: DataFrame, start: int = 0, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, report): articles (index, target) from `start` on whose file isn't there, the first `limit` of them; and each article's status: success where the file is there, whatever the state log (index, status) says, else the state, else pending."""
    j = articles.join(files.select(F.lower("file").alias("low"), F.lit(True).alias("there")).dropDuplicates(["low"]), F.lower("target") == F.col("low"), "left").join(state, "index", "left")
    report = j.select("index", F.when(F.col("there"), "success").otherwise(F.coalesce("status", F.lit("pending"))).alias("status"))
    chosen = j.where((F.col("index") >= start) & F.col("there").isNull()).select("index", "target")
    return (chosen.orderBy("index").limit(limit) if limit is not None else chosen), report
