"""Matching entities across sources without keys: sorted neighbourhood, weighted similarities, one-to-one assignment.

Every record is placed in several global orders, each by another composite sort key; records within a window of each other are
compared, across the sources and within each. Accepted pairs within a source show repeated entries of one work; the
assignment is one-to-one between works, maximises the total confidence, and is then read out for every entry.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.llm.distance import allowed, osa
from evispark.operators.components import connected_components
from evispark.session import cut

# Words of a title that may come and go without changing it.
LOOSE = frozenset("a an the of on in at to for from by with using and under is".split())
SAME = {"ch4": "methane", "co2": "carbon dioxide", "behavior": "behaviour", "color": "colour", "aging": "ageing", "analyses": "analysis"}
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
KINDS = re.compile(r"^(erratum|corrigendum|correction|retraction|addendum|comments?|commentary|reply|response|discussion|editorial|review)\b\s*(?:to|on|of|for)?\s*(?:the\s+article\s*)?[.:–—-]\s*|^(erratum|corrigendum|comments?|reply|response)\s+(?:to|on)\s*[.:–—-]?\s+")
KIND_NAMES = {"comments": "comment", "commentary": "comment", "response": "reply", "corrigendum": "erratum", "correction": "erratum"}
TITLED = frozenset("prof dr phd md mr mrs ms jr sr al et the working group".split())
SCHEMA = "src int, id bigint, kind string, part int, edition int, cutoff boolean, main array<string>, sub array<string>, year int, doi string, journal array<string>, names array<string>, people int"


def fold(text: str) -> str:
    """Lower case without accents and markup."""
    t = html.unescape(re.sub(r"</?\w+>", " ", text))
    t = unicodedata.normalize("NFKD", t.replace("ø", "o").replace("Ø", "O").replace("ß", "ss").replace("ł", "l"))
    return "".join(c for c in t if not unicodedata.combining(c)).lower()


def read_title(text: str | None) -> tuple[str, int, int, bool, list[str], list[str]]:
    """(kind, part, edition, cut off, main words, subtitle words). Kind is empty for a plain work, part and edition 0 where there is none."""
    if not text or not text.strip():
        return "", 0, 0, False, [], []
    t = re.sub(r"\[[^\]]*\]\s*$", "", fold(text).strip().strip("\"'“”*† ")).strip().strip("\"'“”*† ")
    off = bool(re.search(r"(…|\.\.\.)\s*$", text.strip().strip("\"'*† ")))
    kind = ""
    while m := KINDS.match(t):
        word = m[1] or m[2]
        kind = (kind + " " + KIND_NAMES.get(word, word)).strip()
        t = t[m.end() :]
    if (m := re.match(r"([a-z]+)\s+(?:to|on)\b\s*[.:–—-]\s*", t)) and (near := [k for k in ("erratum", "comment", "reply") if osa(m[1], k, 1) <= 1]):
        kind, t = (kind + " " + near[0]).strip(), t[m.end() :]
    part = 0
    if m := re.search(r"[.,:;(–-]?\s*\bpart\s+([ivx]+|\d+)\b\)?", t):
        part = ROMAN.get(m[1]) or (int(m[1]) if m[1].isdigit() else 0)
        t = t[: m.start()] + t[m.end() :]
    edition = int(m[0]) if (m := re.search(r"\b(?:18|19|20)\d\d\b", t)) else 0
    cuts = re.split(r"\s*:\s+|[.?]\s+|\s+[–—-]\s+", t, maxsplit=1)
    return kind, part, edition, off, _words(cuts[0]), _words(cuts[1]) if len(cuts) > 1 else []


def _words(t: str) -> list[str]:
    found = [SAME.get(w, w) for w in re.findall(r"[a-z0-9]+", t.replace("&", " and "))]
    return [w for w in found if w not in LOOSE]


def read_year(text: str | None) -> int:
    m = re.search(r"(?:18|19|20)\d\d", text or "")
    return int(m[0]) if m else 0


def read_doi(text: str | None) -> str:
    m = re.search(r"10\.\d{4,9}/\S+", re.sub(r"\s+", "", (text or "").lower()))
    return m[0].rstrip(".,;)") if m else ""


def read_journal(text: str | None) -> list[str]:
    t = re.sub(r",?\s*vol\.?\s*\d+.*$", "", fold(text or ""))
    return [w for w in re.findall(r"[a-z]+", t) if w not in LOOSE]


def read_names(people: object) -> tuple[list[str], int]:
    """Distinct words of three letters or more of all names, and the number of names."""
    out: dict[str, None] = {}
    n = 0
    for p in people if people is not None else []:
        if not p or not p.strip():
            continue
        ws = [w for w in re.findall(r"[a-z]+", fold(p)) if len(w) > 2 and w not in TITLED]
        n += bool(ws)
        out.update(dict.fromkeys(ws))
    return list(out), n


def read_records(df: DataFrame, src: int, key: str) -> DataFrame:
    """Features of each record; df has `key`, title, doi, year, journal, authors. Any of them may be null."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for i, title, doi, year, journal, authors in zip(pdf["id"], pdf["title"], pdf["doi"], pdf["year"], pdf["journal"], pdf["authors"]):
                names, n = read_names(authors)
                rows.append((src, i, *read_title(title), read_year(year), read_doi(doi), read_journal(journal), names, n))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    cols = [F.col(key).alias("id"), "title", "doi", "year", "journal", "authors"]
    return df.where(F.col(key).isNotNull()).select(*cols).mapInPandas(read, SCHEMA)


@lru_cache(maxsize=1 << 18)
def _like(a: str, b: str) -> bool:
    if a == b:
        return True
    most = allowed(min(len(a), len(b)) + 1)
    return bool(most) and osa(a, b, most) <= most


def align(a: list[str], b: list[str]) -> int:
    """Words in common, in order, each equal up to a few letters; a word may be parted or run together."""
    if a == b:
        return len(a)
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            up = row[j]
            row[j] = max(up, row[j - 1], diagonal + _like(x, y))
            diagonal = up
    return row[-1]


def journal_like(a: list[str], b: list[str]) -> bool:
    """Whether one is the other, its abbreviation word by word, or its initials."""
    short, long = sorted((a, b), key=lambda j: sum(map(len, j)))
    if len(short) == 1 and len(long) > 1:
        initials = "".join(w[0] for w in long)
        return short[0] == initials or osa(short[0], initials, 1) <= 1
    if len(short) != len(long):
        return align(short, long) >= max(len(short), len(long)) - 1 and len(short) > 2
    return all(y.startswith(x[:3]) or _like(x, y) or x[0] == y[0] and osa(x, y[: len(x)], 1) <= 1 for x, y in zip(short, long))


def title_score(x: tuple, y: tuple) -> float | None:
    """Evidence of the titles: None if they belong to different works, 0 if one says nothing."""
    kind, part, edition, off, main, sub = x
    kind2, part2, edition2, off2, main2, sub2 = y
    if not main or not main2:
        return 0.0
    if kind != kind2:
        return None
    whole, whole2 = main + sub, main2 + sub2
    short, long = sorted((whole, whole2), key=len)
    n = align(short, long)
    torn = 0 < len(short) <= len(long) and n >= len(short) - 1 and len(short[-1]) < len(long[len(short) - 1]) and long[len(short) - 1].startswith(short[-1])
    cut_short = off or off2 or torn  # torn: the last word breaks off
    if edition != edition2 and not (cut_short and (not edition or not edition2)):
        return None
    bare = not sub and not sub2 or (bool(sub) == bool(sub2))
    if part != part2 and not ((part == 0 or part2 == 0) and (cut_short or not bare)):
        return None
    if len(short) == len(long) and n == len(long):
        return 6.0
    tail = cut_short and n >= len(short) - 1 or n == len(short)
    if n >= len(long) - 1 and len(long) > 4:
        a, b = "".join(short), "".join(long)
        if abs(len(a) - len(b)) <= 3 and osa(a, b, 3) <= 3:
            return 5.5  # words run together
    if tail:
        head = align(short[:n], long[: n + 1])
        if head >= n - 1 and n >= 3:  # the shorter is the start of the longer
            no_sub = n >= len(main if long is whole else main2)
            return 4.5 if no_sub else 1.0 + 3.0 * n / len(long)
        if n == len(short) and n >= 5 and len(long) - n <= 1:
            return 2.0
    return None


def names_score(a: list[str], na: int, b: list[str], nb: int, common: frozenset[str]) -> float:
    """Evidence of the author names; words that are common among all records (given names) say nothing."""
    x, y = [w for w in a if w not in common], [w for w in b if w not in common]
    if not x or not y:
        return 0.0
    short, long = sorted((x, y), key=len)
    hit = sum(any(_like(w, v) for v in long) for w in short)
    share = hit / len(short)
    if share < 0.34:
        return -3.0 if min(na, nb) > 1 or hit == 0 else -1.0
    return share * (1.5 + min(2.0, 1.0 * (hit - 1)))


def pair_score(x: tuple, y: tuple, common: frozenset[str]) -> float:
    """Weighted sum of the field similarities; -inf for different works. Positions as in SCHEMA from `kind` on."""
    title = title_score(x[:6], y[:6])
    if title is None:
        return -np.inf
    score = title
    if x[6] and y[6]:
        d = abs(x[6] - y[6])
        score += (1.5, 0.5, -0.5)[d] if d < 3 else -4.0
    if x[7] and y[7]:
        score += 4.0 if x[7] == y[7] else 2.5 if osa(x[7], y[7], 1) <= 1 and len(x[7]) != len(y[7]) else -0.5
    if len(x[8]) and len(y[8]):
        score += 1.0 if journal_like(x[8], y[8]) else -2.0
    score += names_score(x[9], x[10], y[9], y[10], common)
    return score


def confidence(score: float) -> float:
    """The score as a share of certainty: 0.5 at the threshold of 4."""
    return float(1 / (1 + np.exp(-(score - 4.0))))


def sort_keys(records: DataFrame) -> DataFrame:
    """(pass, key, record): each record once per composite sort key that it has words for."""
    text = lambda c: F.array_join(c, " ")
    whole = F.concat("main", "sub")
    year, first = F.col("year").cast("string"), F.coalesce(F.try_element_at("names", F.lit(1)), F.lit(""))
    second = F.coalesce(F.try_element_at("names", F.lit(2)), F.lit(""))
    tokens = records.select(F.explode("main").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    rare = records.select("src", "id", F.explode("main").alias("t")).join(tokens.where("df > 1"), "t")
    rare = rare.groupBy("src", "id").agg(F.slice(F.array_sort(F.collect_set(F.struct("df", "t"))), 1, 2).alias("r"))  # a title's words
    with_rare = records.join(rare, ["src", "id"], "left").withColumn("r", F.coalesce(F.transform("r", lambda s: s["t"]), F.array().cast("array<string>")))
    none = F.lit(None).cast("string")
    has_title, has_name = F.size("main") > 0, first != ""
    keys = [
        F.when(has_title, F.concat_ws(" ", text(whole), "kind", "part", year)),
        F.when(has_title, F.concat_ws(" ", text(F.reverse("main")), "kind", "part", year)),
        F.when(F.col("doi") != "", F.concat_ws(" ", "doi", text(whole))),
        F.when(has_name, F.concat_ws(" ", F.least(first, F.when(second != "", second).otherwise(first)), year, text(whole))),
        F.when(has_name & (F.col("year") > 0), F.concat_ws(" ", year, F.transform("journal", lambda w: F.substring(w, 1, 1)).cast("string"), first, text(whole))),
        F.when(F.size("r") > 0, F.concat_ws(" ", text("r"), "kind", "part", text(whole))),
        F.when(has_title & has_name, F.concat_ws(" ", F.try_element_at("names", F.lit(-1)), text(F.reverse("main")))),
    ]
    ordered = F.filter(F.array(*[F.struct(F.lit(i).alias("pass"), F.coalesce(k, none).alias("key")) for i, k in enumerate(keys)]), lambda s: s["key"].isNotNull())
    return with_rare.select("*", F.explode(ordered).alias("o")).select("*", "o.*").drop("o", "r")


def windows(keyed: DataFrame, window: int, block: int = 2048) -> DataFrame:
    """`keyed` with `block` and `rank`: its global order by (pass, key, src, id), in blocks that also hold the last `window` - 1 rows of the block before (halo true).

    Ranks are exact: positions within range partitions plus the sizes of the partitions before. The only thing the driver
    sees is one number per partition.
    """
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(n, "pass", "key", "src", "id").sortWithinPartitions("pass", "key", "src", "id")
    placed = cut(ordered.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_p", F.shiftright("_at", 33)).withColumn("_i", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("c"))
    before = sizes.withColumn("start", F.coalesce(F.sum("c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    ranked = placed.join(F.broadcast(before), "_p").withColumn("rank", F.col("start") + F.col("_i")).drop("_p", "_i", "_at", "start", "key")  # one row per partition
    own = F.floor(F.col("rank") / block)
    spill = F.when(F.col("rank") % block >= block - window + 1, F.array(F.struct(own.alias("block"), F.lit(False).alias("halo")), F.struct((own + 1).alias("block"), F.lit(True).alias("halo"))))
    spots = F.coalesce(spill, F.array(F.struct(own.alias("block"), F.lit(False).alias("halo"))))
    return ranked.select("*", F.explode(spots).alias("s")).select("*", "s.*").drop("s")


def without_placeholders(records: DataFrame, most: int = 8) -> DataFrame:
    """Blank the DOIs that more than `most` records carry whose titles disagree: they name no work.

    Titles agree if at least half of their words, on average, stand in most of them. A DOI with fewer than two titles can't be told and is blanked too.
    """
    hot = cut(records.where("doi <> ''").groupBy("doi").agg(F.count("*").alias("_c")).where(F.col("_c") > most).select("doi"))
    titled = records.where("size(main) > 0").join(hot, "doi", "left_semi").select("doi", F.array_distinct("main").alias("main"))
    sizes = titled.groupBy("doi").agg(F.count("*").alias("titles"), F.avg(F.size("main")).alias("words"))
    counts = titled.select("doi", F.explode("main").alias("w")).groupBy("doi", "w").agg(F.count("*").alias("n")).join(sizes, "doi")
    agreed = counts.where("titles >= 2 and 2 * n > titles").groupBy("doi", "words").agg(F.count("*").alias("common")).where("2 * common >= words")
    none = hot.join(agreed, "doi", "left_anti").withColumn("_none", F.lit(True))
    return records.join(none, "doi", "left").withColumn("doi", F.when(F.col("_none").isNull(), F.col("doi")).otherwise("")).drop("_none").select(*records.columns)


def compare(records: DataFrame, window: int = 24, least: float = 2.0, common_share: float = 0.004) -> DataFrame:
    """(src_a, id_a, src_b, id_b, score) for all pairs in a common window that score at least `least`, each once, (src, id) ascending."""
    total = max(1, records.count())
    given = records.select(F.explode("names").alias("t")).groupBy("t").agg(F.count("*").alias("c")).where(F.col("c") >= max(4, common_share * total))
    common = frozenset(r[0] for r in given.select("t").collect())  # at most names per record / common_share words
    fields = [c.split()[0] for c in SCHEMA.split(", ")][2:]

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        n = len(pdf)
        src, ids, pas, halo = (pdf[c].to_numpy() for c in ("src", "id", "pass", "halo"))
        rows = list(zip(*[pdf[c].tolist() for c in fields]))
        rows = [(r[0], r[1], r[2], r[3], list(r[4]), list(r[5]), r[6], r[7], list(r[8]), list(r[9]), r[10]) for r in rows]
        bits = np.zeros((n, 2), np.uint64)
        for i, r in enumerate(rows):
            for w in r[4]:
                h = zhash(w)
                bits[i, (h >> 6) & 1] |= np.uint64(1 << (h & 63))
        size = np.bitwise_count(bits).sum(1)
        doi = np.array([zhash(r[7]) if r[7] else -1 - i for i, r in enumerate(rows)])
        done: set[tuple[int, int]] = set()
        out = []
        for o in range(1, min(window, n)):
            a, b = slice(0, n - o), slice(o, n)
            shared = np.bitwise_count(bits[a] & bits[b]).sum(1)
            small = np.minimum(size[a], size[b])
            may = (pas[a] == pas[b]) & ~((src[a] == src[b]) & (ids[a] == ids[b])) & ~(halo[a] & halo[b])
            may &= (shared >= 0.5 * small) | (doi[a] == doi[b])
            for i in np.flatnonzero(may):
                j = int(i) + o
                p, q = ((src[i], ids[i]), (src[j], ids[j]))
                if q < p:
                    p, q = q, p
                if (p, q) in done:
                    continue
                done.add((p, q))
                s = pair_score(rows[i], rows[j], common)
                if s >= least:
                    out.append((*p, *q, s))
        return pd.DataFrame(out, columns=["src_a", "id_a", "src_b", "id_b", "score"])

    blocks = windows(sort_keys(records), window)
    found = blocks.groupBy("block").applyInPandas(scan, "src_a int, id_a bigint, src_b int, id_b bigint, score double")
    return found.groupBy("src_a", "id_a", "src_b", "id_b").agg(F.max("score").alias("score"))


def zhash(w: str) -> int:
    h = 2166136261
    for c in w:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h ^ (h >> 15)


def hungarian(cost: np.ndarray) -> list[int]:
    """Column of each row (-1: none) so that the sum of `cost` is least; rows <= columns (shortest augmenting paths)."""
    n, m = cost.shape
    u, v, way, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], np.inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1, j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def assign(scores: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """One-to-one assignment of the works in one component, (left, right): the pairs of the greatest total confidence.

    Shortest augmenting paths over the pairs that exist, so a search visits what is near only; to stay alone costs nothing.
    """
    near: dict = defaultdict(list)
    for (x, y), s in sorted(scores.items()):
        near[x].append(((0, y), -confidence(s) - 1e-4 * s))
    u, v, match = defaultdict(float), defaultdict(float), {}
    for x in near:
        near[x].append(((1, x), 0.0))  # alone
        dist, way, done, heap = {}, {}, {}, []
        row, base = x, 0.0
        while True:
            for col, c in near[row]:
                d = base + c - u[row] - v[col]
                if col not in done and d < dist.get(col, np.inf):
                    dist[col], way[col] = d, row
                    heapq.heappush(heap, (d, col))
            base, col = heapq.heappop(heap)
            while col in done:
                base, col = heapq.heappop(heap)
            if col not in match:
                break
            done[col] = base
            row = match[col]
        for j, d in done.items():
            u[match[j]] += base - d
            v[j] -= base - d
        u[x] += base
        held = {match[j]: j for j in done}
        while True:
            row = way[col]
            match[col], col = row, held.get(row)
            if row == x:
                break
    return sorted((x, col[1]) for col, x in match.items() if col[0] == 0)


def dominant(edges: DataFrame) -> DataFrame:
    """(l, r, score): one-to-one pairs of a table l, r, score too large for one task: mutual best pairs are taken and their ends removed, until none is left.

    No pair of two free works remains, and the total is at least half of the greatest.
    """
    taken, rest = [], cut(edges)
    order = lambda o: F.max(F.struct("score", F.xxhash64("l", "r").alias("h"), o)).alias("m")
    while rest.limit(1).count():
        one = rest.groupBy("l").agg(order("r")).select("l", F.col("m.r").alias("r"), F.col("m.score").alias("score"))
        two = rest.groupBy("r").agg(order("l")).select(F.col("m.l").alias("l"), "r")
        taken.append(cut(one.join(two, ["l", "r"])))
        rest = cut(rest.join(taken[-1].select("l"), "l", "left_anti").join(taken[-1].select("r"), "r", "left_anti").select("l", "r", "score"))
    return reduce(DataFrame.unionByName, [t.select("l", "r", "score") for t in taken], edges.limit(0))


def assign_works(works: DataFrame, largest: int | None = None) -> DataFrame:
    """(l, r, score): the one-to-one pairs of greatest total confidence among works (l, r, score), a component per task."""
    parts = cut(connected_components(works, "l", "r"))
    placed = works.join(parts, F.col("l") == F.col("node")).drop("node")
    if largest is not None:
        placed = cut(placed.join(placed.groupBy("component").agg(F.count("*").alias("size")), "component"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby("component"):
            scores = dict(zip(zip(g["l"], g["r"]), g["score"]))
            out += [(x, y, scores[x, y]) for x, y in assign(scores)]
        return pd.DataFrame(out, columns=["l", "r", "score"])

    tasks = int(works.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    small = (placed if largest is None else placed.where(F.col("size") <= largest)).withColumn("_g", F.pmod(F.xxhash64("component"), F.greatest(F.lit(tasks), F.lit(1))))
    small = small.repartition(tasks, "_g").sortWithinPartitions("component")
    solved = small.select("component", "l", "r", "score").mapInPandas(_by_component(solve), "l bigint, r bigint, score double")
    return solved if largest is None else solved.unionAll(dominant(placed.where(F.col("size") > largest).select("l", "r", "score")))


def match_works(left: DataFrame, right: DataFrame, left_key: str, right_key: str, window: int = 24, threshold: float = 4.0, largest: int | None = None) -> DataFrame:
    """(left id, right id, confidence): entries of both sources that describe the same work.

    Both tables have title, doi, year, journal, authors besides their key; rows with a null key are left out, every other
    field may be null or dirty, and other columns are ignored. Repeated rows count once. Entries of one source that pair are one work,
    by connected components; works are assigned one to one by the best score of their entries, and all their entries are read out by join. Every
    component is assigned exactly, whatever its size; only a caller that names `largest` has those of more pairs assigned by rounds of mutual best pairs.
    """
    records = read_records(left, 0, left_key).unionAll(read_records(right, 1, right_key)).dropDuplicates(["src", "id"])
    records = cut(without_placeholders(cut(records)))
    pairs = cut(compare(records, window).where(F.col("score") >= threshold))
    node = lambda s: F.col(f"id_{s}") * 2 + F.col(f"src_{s}")
    edges = pairs.select("score", (F.col("src_a") == F.col("src_b")).alias("within"), node("a").alias("na"), node("b").alias("nb"))
    grouped = cut(connected_components(edges.where("within"), "na", "nb"))
    across = edges.where("not within")  # source 0 stands first
    as_work = lambda c, o: F.coalesce(F.col(c), F.col(o))
    works = across.join(grouped.toDF("na", "wa"), "na", "left").join(grouped.toDF("nb", "wb"), "nb", "left")
    works = cut(works.groupBy(as_work("wa", "na").alias("l"), as_work("wb", "nb").alias("r")).agg(F.max("score").alias("score")))
    found = assign_works(works, largest)
    members = grouped.select("component", F.shiftright("node", 1).alias("id"))
    found = found.join(members.toDF("l", "_l"), "l", "left").join(members.toDF("r", "_r"), "r", "left")
    share = 1 / (1 + F.exp(-(F.col("score") - 4.0)))
    return found.select(F.coalesce("_l", F.shiftright("l", 1)).alias(left_key), F.coalesce("_r", F.shiftright("r", 1)).alias(right_key), share.alias("confidence"))


def _by_component(solve):
    """Run `solve` over whole components of a partition sorted by component; batches end anywhere, so the last component is carried over."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in frames:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = pdf["component"].iloc[-1]
            held = pdf[pdf["component"] == last]
            ready = pdf[pdf["component"] != last]
            if len(ready):
                yield solve(ready)
        if held is not None and len(held):
            yield solve(held)

    return run
