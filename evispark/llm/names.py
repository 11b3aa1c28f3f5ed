"""Variant spellings of names: a join of near name words, then token-order and initial checks.

The distinct words of all names meet by what is left of them once one or two letters are taken out; long words are sharded into tries by their first,
middle and last two letters and walked with a Levenshtein automaton. So each word meets every word within the bounded distance. Rare words next to
a frequent one are read as that one. Names are then rebuilt from corrected words, the order of their parts is settled
by where each word stands in the names whose order is plain, and names with the same parts are one person or organisation.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.distance import osa
from evispark.session import cut, shuffled

# Entries that stand where a name is missing.
PLACEHOLDERS = frozenset(["", "et al", "et al.", "anonymous", "anon", "anon.", "no author", "[no author]", "unknown", "author unknown", "n/a", "na", "none", "null", "not available", "no authors listed", "various", "various authors", "others", "and others", "tba", "tbd", "staff", "-", "--", "?", "editor", "the editors"])
# Titles and degrees.
TITLES = frozenset("dr prof professor phd md mr mrs ms msc bsc dipl ing jr sr sir dsc dphil ii iii iv".split())
# Short forms of given names.
NICKNAMES = {
    "abby": "abigail", "alex": "alexander", "sasha": "alexander", "tony": "anthony", "ben": "benjamin", "benny": "benjamin", "chris": "christopher", "kit": "christopher", "dan": "daniel", "danny": "daniel",
    "dima": "dmitri", "katya": "ekaterina", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lizzy": "elizabeth", "paco": "francisco", "pancho": "francisco", "fred": "frederick", "freddy": "frederick", "fritz": "frederick", "beppe": "giuseppe", "pino": "giuseppe",
    "jen": "jennifer", "jenny": "jennifer", "hans": "johannes", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "len": "leonard", "lenny": "leonard", "leo": "leonard", "peggy": "margaret", "maggie": "margaret", "meg": "margaret", "matt": "matthew", "mike": "michael", "mick": "michael",
    "nick": "nicholas", "pat": "patricia", "patty": "patricia", "trish": "patricia", "becky": "rebecca", "becca": "rebecca", "dick": "richard", "rick": "richard", "rich": "richard", "bob": "robert", "rob": "robert", "bobby": "robert", "sam": "samuel", "sammy": "samuel",
    "steve": "stephen", "sue": "susanna", "susie": "susanna", "ted": "theodore", "teddy": "theodore", "theo": "theodore", "tom": "thomas", "tommy": "thomas", "vicky": "victoria", "tori": "victoria", "bill": "william", "will": "william", "billy": "william", "joe": "joseph", "jim": "james", "jack": "john", "andy": "andrew", "dave": "david", "greg": "gregory", "ed": "edward", "gabe": "gabriel", "nate": "nathaniel", "larry": "lawrence", "charlie": "charles", "misha": "mikhail", "kolya": "nikolai", "vanya": "ivan", "pepe": "jose", "nacho": "ignacio", "toni": "antonia",
}
# Words of collective names and how they are shortened.
COLLECTIVE = frozenset("group institute consortium laboratory team collaboration society committee network council agency survey university department centre center association foundation initiative project programme board commission".split())
SHORT = {"natl": "national", "nat": "national", "lab": "laboratory", "labs": "laboratory", "tm": "team", "collab": "collaboration", "inst": "institute", "univ": "university", "grp": "group", "gp": "group", "wg": "working group", "workgroup": "working group", "consort": "consortium", "cons": "consortium", "res": "research", "soc": "society", "comm": "committee", "dept": "department", "ctr": "centre", "center": "centre", "assoc": "association", "int": "international", "intl": "international"}
DROPPED = frozenset("the of for on and in members a".split())
#: Names up to which a word has too few bearers to tell a misspelling from a word of its own; above, ratios and shared bearers decide.
THIN = 3
PARSED = "name string, words array<string>, roles array<string>, initials string"


def plain(text: str) -> str:
    """Without accents, case kept."""
    t = text
    for a, b in (("ø", "o"), ("Ø", "O"), ("ß", "ss"), ("ł", "l"), ("Ł", "L"), ("đ", "d"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe")):
        t = t.replace(a, b)
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


def is_placeholder(text: str | None) -> bool:
    return text is None or re.sub(r"\s+", " ", text).strip().lower().strip("[]() ") in PLACEHOLDERS or not re.search(r"[^\W\d_]", text)


def parse(text: str) -> tuple[list[str], list[str], str]:
    """(words, roles, initials): role f (family), g (given) or u (either), per word of two letters or more; initials in order, lower case."""
    t = re.sub(r"\((?:members|group|eds?\.?)\)", " ", plain(text), flags=re.I)
    t = re.sub(r"(?<=[A-Za-z.])\d+(?:\s*,\s*\d+)*\s*$", "", re.sub(r"[*†‡§¶]", " ", t).strip())
    parts = [p for p in re.split(r"[;,]", t) if p.strip()]
    parts = [p for p in parts if re.sub(r"[^a-z]", "", p.lower()) not in TITLES] or parts
    words, roles, initials, ends = [], [], "", False
    several = len(parts) > 1
    for k, part in enumerate(parts):
        found = [w for w in re.findall(r"[A-Za-z][A-Za-z.'’-]*", part)]
        found = [w for w in found if re.sub(r"[^a-z]", "", w.lower()) not in TITLES]
        letters = [re.sub(r"[^A-Za-z]", "", w) for w in found]
        caps = [len(x) > 3 and x.isupper() for x in letters]
        for i, (w, x) in enumerate(zip(found, letters)):
            if len(x) == 1 or re.fullmatch(r"(?:[A-Za-z]\.){2,3}[A-Za-z]?", w) or (len(x) <= 3 and x.isupper() and len(found) > 1 and not caps[i]) or (several and k and len(x) <= 3 and x.isupper()):
                initials += x.lower()
                ends = True
                continue
            ends = False
            role = ("f" if k == 0 else "g") if several else "f" if caps[i] and not all(caps) else "g" if any(caps) and not all(caps) else "f" if "-" in w else "u"
            for piece in re.split(r"[-'’.]", w):
                if len(piece) > 1:
                    words.append(piece.lower())
                    roles.append(role)
    if not several and ends:  # family first, initials last
        roles = ["f"] * len(words)
    elif not several and initials and len(words) == 1:
        roles = ["f"]
    return words, roles, initials


class Automaton:
    """Levenshtein automaton of one word for at most k edits; states are the live cells of the edit row, remembered once built."""

    def __init__(self, word: str, k: int):
        self.word, self.k, self.steps = word, k, {}
        self.start = tuple((i, i) for i in range(min(k, len(word)) + 1))

    def step(self, state: tuple, c: str) -> tuple:
        key = (state, c)
        found = self.steps.get(key)
        if found is None:
            k, word, cells, out = self.k, self.word, dict(state), []
            left = k + 1
            low = state[0][0]
            for i in range(low, min(len(word), state[-1][0] + k + 1) + 1):
                v = cells.get(i, k + 1) + 1
                if i:
                    v = min(v, left + 1, cells.get(i - 1, k + 1) + (word[i - 1] != c))
                left = v
                if v <= k:
                    out.append((i, v))
            found = self.steps[key] = tuple(out)
        return found

    def accepts(self, state: tuple) -> bool:
        return bool(state) and state[-1][0] == len(self.word)


def trie(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w
    return root


def neighbours(root: dict, word: str, k: int) -> list[str]:
    """All words of the trie within k edits (insert, delete, replace) of `word`, itself left out."""
    a = Automaton(word, k)
    out, stack = [], [(root, a.start)]
    while stack:
        node, state = stack.pop()
        for c, child in node.items():
            if c == "":
                if child != word and a.accepts(state):
                    out.append(child)
            else:
                nxt = a.step(state, c)
                if nxt:
                    stack.append((child, nxt))
    return out


def bound(n: int) -> int:
    """Edits allowed for a word of n letters; a swap of neighbours counts as two."""
    return 0 if n < 4 else 2


#: Letters up to which words meet by common deletions; longer ones, of which there are few, by tries.
SHORT_WORD = 20


def trie_join(words: DataFrame, part: int = 1_000) -> DataFrame:
    """(a, b, d): all pairs of distinct words, a <> b, within the bound of the shorter by insert, delete, replace and swap.

    `words`: column w, distinct, lower case. Words of up to SHORT_WORD letters meet by what is left of them without one or two letters, longer ones by
    sharded tries; both take in the lengths at the border, so a pair across it meets too.
    """
    short = _meet_by_deletions(words.where(f"length(w) between 4 and {SHORT_WORD}"))
    once = short.unionByName(_meet_by_tries(words.where(f"length(w) >= {SHORT_WORD - 1}"), part)).distinct()
    return once.unionAll(once.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))


def _meet_by_deletions(words: DataFrame) -> DataFrame:
    """(a, b, d), a < b, by equi-join: words within k edits are equal once at most k letters are taken from each, so no word is compared with one that isn't near. A key's words are bounded by the letters that can be put in."""
    less = lambda x, i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1))
    n = F.length("w")
    one = F.transform(F.sequence(F.lit(1), n), lambda i: less(F.col("w"), i))
    two = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(i, n - 1), lambda j: less(less(F.col("w"), i), j))))
    keys = F.array_distinct(F.concat(F.array("w"), one, F.when(n >= 6, two).otherwise(F.array().cast("array<string>"))))
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = words.select("w").repartition(tasks, "w").select("w", F.explode(F.transform(keys, lambda x: F.xxhash64(x))).alias("key"))
    j = k.withColumnRenamed("w", "a").join(shuffled(k.withColumnRenamed("w", "b")), "key").where("a < b and abs(length(a) - length(b)) <= 2")
    j = j.withColumn("lev", F.levenshtein("a", "b", 2)).where("lev >= 0").select("a", "b", "lev").distinct()
    cross = F.exists(F.sequence(F.lit(1), F.length("a") - 1), lambda i: F.concat(F.substr("a", F.lit(1), i - 1), F.substr("a", i + 1, F.lit(1)), F.substr("a", i, F.lit(1)), F.substr("a", i + 2)) == F.col("b"))
    d = F.when((F.col("lev") == 2) & (F.length("a") == F.length("b")) & cross, 1).otherwise(F.col("lev"))
    return j.select("a", "b", d.alias("d")).where("d <= if(least(length(a), length(b)) < 6, 1, 2)")


def _meet_by_tries(words: DataFrame, part: int) -> DataFrame:
    """(a, b, d), a < b. A pair within two edits keeps its first two letters, its last two, or, if one edit touches
    each end, two letters in its middle at most two places off; so each word is stored under those three and looks them up. Shards of more than
    `part` words are split, and every part is searched by all words of the shard, in as many slices.
    """
    bigram = lambda kind, at: F.concat(F.lit(kind), F.substring("w", at, 2) if isinstance(at, int) else at)
    middle = F.floor(F.length("w") / 2).cast("int")
    mid = lambda off: F.concat(F.lit("M"), F.substr("w", F.greatest(F.lit(1), middle + off), F.lit(2)))
    base = words
    stored = base.select("w", F.explode(F.array(bigram("F", 1), F.concat(F.lit("L"), F.expr("right(w, 2)")), mid(0))).alias("shard"))
    asked = base.select("w", F.explode(F.array_distinct(F.array(bigram("F", 1), F.concat(F.lit("L"), F.expr("right(w, 2)")), *[mid(o) for o in range(-2, 3)]))).alias("shard"))
    parts = stored.groupBy("shard").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    spread = F.pmod(F.xxhash64("w"), F.col("parts").cast("long")).cast("int")
    stored = stored.join(shuffled(parts), "shard").select("shard", spread.alias("p"), "parts", "w").select("shard", "p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("s"), F.lit(0).alias("asks"), "w")
    asked = asked.join(shuffled(parts), "shard").select("shard", spread.alias("s"), "parts", "w").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), "s", F.lit(1).alias("asks"), "w")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        root = trie(pdf["w"][pdf["asks"] == 0].tolist())
        out = []
        for w in pdf["w"][pdf["asks"] == 1]:
            for v in neighbours(root, w, bound(len(w))):
                if w < v:
                    d = osa(w, v, 2)
                    if d <= (1 if min(len(w), len(v)) < 6 else 2):
                        out.append((w, v, d))
        return pd.DataFrame(out, columns=["a", "b", "d"])

    tasks = 4 * int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored.unionByName(asked).repartition(tasks, "shard", "p", "s")  # few bytes, much work: not to be put together
    return rows.groupBy("shard", "p", "s").applyInPandas(walk, "a string, b string, d int")


def corrections(tokens: DataFrame, pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(w, to): misspelt words and the more frequent given name or collective word they stand for.

    `tokens`: w, c (names that hold it), g and f (names where its place shows a given or a family name); `words`: name, w. A neighbour
    is 8 times as frequent, or at least twice and stands with the other parts of a quarter of the word's names. Up to THIN names say too little against
    it, and twice is enough; the bound leaves no word out, so the answer doesn't wear off as the table grows. Family names need more than a
    neighbour and are settled later, by who bears them.
    """
    a, b = tokens.select(F.col("w").alias("a"), F.col("c").alias("ca"), F.col("f").alias("fa")), tokens.select(F.col("w").alias("b"), F.col("c").alias("cb"), "g", "f")
    target = ((F.col("g") >= 3) & (F.col("g") >= 3 * F.col("f"))) | F.col("b").isin([*COLLECTIVE, *SHORT, *NICKNAMES, *NICKNAMES.values()])
    j = cut(pairs.join(shuffled(a), "a").join(shuffled(b.where(target)), "b").where(F.col("cb") >= F.when(F.col("d") == 1, 2).otherwise(3) * F.col("ca")))
    other = words.where(~F.col("w").isin([*COLLECTIVE, *SHORT, *DROPPED])).select("name", F.col("w").alias("other"))
    beside = words.select("name", "w").distinct().join(shuffled(other.distinct()), "name").where("w <> other")
    mine = beside.join(shuffled(j.select(F.col("a").alias("w")).distinct()), "w").select(F.col("w").alias("a"), "name", "other")
    yours = beside.join(shuffled(j.select(F.col("b").alias("w")).distinct()), "w").select(F.col("w").alias("b"), "other").distinct()
    held = j.select("a", "b").join(shuffled(mine), "a").join(shuffled(yours), ["b", "other"]).groupBy("a", "b").agg(F.countDistinct("name").alias("both"))
    j = j.join(shuffled(mine.groupBy("a").agg(F.countDistinct("name").alias("n"))), "a", "left").join(shuffled(held), ["a", "b"], "left").withColumn("share", F.coalesce(F.col("both") / F.col("n"), F.lit(0.0)))
    far = (F.col("cb") >= 8 * F.col("ca")) & ((2 * F.col("fa") <= F.col("ca")) | F.col("b").isin([*COLLECTIVE, *SHORT]))
    near = F.when(F.col("d") == 1, far | (F.col("ca") <= THIN) | (F.col("share") >= 0.25)).otherwise((F.col("share") >= 0.25) & (F.length("a") >= 6))
    j = cut(j.where(near))
    wrong = j.where("d = 1 and cb >= 8 * ca").select(F.col("a").alias("b")).distinct()  # misspelt themselves, so no targets
    best = j.join(shuffled(wrong), "b", "left_anti").groupBy("a").agg(F.min(F.struct("d", (-F.col("share")).alias("s"), (-F.col("cb")).alias("c"), "b")).alias("m"))
    return best.select(F.col("a").alias("w"), F.col("m.b").alias("to"))


def parsed(names: DataFrame) -> DataFrame:
    """Parsed distinct names of column `name`; placeholders and blank entries are left out."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(n, *parse(n)) for n in pdf["name"] if not is_placeholder(n)]
            yield pd.DataFrame([r for r in rows if r[1]], columns=["name", "words", "roles", "initials"])

    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return names.select("name").where("name is not null").distinct().repartition(tasks, "name").mapInPandas(read, PARSED)


def entities(names: DataFrame) -> DataFrame:
    """(name, entity): distinct names, exactly as typed, with a key of who they name.

    `names`: column `name`, repeats and nulls allowed. Null, blank and placeholder entries have no row; an empty table gives no
    rows. A name with initials goes with the full name of its family that they fit, if there is just one; if several fit, it stays
    by itself with names of the same initials left apart, since those may be different people.
    """
    base = cut(parsed(names))
    words = base.select("name", F.posexplode(F.arrays_zip("words", "roles")).alias("pos", "x")).select("name", "pos", F.col("x.words").alias("w"), F.col("x.roles").alias("role"))
    role = lambda r: F.sum((F.col("role") == r).cast("int"))
    tokens = cut(words.groupBy("w").agg(F.countDistinct("name").alias("c"), role("g").alias("g"), role("f").alias("f")))
    pairs = cut(trie_join(tokens.select("w")))
    fixed = cut(corrections(tokens, pairs, words))
    right = words.join(shuffled(fixed), "w", "left").select("name", "pos", "role", F.coalesce("to", "w").alias("w"))
    places = right.groupBy("w").agg(role("g").alias("g"), role("f").alias("f"))
    known = right.join(shuffled(places.select("w", ((F.col("g") + 0.5) / (F.col("g") + F.col("f") + 1)).alias("as_given"))), "w")
    spelt = known.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("pos", "w", "role", "as_given"))).alias("ws"))  # the words of one name
    spelt = spelt.join(shuffled(base.select("name", "initials")), "name")

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(n, *assemble([(x["w"], x["role"], x["as_given"]) for x in ws], i)) for n, ws, i in zip(pdf["name"], pdf["ws"], pdf["initials"])]
            yield pd.DataFrame(rows, columns=["name", "family", "given", "initials"])

    made = cut(spelt.mapInPandas(build, "name string, family string, given string, initials string"))
    made = made.withColumn("first", F.when(F.col("given") != "", F.substring("given", 1, 1)).otherwise(F.substring("initials", 1, 1)))
    moved = cut(_rare_families(made, pairs))
    parts = made.where("family not like 'org %'").select("name", "first", F.posexplode(F.split("family", " ")).alias("pos", "w"))
    respelt = parts.join(shuffled(moved), ["w", "first"], "left").groupBy("name").agg(F.array_sort(F.collect_list(F.coalesce("to", "w"))).alias("fs"))  # the words of one name
    made = cut(made.join(shuffled(respelt), "name", "left").withColumn("family", F.coalesce(F.array_join("fs", " "), "family")).drop("fs"))
    halves = _half_families(made)
    made = cut(made.join(shuffled(halves), ["family", "first", "given"], "left").withColumn("family", F.coalesce("to", "family")).drop("to"))
    orgs = _rare_collectives(made, pairs)
    made = cut(made.join(shuffled(orgs), "family", "left").withColumn("family", F.coalesce("to", "family")).drop("to"))
    full = made.where("given <> ''").groupBy("family", "first").agg(F.countDistinct("given").alias("k"), F.min("given").alias("only"))
    middle = F.when(F.col("given") == "", F.substring("initials", 2, 1)).otherwise(F.substring("initials", 1, 1))
    made = made.withColumn("middle", middle)
    by_middle = made.where("given <> '' and middle <> ''").groupBy("family", "first", "middle").agg(F.countDistinct("given").alias("km"), F.min("given").alias("only_m"))
    j = made.join(shuffled(full), ["family", "first"], "left").join(shuffled(by_middle), ["family", "first", "middle"], "left")
    who = (
        F.when(F.col("given") != "", F.col("given"))
        .when(F.col("first") == "", "")
        .when(F.col("k").isNull(), F.concat("first", F.lit(".")))
        .when(F.col("k") == 1, F.col("only"))
        .when(F.col("km") == 1, F.col("only_m"))
        .otherwise(F.concat(F.lit("?"), "name"))
    )
    return j.select("name", F.concat_ws("|", "family", who).alias("entity"))


def _rare_families(made: DataFrame, pairs: DataFrame) -> DataFrame:
    """(w, first, to): misspelt words of family names, and the better known neighbour they stand for.

    One edit apart, a name of the same given name, or of the same initial where one side has no more, must stand in both;
    two edits apart, the full given name. How often a word stands in all is no measure, as it grows with the table: one edit apart,
    the neighbour is four times as frequent, or twice and most bearers of the word bear it too; two edits apart, all of them do, and none has the word twice.
    Words of up to THIN names need only the better known neighbour.
    """
    people = made.where("first <> '' and family not like 'org %'").select(F.explode(F.split("family", " ")).alias("w"), "first", "given", "name")
    count = people.groupBy("w").agg(F.count("*").alias("c"))
    has = people.groupBy("w", "first").agg(F.array_remove(F.collect_set("given"), "").alias("gs"), F.count("*").alias("n"))  # given names under one initial
    has = has.join(shuffled(count), "w")
    a = has.select(F.col("w").alias("a"), "first", F.col("gs").alias("ga"), F.col("c").alias("ca"), F.col("n").alias("na"))
    b = has.select(F.col("w").alias("b"), "first", F.col("gs").alias("gb"), F.col("c").alias("cb"), F.col("n").alias("nb"))
    j = cut(pairs.join(shuffled(a), "a").join(shuffled(b), ["b", "first"]))
    bearers = has.groupBy(F.col("w").alias("a")).agg(F.sum(F.size("gs")).alias("bearers"))
    shared = j.groupBy("a", "b").agg(F.sum(F.size(F.array_intersect("ga", "gb"))).alias("shared"))
    j = j.join(shuffled(bearers), "a").join(shuffled(shared), ["a", "b"])
    same = F.arrays_overlap("ga", "gb")
    initial = ((F.size("ga") == 0) | (F.size("gb") == 0)) & (F.col("cb") >= 3)
    better = (F.col("cb") > F.col("ca")) | ((F.col("cb") == F.col("ca")) & (F.col("b") < F.col("a")))
    most = (2 * F.col("shared") > F.col("bearers")) & (F.col("nb") >= F.col("na")) & (F.col("cb") >= 2 * F.col("ca"))
    often = (F.col("ca") <= THIN) | (F.col("cb") >= 4 * F.col("ca")) | most
    once = (F.col("shared") == F.col("bearers")) & (F.col("ca") <= F.col("bearers"))
    near = F.when(F.col("d") == 1, often & (same | initial)).otherwise(once & (F.length("a") >= 7) & same)
    best = j.where(better & near).groupBy("a", "first").agg(F.max(F.struct((-F.col("d")).alias("d"), "cb", "b")).alias("m"))
    one = best.select(F.col("a").alias("w"), "first", F.col("m.b").alias("to"))
    two = one.select(F.col("w").alias("to"), "first", F.col("to").alias("final"))  # a neighbour that moves on itself
    return one.join(shuffled(two), ["to", "first"], "left").select("w", "first", F.coalesce("final", "to").alias("to"))


def _half_families(made: DataFrame) -> DataFrame:
    """(family, first, given, to): single family names that are half of one double name borne with the same given name or initial, and stand no more often alone."""
    people = made.where("first <> '' and family not like 'org %'")
    double = people.where("family like '% %'").select("name", F.explode(F.split("family", " ")).alias("w"), F.col("family").alias("to"), "first", F.col("given").alias("g2"))
    single = people.where("family not like '% %'")
    often = double.groupBy("w").agg(F.count("*").alias("cd")).join(shuffled(single.groupBy(F.col("family").alias("w")).agg(F.count("*").alias("cs"))), "w").where("cs <= cd").select("w")
    names = single.select(F.col("family").alias("w"), "first", "given").distinct().join(shuffled(often), "w")
    wholes = double.select("w", "to", "first", "g2").distinct()
    fits = (F.col("given") == F.col("g2")) | (F.col("given") == "") | (F.col("g2") == "")
    found = names.join(shuffled(wholes), ["w", "first"]).where(fits).groupBy("w", "first", "given").agg(F.countDistinct("to").alias("k"), F.min("to").alias("to"))
    return found.where("k = 1").select(F.col("w").alias("family"), "first", "given", "to")


def _rare_collectives(made: DataFrame, pairs: DataFrame) -> DataFrame:
    """(family, to): collective names that differ from a better known one in a single word, by a neighbour of the trie join; above THIN names it is three times as frequent."""
    orgs = made.where("family like 'org %'").groupBy("family").agg(F.count("*").alias("c"))
    parts = orgs.select("family", "c", F.explode(F.slice(F.split("family", " "), 2, 99)).alias("w"))
    parts = parts.withColumn("rest", F.array_join(F.array_remove(F.split("family", " "), F.col("w")), " "))
    a = parts.select(F.col("family").alias("fa"), F.col("c").alias("ca"), F.col("w").alias("a"), "rest")
    b = parts.select(F.col("family").alias("fb"), F.col("c").alias("cb"), F.col("w").alias("b"), "rest")
    j = pairs.join(shuffled(a), "a").join(shuffled(b), ["b", "rest"]).where(f"(cb > ca or cb = ca and fb < fa) and (ca <= {THIN} or cb >= 3 * ca)")
    one = j.groupBy("fa").agg(F.max(F.struct("cb", "fb")).alias("m")).select(F.col("fa").alias("family"), F.col("m.fb").alias("to"))
    two = one.select(F.col("family").alias("to"), F.col("to").alias("final"))
    return one.join(shuffled(two), "to", "left").select("family", F.coalesce("final", "to").alias("to"))


def assemble(words: list[tuple[str, str, float]], initials: str) -> tuple[str, str, str]:
    """(family, given, initials) of one name from its corrected words; an organisation has all its words, in order of the alphabet, as family."""
    spread = " ".join(SHORT.get(w, w) for w, _, _ in words).split()
    if any(w in COLLECTIVE for w in spread) and (len(spread) > 2 or initials == ""):
        return "org " + " ".join(sorted(w for w in spread if w not in DROPPED)), "", ""
    given = [w for w, r, _ in words if r == "g"]
    family = [w for w, r, _ in words if r == "f"]
    unsure = [(w, s) for w, r, s in words if r == "u"]
    if unsure and not given and not (initials and len(unsure) == 1 and not family):
        if len(unsure) > 1 or family:
            at = 0 if len(unsure) == 1 else max((0, len(unsure) - 1), key=lambda k: (unsure[k][1], -k))
            given = [unsure[at][0]]
            family += [w for k, (w, _) in enumerate(unsure) if k != at]
        else:
            family += [w for w, _ in unsure]
    else:
        family += [w for w, _ in unsure]
    if given and family and len(given) == 1 and len(family) == 1:  # a comma in the wrong place
        share = {w: s for w, _, s in words}
        if share.get(given[0], 0) < 0.2 and share.get(family[0], 0) > 0.8:
            given, family = family, given
    first = NICKNAMES.get(given[0], given[0]) if given else ""
    return " ".join(sorted(family)), first, initials


def variant_pairs(named: DataFrame) -> DataFrame:
    """(name_a, name_b): each pair of different names of one entity, a before b. One entity's spellings are few; the join is on its key."""
    a, b = named.select(F.col("name").alias("name_a"), "entity"), named.select(F.col("name").alias("name_b"), "entity")
    return a.join(shuffled(b), "entity").where("name_a < name_b").select("name_a", "name_b")
