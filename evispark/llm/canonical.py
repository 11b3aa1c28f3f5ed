"""Mapping freely typed values to a reference list.

Distinct values are normalised, candidates come from an inverted index of character trigrams with inverse frequency
weights, and each candidate gets a weighted cosine over aligned words. A value takes the best entry above the threshold if it
leads the runner-up by the margin; all others are reported as unmatched.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.distance import allowed, osa

UNMATCHED = "unmatched"
#: Entries one index may hold; a longer list is searched in as many parts as it needs.
PART = 50_000
# Words that carry no meaning of their own in a typed value.
FILLERS = frozenset("a an the of by in on at for from with and or to this that our work house study method methods technique techniques approach approaches procedure procedures type types".split())
LONG_FILLERS = tuple(f for f in FILLERS if len(f) >= 4)
#: Trigram cosine from which an entry is scored; all that reach it are.
FLOOR = 0.2
#: How a value was read: nothing, an exact name, a short form with part of the name, words scored one by one.
NONE, EXACT, SHORT, SCORED = range(4)


def words(text: str) -> list[tuple[str, bool]]:
    """(word, marked): lower-case runs of letters and digits; marked if a point inside the text follows, as after an abbreviation."""
    low = text.lower().strip()
    return [(m[1], m[2] == "." and m.end() < len(low)) for m in re.finditer(r"([^\W_]+)(.?)", low)]


def _letters(word: str) -> int:
    """The letters of a word as a bit set: words within d edits differ in at most 2 * d of them."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits


def grams(tokens: list[str]) -> set[str]:
    out = set()
    for t in tokens:
        p = f"^{t}$"
        out.update(p[i : i + 3] for i in range(len(p) - 2))
    return out


class Facet:
    """Entries of one facet with their trigram index. `whole`: (entries, words, trigrams) counted over all entries of the facet, where these are only a part of them."""

    def __init__(self, entries: list[tuple[str, list[str]]], whole: tuple[int, Counter, Counter] | None = None):
        self.ids: list[str] = []
        self.forms: list[list[str]] = []
        self.exact: dict[str, set[int]] = defaultdict(set)
        self.short: dict[str, set[int]] = defaultdict(set)
        for element, names in entries:
            own = len(self.ids)
            self.ids.append(element)
            tokens = [w for w, _ in words(names[0])]
            self.forms.append([t for t in tokens if t not in FILLERS] or tokens)
            for n in names:
                ws = [w for w, _ in words(n)]
                if not ws:
                    continue
                if len(ws) == 1 and len(tokens) > 1 and len(ws[0]) < 8:
                    self.short[ws[0]].add(own)
                else:
                    kept = [t for t in ws if t not in FILLERS] or ws
                    self.exact[" ".join(sorted(kept))].add(own)
                    self.exact["".join(ws)].add(own)
        n, df, gram_df = whole or self.counts()
        self.weight = {t: math.log(1 + n / c) for t, c in df.items()}
        self.vocabulary = list(df)
        self.letters = [(v, len(v), _letters(v)) for v in df]
        self.near: dict[tuple[str, bool], dict[str, float]] = {}
        self.gram_weight = {g: math.log(1 + n / c) for g, c in gram_df.items()}
        lists: dict[str, list[int]] = defaultdict(list)
        norm = np.zeros(len(self.forms))
        for i, f in enumerate(self.forms):
            for g in grams(f):
                lists[g].append(i)
                norm[i] += self.gram_weight[g] ** 2
        self.norm = np.sqrt(norm)
        self.lists = {g: np.array(v) for g, v in lists.items()}

    def counts(self) -> tuple[int, Counter, Counter]:
        """(entries, entries by word, entries by trigram)."""
        return len(self.forms), Counter(t for f in self.forms for t in set(f)), Counter(g for f in self.forms for g in grams(f))

    def candidates(self, tokens: list[str]) -> list[int]:
        """All entries whose trigram cosine reaches FLOOR."""
        score, own = np.zeros(len(self.ids)), 0.0
        for g in grams(tokens):
            w = self.gram_weight.get(g)
            own += (w or 1.0) ** 2
            if w and g in self.lists:
                score[self.lists[g]] += w * w
        score /= self.norm * math.sqrt(own or 1.0)
        return np.flatnonzero(score >= FLOOR).tolist()

    def like(self, token: str, marked: bool, last: bool) -> dict[str, float]:
        """Vocabulary words that `token` may stand for, each with a similarity."""
        found = self.near.get((token, marked) if not last else (token + ".", marked))
        if found is not None:
            return found
        found = {}
        known = token in self.weight
        if known:
            found[token] = 1.0
        if (marked or last) and len(token) >= 3:  # cut short: as a word of the list only where the point says so
            longer = [v for v in self.vocabulary if v != token and v.startswith(token)]
            if longer and (marked or not known):
                if marked:
                    found = {token: 0.6} if known else {}
                found |= {v: 0.95 for v in longer}
        if not found:
            for v in self.vocabulary:
                if token in (v + "s", v + "es") or v in (token + "s", token + "es"):
                    found[v] = 0.98
            if not found:
                own, bits = len(token), _letters(token)
                for v, n, other in self.letters if own > 3 else ():
                    most = allowed(max(n, own))
                    if abs(n - own) <= most and (bits ^ other).bit_count() <= 2 * most and (d := osa(token, v, most)) <= most:
                        found[v] = 1 - d / (n + 1)
        self.near[(token, marked) if not last else (token + ".", marked)] = found
        return found

    def score(self, tokens: list[tuple[str, bool]], options: list[dict[str, float]], i: int) -> float:
        """Weighted cosine of the aligned words; 0 if a typed word stands for none of the entry's, or more than one of the entry's is missing."""
        form = self.forms[i]
        left = list(form)
        got = own = 0.0
        rest: list[str] = []
        for k, may in enumerate(options):
            best, sim = None, 0.0
            for o, v in may.items():
                if v > sim and o in left:
                    best, sim = o, v
            if best is None:
                if not any(o in form for o in may):  # else said twice
                    rest.append(tokens[k][0])
                continue
            w = self.weight[best] ** 2
            got += w * sim
            own += w
            left.remove(best)
        if rest:
            initials = "".join(t[0] for t in form)
            rest = [t for t in rest if i not in self.short.get(t, ()) and t != initials]
        if rest or left:
            a, b = "".join(t for t, _ in tokens), "".join(form)
            if len(b) > 8 and abs(len(a) - len(b)) <= 2 and (d := osa(a, b, 2)) <= 2:  # words run together or parted
                return 1 - d / len(b)
        if rest or len(left) > 1 or (left and len(form) < 3) or not own:
            return 0.0
        return got / math.sqrt(own * sum(self.weight[t] ** 2 for t in form))

    def tail(self, tokens: list[tuple[str, bool]], i: int) -> bool:
        """Whether the words beside the short form of entry i are the end of its name, run together or misspelt."""
        typed = "".join(t for t, _ in tokens if i not in self.short.get(t, ()))
        form = self.forms[i]
        return any(osa(typed, end, 2 if len(end) > 7 else 1) <= (2 if len(end) > 7 else 1) for k in range(1, len(form)) if len(end := "".join(form[-k:])) > 3)

    def read(self, text: str) -> list[tuple[int, float, str | None]]:
        """(how, score, entry): what these entries say of a value; `decide` settles it, with what other parts of the facet say."""
        ws = words(text)
        kept = [w for w in ws if w[0] not in FILLERS] or ws
        if not kept:
            return []
        plain = [t for t, _ in kept]
        out: list[tuple[int, float, str | None]] = []
        if not any(m for _, m in kept):
            for hits in (self.exact.get(" ".join(sorted(plain))), self.exact.get("".join(t for t, _ in ws)), self.short.get(plain[0]) if len(plain) == 1 else None):
                if hits:
                    out += [(EXACT, 1.0, self.ids[i]) for i in hits]
                    break
        named = {i for t in plain for i in self.short.get(t, ())}
        if len(kept) > 1:
            out += [(SHORT, 0.9 if self.tail(kept, i) else 0.0, self.ids[i]) for i in named]
        options = [self.like(t, m, k == len(kept) - 1) for k, (t, m) in enumerate(kept)]
        misspelt = [not o and len(t) > 2 and any(osa(t, f, 1) <= 1 for f in LONG_FILLERS) for o, (t, _) in zip(options, kept)]
        if any(misspelt) and not all(misspelt):
            kept, options = [k for k, m in zip(kept, misspelt) if not m], [o for o, m in zip(options, misspelt) if not m]
        if not out or out[0][0] != EXACT:
            scored = sorted(((self.score(kept, options, i), i) for i in {*self.candidates(plain), *named}), reverse=True)
            out += [(SCORED, s, self.ids[i]) for s, i in scored[:2]]  # the best and its rival decide
        return out


def decide(said: list[tuple[int, float, str | None]], threshold: float, margin: float) -> tuple[str | None, float]:
    """(entry or None, score) from all that was read: one exact name, else a short form of one entry beside part of its name, else the best score above the threshold if it leads by the margin."""
    exact = {e for how, _, e in said if how == EXACT}
    if exact:
        return (next(iter(exact)) if len(exact) == 1 else None), 1.0
    short = {e: s for how, s, e in said if how == SHORT}
    if len(short) == 1 and next(iter(short.values())) > 0:
        return next(iter(short)), 0.9
    scored = sorted(((s, e) for how, s, e in said if how == SCORED), reverse=True)
    if not scored or scored[0][0] < threshold or len(scored) > 1 and scored[0][0] - scored[1][0] < margin:
        return None, scored[0][0] if scored else 0.0
    return scored[0][1], scored[0][0]


def _aliases(text: str | None) -> list[str]:
    try:
        found = json.loads(text) if text else []
    except ValueError:
        return []
    return [a for a in found if isinstance(a, str) and a.strip()] if isinstance(found, list) else []


def map_values(values: DataFrame, reference: DataFrame, threshold: float = 0.72, margin: float = 0.02) -> DataFrame:
    """(facet, surface, element_id, score): each distinct value with its entry or `unmatched`.

    `values`: facet, surface; `reference`: element_id, facet, display_name, aliases_json. An entry is a candidate only in its own
    facet. Null or blank values, values of an unknown facet and all values against an empty list are unmatched. Broken alias
    lists count as empty. Values that are an exact name of two entries are unmatched, as no entry leads.
    The list is held in parts of PART entries. Words and trigrams are counted over the whole list first, and the parts' findings are decided together, so
    the answers don't depend on the number of parts.
    """
    rows = reference.select("element_id", "facet", "display_name", "aliases_json").where("element_id is not null and display_name is not null")
    parts = max(1, -(-rows.count() // PART))
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = values.select("facet", "surface").distinct().repartition(tasks, "facet", "surface")  # few bytes, much work
    part = lambda p: rows.where(F.pmod(F.xxhash64("element_id"), F.lit(parts)) == p).orderBy("element_id").collect()  # noqa: E731 - at most about PART entries

    def facets(mine: list, whole: dict[str, tuple[int, Counter, Counter]] | None = None) -> dict[str, Facet]:
        by: dict[str, list] = defaultdict(list)
        for element, facet, name, aliases in mine:
            by[facet].append((element, [name, *_aliases(aliases)]))
        return {f: Facet(e, whole and whole[f]) for f, e in by.items()}

    whole: dict[str, tuple[int, Counter, Counter]] | None = None
    if parts > 1:
        whole = {}
        for p in range(parts):
            for f, index in facets(part(p)).items():
                n, df, gram_df = whole.get(f, (0, Counter(), Counter()))
                m, more, grams_ = index.counts()
                whole[f] = (n + m, df + more, gram_df + grams_)
    found = None
    for p in range(parts):
        sent = values.sparkSession.sparkContext.broadcast(([tuple(r) for r in part(p)], whole))

        def scan(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            own = facets(*sent.value)
            for pdf in frames:
                said = [own[f].read(s) if f in own and s else [] for f, s in zip(pdf["facet"], pdf["surface"])]
                if parts > 1:
                    yield pdf.assign(said=[[{"how": h, "score": float(x), "element_id": e} for h, x, e in r] for r in said])
                else:
                    out = [decide(r, threshold, margin) for r in said]
                    yield pdf.assign(element_id=[o[0] for o in out], score=[float(o[1]) for o in out])

        one = distinct.mapInPandas(scan, "facet string, surface string, " + ("said array<struct<how:int,score:double,element_id:string>>" if parts > 1 else "element_id string, score double"))
        found = one if found is None else found.unionAll(one)
    if parts > 1:
        together = found.groupBy("facet", "surface").agg(F.flatten(F.collect_list("said")).alias("said"))  # a few findings per part

        def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                out = [decide([(x["how"], x["score"], x["element_id"]) for x in r], threshold, margin) for r in pdf["said"]]
                yield pdf[["facet", "surface"]].assign(element_id=[o[0] for o in out], score=[float(o[1]) for o in out])

        found = together.mapInPandas(settle, "facet string, surface string, element_id string, score double")
    return found.withColumn("element_id", F.coalesce("element_id", F.lit(UNMATCHED)))
