"""Evaluation texts leaking into a corpus: a BM25 index of the test items with block-max WAND, queried by every passage.

Each document is cut into overlapping passages; each passage is a query against the inverted index of the items. The impacts of an
item are divided by its own full score, so one threshold stands for the same share of any item. Items above it are
verified by aligning their words with the document, in order, with room for misspelt, added and dropped words.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Container, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.distance import osa

#: Items that one index holds; more are searched in as many passes over the documents as it needs.
PART = 20_000
BLOCK = 16
K1, B = 1.2, 0.75
WINDOW, STRIDE = 128, 64
_WORD = re.compile(r"[^\W_]+")
_BROKEN = re.compile(r"[-­‐‑¬]\s*\n\s*")


def words(text: str) -> list[str]:
    """Lower-case words; a word broken at a line end is put together."""
    return _WORD.findall(_BROKEN.sub("", text).lower())


def counts(texts: list[list[str]]) -> tuple[int, int, Counter]:
    """(items, words, items by word)."""
    return len(texts), sum(map(len, texts)), Counter(t for ws in texts for t in set(ws))


class Index:
    """BM25 impacts of the items, as postings in blocks with the greatest impact of each block and list. `whole`: (items, words, items by word) of all items, where these are only a part of them."""

    def __init__(self, items: list[tuple[int, str, str]], whole: tuple[int, int, Counter] | None = None):
        self.ids = [i for i, _, _ in items]
        self.texts = [words(t) for _, t, _ in items]
        self.bigrams = [set(zip(t, t[1:])) for t in self.texts]
        self.answers = [words(a or "") for _, _, a in items]
        n, length, df = whole or counts(self.texts)
        mean = length / max(1, n)
        self.known = df
        self.postings: dict[str, tuple[np.ndarray, ...]] = {}
        self.most: dict[str, float] = {}
        lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, ws in enumerate(self.texts):
            impact = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(ws) / mean)) for t, c in Counter(ws).items()}
            full = sum(impact.values()) or 1.0
            for t, w in impact.items():
                lists[t].append((i, w / full))
        self.size, self.blocks = len(items), -(-len(items) // BLOCK)
        for t, ps in lists.items():
            ids, ws = np.array([i for i, _ in ps]), np.array([w for _, w in ps])
            own, first = np.unique(ids // BLOCK, return_index=True)
            self.postings[t] = (ids, ws, ids // BLOCK, own, np.maximum.reduceat(ws, first))
            self.most[t] = float(ws.max())

    def search(self, terms: set[str], threshold: float) -> list[tuple[int, float]]:
        """Items whose impacts in `terms` sum to the threshold or more. Nothing above is missed.

        Block-max WAND, a block at a time: lists are weighed by their greatest impacts first, then by the greatest of each block of
        items; only blocks whose bounds reach the threshold are opened and scored.
        """
        own = [t for t in terms if t in self.postings]
        if sum(self.most[t] for t in own) < threshold:
            return []
        bound = np.zeros(self.blocks)
        for t in own:
            _, _, _, blocks, maxima = self.postings[t]
            bound[blocks] += maxima
        opened = bound >= threshold
        if not opened.any():
            return []
        score = np.zeros(self.size)
        for t in own:
            ids, ws, at, _, _ = self.postings[t]
            inside = opened[at]
            score[ids[inside]] += ws[inside]
        return [(int(i), float(score[i])) for i in np.flatnonzero(score >= threshold)]


@lru_cache(maxsize=1 << 17)
def _letters(w: str) -> int:
    bits = 0
    for c in w:
        bits |= 1 << (ord(c) & 63)
    return bits


def same(a: str, b: str) -> bool:
    """Equal but for one edit, or two from six letters on; words of up to three letters must be equal."""
    if a == b:
        return True
    least = min(len(a), len(b))
    most = 0 if least < 4 else 1 if least < 6 else 2
    return bool(most) and abs(len(a) - len(b)) <= most and (_letters(a) ^ _letters(b)).bit_count() <= 2 * most and osa(a, b, most) <= most


def aligned(item: list[str], text: list[str], known: Container[str] = ()) -> tuple[int, int, int]:
    """(matched words, first position, end position) of the best local alignment of `item` in `text`, words in order.

    A match counts 1, a skipped word of the item or a replaced one costs 0.4, one of the text 0.3; so a short interruption is
    bridged and chance words far off are not worth their way. Words in `known` are spelt right and stand for themselves only.
    """
    n = len(item)
    vocabulary: dict[str, list[bool]] = {}
    score, hits, start = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    best = (0.0, 0, 0, 0)
    for j, w in enumerate(text):
        like = vocabulary.get(w)
        if like is None:
            like = vocabulary[w] = [x == w for x in item] if w in known else [same(x, w) for x in item]
        diagonal, dh, ds = 0.0, 0, j
        for i in range(1, n + 1):
            s, h, b = score[i] - 0.3, hits[i], start[i]
            if score[i - 1] - 0.4 > s:
                s, h, b = score[i - 1] - 0.4, hits[i - 1], start[i - 1]
            if like[i - 1]:
                if diagonal + 1 > s:
                    s, h, b = diagonal + 1, dh + 1, ds if dh else j
            elif diagonal - 0.4 > s:
                s, h, b = diagonal - 0.4, dh, ds
            diagonal, dh, ds = score[i], hits[i], start[i]
            if s <= 0:
                s, h, b = 0.0, 0, j + 1
            score[i], hits[i], start[i] = s, h, b
            if s > best[0]:
                best = (s, h, b, j + 1)
    return best[1], best[2], best[3]


def leaks(documents: DataFrame, items: DataFrame, retrieve: float = 0.22, share: float = 0.42, least: int = 8) -> DataFrame:
    """(doc_id, item_id, share, matched, answer_near): documents that hold an item, with the share of its words found in order.

    `documents`: doc_id, text; `items`: item_id, text, answer. Every passage of every document is searched; null and empty
    texts, and items of no words, have no row. Repeated items and documents give repeated findings once. `retrieve` is the share of an item's BM25 score
    a passage must reach, `share` the share of its words that must stand in order, `least` the fewest such words.
    """
    rows = items.where("item_id is not null and text is not null").dropDuplicates(["item_id"])
    parts = max(1, -(-rows.count() // PART))
    part = lambda p: [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p).select("item_id", "text", "answer").orderBy("item_id").collect() if r[1].strip()]  # noqa: E731 - at most about PART items
    whole = None
    if parts > 1:  # weights are those of all items, so the findings don't depend on the number of parts
        whole = (0, 0, Counter())
        for p in range(parts):
            whole = tuple(x + y for x, y in zip(whole, counts([words(t) for _, t, _ in part(p)])))
    found = None
    for p in range(parts):
        sent = documents.sparkSession.sparkContext.broadcast((part(p), whole))

        def scan(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = Index(*sent.value)
            for pdf in frames:
                out = []
                for doc, text in zip(pdf["doc_id"], pdf["text"]):
                    out += [(doc, *x) for x in scan_text(index, text, retrieve, share, least)]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "share", "matched", "answer_near"])

        texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
        one = texts.mapInPandas(scan, "doc_id bigint, item_id bigint, share double, matched int, answer_near boolean")
        found = one if found is None else found.unionAll(one)
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"), F.max("matched").alias("matched"), F.max("answer_near").alias("answer_near"))


def scan_text(index: Index, text: str, retrieve: float, share: float, least: int) -> list[tuple[int, float, int, bool]]:
    """(item, share, matched, answer near) of one text."""
    ws = words(text)
    if sum(index.most.get(t, 0.0) for t in set(ws)) < retrieve:
        return []
    spans: dict[int, list[list[int]]] = {}
    for at in range(0, max(1, len(ws) - STRIDE), STRIDE):
        for i, _ in index.search(set(ws[at : at + WINDOW]), retrieve):
            n = len(index.texts[i])
            lo, hi = max(0, at - n), min(len(ws), at + WINDOW + n)
            own = spans.setdefault(i, [])
            if own and own[-1][1] >= lo:
                own[-1][1] = hi
            else:
                own.append([lo, hi])
    out = []
    for i, own in spans.items():
        need = max(2, 0.2 * len(index.texts[i]))  # neighbouring words that any such passage keeps
        own = [x for x in own if sum(b in index.bigrams[i] for b in zip(ws[x[0] : x[1]], ws[x[0] + 1 : x[1]])) >= need]
        if not own:
            continue
        best = max((aligned(index.texts[i], ws[lo:hi], index.known) + (lo,) for lo, hi in own), key=lambda x: x[0])
        n, first, end, lo = best
        if n >= least and n >= share * len(index.texts[i]):
            answer = index.answers[i]
            near = ws[max(0, lo + first - 12) : lo + end + 12]
            has = bool(answer) and any(near[k : k + len(answer)] == answer for k in range(len(near)))
            out.append((index.ids[i], n / len(index.texts[i]), n, has))
    return out
