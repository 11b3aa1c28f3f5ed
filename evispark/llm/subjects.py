"""Subject areas of documents: classifier chains over term, source and structure features, decoded by beam search.

Term features: weights of words and word pairs for each subject, started on the labelled documents and the subjects'
descriptions and refined by expectation-maximisation over the sentences of all documents; a document is described by the
share of its words in sentences that speak for each subject. Structure features: length, paragraphs, lists, sentences that say nothing.
Source features: hashed source and section kind. A chain of logistic models, one per subject, sees all of these and the labels decided before
it, so it models which subjects go together; the beam keeps the likeliest combinations.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.session import cut, shuffled

#: Characters of text in one chunk.
CHUNK = 4_000_000
#: Labelled documents that the classifier is fitted on, at most.
#: Rows the list of subject areas may have; more raise an error.
MAX_SUBJECTS = 1_000
MAX_LABELLED = 20_000
SOURCE_BINS = 16
_WORD = re.compile(r"[^\W\d_]{2,}")
_SENTENCE = re.compile(r"(?<=[.!?:])\s+|\n+|^\s*[-*•]\s+", re.M)


def sentences(text: str) -> list[list[str]]:
    """Sentences as lists of lower-case words of two letters or more."""
    return [w for s in _SENTENCE.split(text) if s and (w := _WORD.findall(s.lower()))]


# Frequent small words of the languages that are told apart.
SMALL_WORDS = {
    "en": frozenset("the of and for was were that with by from this in is at whenever".split()),
    "de": frozenset("die der das und zu nach von für den im ist auf mit ein eine einer kaum nicht".split()),
    "es": frozenset("el la los las de del para según una un con que en por apenas todavía".split()),
}


def language(ws: list[str]) -> str:
    """The language whose small words a sentence has most of; en where none stands out."""
    return max(SMALL_WORDS, key=lambda x: sum(w in SMALL_WORDS[x] for w in ws))


def terms(ws: list[str]) -> list[str]:
    """Words of three letters or more and neighbouring pairs, each marked with the language of the sentence."""
    at = language(ws)
    return [f"{at}|{w}" for w in ws if len(w) > 2] + [f"{at}|{a} {b}" for a, b in zip(ws, ws[1:])]


class Terms:
    """Log-odds of the terms for each subject.

    `counts`: term and one column per subject; the row of a language with no word, `xx|`, holds the totals over all its terms, those left out as well.
    """

    def __init__(self, counts: pd.DataFrame, subjects: list[str], smooth: float = 0.5):
        k = len(subjects)
        self.k = k
        self.weight: dict[str, np.ndarray] = {}
        names, values = counts["term"].to_numpy(object), counts.iloc[:, 1 : 1 + k].to_numpy(float).reshape(-1, k)
        tongue, sums = np.array([x[:2] for x in names], object), np.array([len(x) == 3 for x in names], bool)
        for t in sorted(set(tongue.tolist())):  # within one language, so that a subject is never told by the language
            total = values[sums & (tongue == t)].sum(0)
            own = np.flatnonzero(~sums & (tongue == t))
            overall = values[own].sum(1)
            base = overall / max(1.0, total.sum())
            room = smooth * 30 + 0.02 * total.mean()
            rate = (values[own] + room * base[:, None]) / (total + room)
            weight = np.log(rate / np.maximum(base[:, None], 1e-12))
            spread = weight.max(1) - np.sort(weight, 1)[:, -2] if k > 1 else np.zeros(len(own))
            keep = (overall >= 1.5) & ((weight.max(1) > 0.7) | (spread > 0.5))
            self.weight |= dict(zip(names[own[keep]], np.clip(weight[keep], -2.0, 4.0).astype(np.float32)))

    @classmethod
    def of(cls, names: list[str], weights: list[np.ndarray], k: int) -> Terms:
        """A model of given weights: those of the terms that one chunk of documents has."""
        m = cls.__new__(cls)
        m.k, m.weight = k, dict(zip(names, weights))
        return m

    def posterior(self, ws: list[str]) -> tuple[np.ndarray, float]:
        """(share of each subject, evidence) of one sentence. Without a known term all shares are 0."""
        found = [v for t in terms(ws) if (v := self.weight.get(t)) is not None]
        if not found:
            return np.zeros(self.k), 0.0
        score = np.sum(found, 0)
        top = float(score.max())
        p = np.exp(score - top)
        p /= p.sum()
        return p, top


def profile(model: Terms, text: str, least: float = 2.0) -> np.ndarray:
    """Shares of the words per subject, then the share of words that speak for none."""
    out = np.zeros(model.k + 1)
    for ws in sentences(text):
        p, evidence = model.posterior(ws)
        if evidence >= least:
            out[: model.k] += len(ws) * p
        else:
            out[model.k] += len(ws)
    return out / max(1.0, out.sum())


def describe(model: Terms, text: str, source: str | None, kind: str | None) -> np.ndarray:
    """Features of one document."""
    share = profile(model, text)
    own = share[: model.k]
    told = own.sum()
    relative = own / told if told > 0 else own
    n = len(text)
    marks = [math.log1p(n) / 10, text.count("\n\n") / (1 + n / 500), len(re.findall(r"^\s*[-*•] ", text, re.M)) / (1 + n / 200), share[model.k], float(n < 150)]
    bins = np.zeros(SOURCE_BINS)
    for x in (source, kind):
        bins[zlib.crc32((x or "").encode()) % SOURCE_BINS] += 0.25
    return np.concatenate([own, relative, np.maximum(0, relative - 0.2) * 2, np.maximum(0, relative - 0.3) * 2, marks, bins])


def _fit(x: np.ndarray, y: np.ndarray, ridge: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps with a ridge per feature."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-5:
            break
    return w


class Chain:
    """A chain of calibrated logistic models, most frequent subject first."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.k = y.shape[1]
        self.order = list(np.argsort(-y.sum(0), kind="stable"))
        self.models = []
        for at, s in enumerate(self.order):
            f = self._features(x, y[:, self.order[:at]], s)
            ridge = np.full(f.shape[1], 2.0)
            ridge[:5] = 0.02  # what the subject's own share says
            ridge[5] = 1e-6
            self.models.append(_fit(f, y[:, s], ridge))

    def _features(self, x: np.ndarray, before: np.ndarray, s: int) -> np.ndarray:
        k = self.k
        own = np.stack([x[:, s], x[:, k + s], x[:, 2 * k + s], x[:, 3 * k + s], (x[:, k + s] > 0.05).astype(float)], 1)
        most = np.delete(x[:, k : 2 * k], s, 1).max(1, keepdims=True) if k > 1 else np.zeros((len(x), 1))
        return np.concatenate([own, np.ones((len(x), 1)), most, x[:, 4 * k :], before, before.sum(1, keepdims=True)], 1)

    def decode(self, x: np.ndarray, width: int = 8) -> list[tuple[tuple[int, ...], dict[int, float]]]:
        """For each row the likeliest label combination and the probability of each of its subjects on that path."""
        out = []
        for row in x:
            beam: list[tuple[float, list[int], list[float]]] = [(0.0, [], [])]
            for at, s in enumerate(self.order):
                before = np.array([b[1] for b in beam], float).reshape(len(beam), at)
                f = self._features(np.repeat(row[None], len(beam), 0), before, s)
                p = np.clip(1 / (1 + np.exp(-np.clip(f @ self.models[at], -30, 30))), 1e-9, 1 - 1e-9)
                grown = [(b[0] + math.log(q), [*b[1], 1], [*b[2], q]) for b, q in zip(beam, p)] + [(b[0] + math.log(1 - q), [*b[1], 0], [*b[2], q]) for b, q in zip(beam, p)]
                beam = sorted(grown, key=lambda b: -b[0])[:width]
            best = beam[0]
            chosen = {self.order[i]: best[2][i] for i, on in enumerate(best[1]) if on}
            out.append((tuple(sorted(chosen)), chosen))
        return out


def label_sets(labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(doc_id, ys): the known subjects of each labelled document, case and outer blanks ignored, repeats once."""
    s = F.lower(F.trim("subject"))
    return labels.select("doc_id", s.alias("s")).where(F.col("s").isin(subjects) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.array_sort(F.collect_set("s")).alias("ys"))  # at most all subjects


def term_sums(texts: Iterable[str], ys: Iterable, subjects: list[str], m: Terms | None) -> pd.DataFrame:
    """(term, v): the counts of `count_terms` over some texts, with the totals of each language."""
    at, k = {s: i for i, s in enumerate(subjects)}, len(subjects)
    sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(k))
    for text, y in zip(texts, ys):
        own = np.zeros(k)
        if y is not None and len(y):
            own[[at[x] for x in y]] = 1.0
        for ws in sentences(text):
            if m is None:
                p = own / own.sum() if own.any() else None
            else:
                p, evidence = m.posterior(ws)
                if evidence < 2.5:
                    continue
                if own.any():
                    p = p * own
                    if p.sum() < 0.2:
                        continue
                    p = p / p.sum()
                p = np.where(p > 0.05, p, 0.0)
            if p is not None:
                for t in terms(ws):
                    sums[t] += p
    totals: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(k))
    for t, v in sums.items():
        totals[t[:3]] += v
    return pd.DataFrame([(t, v.tolist()) for t, v in (sums | totals).items()], columns=["term", "v"])


def summed(parts: DataFrame, k: int) -> DataFrame:
    """term and its count per subject from partial ones (term, v). Terms found less than twice or spread over the subjects are left out; the totals of each language, under `xx|`, count them too."""
    c = [F.sum(F.col("v")[i]).alias(f"c{i}") for i in range(k)]
    total = sum((F.col(f"c{i}") for i in range(k)), F.lit(0.0))
    biggest = F.greatest(*[F.col(f"c{i}") for i in range(k)]) if k > 1 else F.col("c0")
    return parts.groupBy("term").agg(*c).where((F.length("term") == 3) | ((total >= 1.5) & (biggest >= 0.3 * total)))


def labelled_counts(docs: DataFrame, subjects: list[str]) -> DataFrame:
    """term and its count per subject over all of `docs` (text, ys), each document for its labels, combined in each batch before the shuffle."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield term_sums(pdf["text"], pdf["ys"], subjects, None)

    return summed(docs.mapInPandas(scan, "term string, v array<double>"), len(subjects))


def count_terms(docs: DataFrame, subjects: list[str], model: Terms | None) -> pd.DataFrame:
    """`labelled_counts` as columns on the driver, for few documents."""
    if model is not None:
        raise ValueError("with a model counts stay on the executors")
    return labelled_counts(docs, subjects).toPandas()


def term_weights(counts: DataFrame, subjects: list[str]) -> DataFrame:
    """(term, w) of `Terms`, made and kept on the executors; the driver sees the totals of each language only."""
    counts = cut(counts)
    totals = counts.where(F.length("term") == 3).toPandas()  # a row for each language
    k = len(subjects)

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            m = Terms(pd.concat([totals, pdf]), subjects)
            yield pd.DataFrame([(t, v.tolist()) for t, v in m.weight.items()], columns=["term", "w"])

    return cut(counts.where(F.length("term") > 3).select("term", *[f"c{i}" for i in range(k)]).mapInPandas(weigh, "term string, w array<float>"))


class Corpus:
    """Documents in chunks: what is known of the terms of a chunk is sent to its task, so neither the driver nor a task holds the whole vocabulary."""

    def __init__(self, documents: DataFrame, hints: DataFrame):
        spark = documents.sparkSession
        texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text", "source", "section_kind")
        size = texts.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
        self.chunks = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // CHUNK))
        chunk = F.pmod(F.xxhash64("doc_id"), F.lit(self.chunks)).cast("int").alias("c")
        self.texts = texts.select(chunk, "*", F.lit(None).cast("array<string>").alias("ys"))
        self.hints = hints.select(F.lit(0).alias("c"), F.lit(0).cast("bigint").alias("doc_id"), "text", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("section_kind"), "ys")

        def had(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                found = defaultdict(set)
                for c, text in zip(pdf["c"], pdf["text"]):
                    for ws in sentences(text):
                        found[c].update(terms(ws))
                yield pd.DataFrame([(c, t) for c, ts in found.items() for t in ts], columns=["c", "term"])

        self.terms = cut(self.texts.unionByName(self.hints).select("c", "text").repartition(self.chunks, "c").mapInPandas(had, "c int, term string").distinct())

    def scan(self, docs: DataFrame, weights: DataFrame, k: int, work, schema: str, labels: DataFrame | None = None) -> DataFrame:
        """`work(documents, model)` over each chunk of `docs` with the weights of its terms. `labels` (c, doc_id, ys) are set first."""
        told = self.terms.join(shuffled(weights), "term").select(F.col("c").alias("c_"), "term", "w", F.lit(None).cast("string").alias("d"), F.lit(None).cast("array<string>").alias("y"))
        if labels is not None:
            told = told.unionByName(labels.select(F.col("c").alias("c_"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("array<float>").alias("w"), F.col("doc_id").cast("string").alias("d"), F.col("ys").alias("y")))

        def run(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            known = known[known["term"].notna()], known[known["term"].isna()]
            ys = dict(zip(known[1]["d"], known[1]["y"]))
            pdf = pdf.assign(ys=[ys.get(str(d)) if y is None else y for d, y in zip(pdf["doc_id"], pdf["ys"])])
            return work(pdf, Terms.of(known[0]["term"].to_list(), known[0]["w"].to_list(), k))

        return docs.repartition(self.chunks, "c").groupBy("c").cogroup(told.repartition(self.chunks, "c_").groupBy("c_")).applyInPandas(run, schema)


def fit(documents: DataFrame, labels: DataFrame, areas: DataFrame, rounds: int = 2) -> tuple[list[str], Corpus | None, DataFrame | None, Chain | None]:
    """Subjects, documents in chunks, term weights and chain; the last three are None without subjects or labels. Only the features of the labelled documents come to the driver."""
    listed = areas.where("subject is not null").select("subject", "description").limit(MAX_SUBJECTS + 1).collect()
    if len(listed) > MAX_SUBJECTS:
        raise ValueError("more subject areas than MAX_SUBJECTS")
    described = sorted({(r[0].strip().lower(), r[1] or "") for r in listed})
    subjects = sorted({s for s, _ in described})
    if not subjects:
        return [], None, None, None
    k = len(subjects)
    hints = documents.sparkSession.createDataFrame([(f"{d} {s}", [s]) for s, d in described for _ in range(2)], "text string, ys array<string>")
    sets = label_sets(labels, subjects)
    if sets.isEmpty():
        return subjects, None, None, None
    corpus = Corpus(documents, hints)
    sample = cut(corpus.texts.drop("ys").join(sets, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED))
    if sample.isEmpty():
        return subjects, None, None, None
    weights = term_weights(labelled_counts(sample.select("text", "ys").unionAll(hints), subjects), subjects)
    everything = corpus.texts.unionByName(corpus.hints)
    count = lambda pdf, m: term_sums(pdf["text"], pdf["ys"], subjects, m)
    for _ in range(rounds):
        parts = corpus.scan(everything, weights, k, count, "term string, v array<double>", sample.select("c", "doc_id", "ys").dropDuplicates(["doc_id"]))
        weights = term_weights(summed(parts, k), subjects)

    def features(pdf: pd.DataFrame, m: Terms) -> pd.DataFrame:
        x = [describe(m, t, s, kind).tolist() for t, s, kind in zip(pdf["text"], pdf["source"], pdf["section_kind"])]
        y = [[float(s in ys) for s in subjects] for ys in pdf["ys"]]
        return pd.DataFrame(list(zip(pdf["doc_id"], x, y)), columns=["doc_id", "x", "y"])

    train = corpus.scan(sample, weights, k, features, "doc_id bigint, x array<double>, y array<double>").toPandas().sort_values("doc_id")  # at most MAX_LABELLED rows of numbers
    return subjects, corpus, weights, Chain(np.stack(train["x"].to_list()), np.stack(train["y"].to_list()))


def assign(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, subject, probability): one row for each subject of each document.

    `documents`: doc_id, text, source, section_kind; `labels`: doc_id, subject; `areas`: subject, description. Null and empty texts, and texts without a
    sentence that speaks for any subject, have no row; so has every document if there are no areas or no labels. Labels of unknown subjects are
    ignored. The labels serve to fit; every document, labelled or not, gets what the model says.
    """
    schema = "doc_id bigint, subject string, probability double"
    names, corpus, weights, chain = fit(documents, labels, areas)
    if chain is None:
        return documents.sparkSession.createDataFrame([], schema)

    def decide(pdf: pd.DataFrame, m: Terms) -> pd.DataFrame:
        out = []
        if len(pdf):
            x = np.stack([describe(m, t, s, kind) for t, s, kind in zip(pdf["text"], pdf["source"], pdf["section_kind"])])
            told = x[:, : len(names)].sum(1) > 0
            for doc, ok, (chosen, p) in zip(pdf["doc_id"], told, chain.decode(x)):
                if ok:
                    out += [(doc, names[s], float(p[s])) for s in chosen]
        return pd.DataFrame(out, columns=["doc_id", "subject", "probability"])

    return corpus.scan(corpus.texts.where("trim(text) <> ''"), weights, len(names), decide, schema)
