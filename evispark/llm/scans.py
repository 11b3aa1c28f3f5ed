"""Noise in text from scanned pages: label lines, take out headers and page numbers, mend words, rebuild paragraphs.

The lines of a block are a hidden Markov chain with the states body, header and break (a bare page number). Emissions are
tables over layout features, fitted by Viterbi training on a bounded sample and then used for every line. What remains is body:
words broken at line ends are joined, and words that the corpus hardly has are read as the frequent word that a known
confusion of characters makes of them. Word counts come from all texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.keys import norm_key
from evispark.session import cut, shuffled

STATES = ("body", "header", "break")
#: Blocks, of at most so many characters each, on which the line model is fitted; it is applied to all.
SAMPLE_BLOCKS, SAMPLE_CHARS = 4_000, 5_000
#: A word goes with numbers in running sentences if it stands beside one in at least three blocks and in this share of all its places.
BESIDE = 0.01
# What a character or pair of characters may have been, as printed -> meant.
CONFUSIONS = [("†", "t"), ("i)", "d"), ("0", "o"), ("!", "i"), ("!", "l"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("9", "g"), ("8", "b"), ("3", "e"), ("|", "l"), ("|", "i"), ("$", "s"), ("@", "a"), ("4", "a"), ("7", "t"), ("2", "z"), ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("ri", "n"), ("n", "ri"), ("li", "h"), ("h", "li"), ("vv", "w"), ("in", "m"), ("m", "in"), ("ni", "m"), ("m", "ni"), ("nn", "m"), ("c", "e"), ("e", "c"), ("k", "r"), ("h", "b"), ("b", "h"), ("f", "t"), ("t", "f"), ("l", "i"), ("i", "l"), ("rri", "m"), ("ij", "y"), ("ivi", "m"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")]
HYPHENS = "-­‐‑¬"
_TOKEN = r"(?:I\)(?=[a-z])|[^\W_]|†|[!|$@](?=[^\W_]|†))+"
_WORD = re.compile(rf"{_TOKEN}(?:-{_TOKEN})*")
_BREAK = re.compile(rf"((?:{_TOKEN}-)*{_TOKEN})\s*[{HYPHENS}][ \t]*(\n\s*|[ \t]+)({_TOKEN}(?:-{_TOKEN})*)")
_SPACED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][ \t]){3,}[^\W\d_](?![^\W\d_])")
_ROMAN = r"(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_PAGE = rf"(?:\d{{1,4}}|{_ROMAN})"
_ALONE = re.compile(rf"^\W*(?:(?:page|pg?|s|seite)\b\.?\s*)?({_PAGE})\W*$", re.I)
_LED = re.compile(rf"^\s*({_PAGE})[\s|/·–—-]+(\S.*)$")
_TRAILED = re.compile(rf"^(.*\S)(?:\s{{2,}}|\s*[|/·–—]\s*|\s+)({_PAGE})\s*$")
_SMALL = frozenset("of on in and for the et al vol no a to".split())


def page_in(number: str, first: int | None, last: int | None) -> bool:
    """Whether a printed page number can be the page of a block. Roman numbers can stand anywhere."""
    if not number.isdigit():
        return True
    return first is None or first - 1 <= int(number) <= (last if last is not None else first) + 1


def split_page(line: str, first: int | None, last: int | None) -> tuple[str, str | None]:
    """(line without page number, page number or None)."""
    for m, head, num in ((_LED.match(line), 2, 1), (_TRAILED.match(line), 1, 2)):
        if m and page_in(m[num], first, last) and not (num == 2 and not m[num].isdigit() and not re.search(rf"\s{{2,}}{m[num]}\s*$|[|/·–—]\s*{m[num]}\s*$", line)):
            return m[head].strip(" |/·"), m[num]
    return line.strip(), None


_NAME = r"[A-Z]\.\s?(?:[A-Z]\.\s?)*[^\W\da-z_][\w’'-]+"
_SMALLS = r"(?:(?:of|on|in|for|and|the|&)\s+)?"
#: Shapes of running headers inside a text whose line ends are lost.
_SPANS = re.compile(
    rf"[^\W\da-z_][\w’'-]+\s+(?:et al\b\.?|ET AL\b\.?)\s+/\s+[^()/]{{5,80}}?\(\d{{4}}\)|{_NAME}\s+(?:et al\b\.?|ET AL\b\.?)|{_NAME}\s+(?:and|AND)\s+{_NAME}(?!\s+and\s+others)"
    rf"|(?:[A-Z][a-z]+\.?\s+{_SMALLS}){{3,}}[A-Z][a-z]+\.?(?:\s+\d+\s+\(\d{{4}}\))?|(?:[^\W\da-z_]{{2,}}[:,?]?\s+){{2,}}[^\W\da-z_]{{2,}}[:,?.]?(?:\s+\d+\s+\(\d{{4}}\))?"
)
_MARKED = re.compile(r"(?<!see )(?:\b[Pp]age\s+(\d{1,4})\b|\bp\.\s+(\d{1,4})\b|(?<!\S)[-–—]\s(\d{1,4})\s[-–—](?!\S)|\[(\d{1,4})\])")
_BARE = re.compile(rf"(?<!\S)(\d{{1,4}})(?=\s)")


def unfold(text: str, first: int | None, last: int | None, running: set[tuple[str, str]]) -> str:
    """A text whose line ends are lost, with line ends again around what may be a running header or a page number of the block.

    `running`: (word before, word after) of the block's numbers that stand in running sentences. The line model decides on the lines.
    """
    if "\n" in text or first is None:
        return text
    cut_at: list[tuple[int, int]] = []
    lead, trail = re.compile(rf"(?:^|\s)({_PAGE})\s+$"), re.compile(rf"^(?:\s{{2,}}|\s)({_PAGE})(?=\s|$)")
    for m in _SPANS.finditer(text):
        a, b = m.span()
        if text[max(0, a - 3) : a] in ("As ", "as ") or text[max(0, a - 1) : a] == "(":
            continue
        if (n := trail.match(text[b:])) and (n[1].isdigit() and page_in(n[1], first, last) or not n[1].isdigit() and n[0][:2].isspace()):
            b += n.end()
        elif (n := lead.search(text[max(0, a - 12) : a])) and (n[1].isdigit() and page_in(n[1], first, last) or len(n[1]) > 1 and not n[1].isdigit()):
            a -= len(n[0].lstrip())
        cut_at.append((a, b))
    for m in _MARKED.finditer(text):
        if page_in(next(g for g in m.groups() if g), first, last):
            cut_at.append(m.span())
    for m in _BARE.finditer(text):
        if first <= int(m[1]) <= (last if last is not None else first):
            before, after = re.findall(r"[^\W\d_]+", text[max(0, m.start() - 20) : m.start()].lower())[-1:], re.findall(r"[^\W\d_]+", text[m.end() : m.end() + 20].lower())[:1]
            if before and after and (before[0], after[0]) not in running:
                cut_at.append(m.span())
    out, at = [], 0
    for a, b in sorted(cut_at, key=lambda x: (x[0], -x[1])):
        if a < at:
            continue
        out += [text[at:a].rstrip(), text[a:b].strip()]
        at = b
    out.append(text[at:].lstrip())
    return "\n".join(x for x in out if x)


def running_numbers(blocks: DataFrame) -> DataFrame:
    """(id, running): of each block without line ends the (before, after) words of its numbers that stand in running sentences.

    Counted over all blocks by aggregates: both words must go with numbers, in at least three blocks and BESIDE of all their places.
    """
    low = blocks.where("text is not null").select("id", F.lower("text").alias("t"))
    beside = F.arrays_zip(*[F.regexp_extract_all("t", F.lit(r"(\p{L}+)\P{L}{1,3}?\b\d{1,4}(?=\s+[^\p{L}\s]{0,3}(\p{L}+))"), F.lit(g)).alias(n) for g, n in ((1, "before"), (2, "after"))])
    numbers = cut(low.select("id", F.explode(F.array_distinct(beside)).alias("x")).select("id", "x.before", "x.after"))
    words = low.select(F.explode(F.split("t", r"\P{L}+")).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("all"))
    for side in ("before", "after"):
        near = numbers.groupBy(F.col(side).alias("w")).agg(F.countDistinct("id").alias("n")).where("n > 2")
        goes = near.join(shuffled(words), "w").where(F.col("n") >= BESIDE * F.col("all")).select(F.col("w").alias(side))
        numbers = numbers.join(shuffled(goes), side)
    bare = blocks.where("first is not null and text is not null and not contains(text, '\n')").select("id")
    return numbers.join(shuffled(bare), "id").groupBy("id").agg(F.collect_set(F.struct("before", "after")).alias("running"))  # of one block


def features(lines: list[str], repeated: set[str], first: int | None, last: int | None) -> list[tuple[int, ...]]:
    """Layout features of each line, each a small number."""
    longest = max(80, *(len(x) for x in lines))
    out = []
    for i, line in enumerate(lines):
        bare, page = split_page(line, first, last)
        alone = _ALONE.match(line)
        words = re.findall(r"[^\W\d_]+", bare)
        big = [w for w in words if w.lower() not in _SMALL]
        capital = sum(w[0].isupper() for w in big) / len(big) if big else 0.0
        before = lines[i - 1].rstrip() if i else "."
        after = lines[i + 1].lstrip() if i + 1 < len(lines) else ""
        key = " ".join(re.findall(r"[a-z]+", bare.lower()))
        out.append(
            (
                0 if len(line) < 0.5 * longest else 1 if len(line) < 0.85 * longest else 2,
                int(bool(alone) and page_in(alone[1], first, last) and (alone[1].isdigit() or len(alone[1]) < 6)) if alone else 0,
                int(page is not None) if words else 0,
                0 if not big else 1 if capital < 0.5 else 2 if capital < 0.99 else 3,
                int(bool(re.search(r"\bet al\.?(?:\s|$)", bare)) and len(words) < 12 and bare[:1].isupper()),
                int(bool(key) and key in repeated),
                0 if bare[:1].islower() else 1 if bare[:1].isupper() else 2,
                int(bool(re.search(r"[.!?:]\W?$", before))) if i else 2,
                (1 if after[:1].islower() else 0) if after else 2,
                int(bool(re.search(r"[.!?]\W?$", bare))),
                min(len(words), 9) // 3,
            )
        )
    return out


def seed(f: tuple[int, ...]) -> int:
    """First guess of the state from the features."""
    if f[1]:
        return 2
    if f[3] >= 2 and f[10] < 4 and (f[4] or f[5] or f[2]) and f[6] != 0 and f[0] < 2:
        return 1
    if f[3] == 3 and f[0] < 2 and f[7] != 1 and f[6] == 1 and f[10] >= 1 and not f[9]:
        return 1
    return 0


class LineModel:
    """Start, step and emission log-probabilities of the line states."""

    def __init__(self, sequences: list[list[tuple[int, ...]]], rounds: int = 3):
        labels = [[seed(f) for f in s] for s in sequences]
        for _ in range(rounds):
            self._fit(sequences, labels)
            labels = [self.decode(s) for s in sequences]
        self._fit(sequences, labels)

    def _fit(self, sequences: list, labels: list) -> None:
        n = len(STATES)
        start, step = [1.0] * n, [[0.5] * n for _ in range(n)]
        emit = [[{} for _ in range(11)] for _ in range(n)]
        size = [1.0] * n
        start[0] += 5
        guess = {0: (2, 0, 0, 1, 0, 0, 0, 0, 1, 0, 3), 1: (0, 0, 1, 3, 1, 1, 1, 0, 1, 0, 1), 2: (0, 1, 0, 0, 0, 0, 2, 0, 1, 0, 0)}
        for k, g in guess.items():  # one typical line each, so that no state is ever empty
            for j, v in enumerate(g):
                emit[k][j][v] = 1.0
        for s, ls in zip(sequences, labels):
            for i, (f, k) in enumerate(zip(s, ls)):
                size[k] += 1
                if i:
                    step[ls[i - 1]][k] += 1
                else:
                    start[k] += 1
                for j, v in enumerate(f):
                    emit[k][j][v] = emit[k][j].get(v, 0.0) + 1
        self.start = [math.log(x / sum(start)) for x in start]
        self.step = [[math.log(x / sum(r)) for x in r] for r in step]
        self.emit = [[{v: math.log((c + 0.1) / (size[k] + 0.4)) for v, c in emit[k][j].items()} for j in range(11)] for k in range(n)]
        self.none = [math.log(0.1 / (size[k] + 0.4)) for k in range(n)]

    def decode(self, s: list[tuple[int, ...]]) -> list[int]:
        """The likeliest states of the lines (Viterbi)."""
        if not s:
            return []
        n, back = len(STATES), []
        score = [self.start[k] + self._emit(k, s[0]) for k in range(n)]
        for f in s[1:]:
            best = [max(range(n), key=lambda a: score[a] + self.step[a][k]) for k in range(n)]
            score = [score[best[k]] + self.step[best[k]][k] + self._emit(k, f) for k in range(n)]
            back.append(best)
        k = max(range(n), key=lambda a: score[a])
        out = [k]
        for best in reversed(back):
            k = best[k]
            out.append(k)
        return out[::-1]

    def _emit(self, k: int, f: tuple[int, ...]) -> float:
        table = self.emit[k]
        return sum(table[j].get(v, self.none[k]) for j, v in enumerate(f))


def read_text(model: LineModel, text: str, repeated: set[str], first: int | None, last: int | None) -> tuple[str, list[str], list[str]]:
    """(body, headers, pages) of one text. The body keeps its line ends."""
    lines = text.split("\n")
    states = model.decode(features(lines, repeated, first, last))
    body, headers, pages = [], [], []
    for line, k in zip(lines, states):
        if not line.strip():
            body.append(line)
        elif k and (m := _ALONE.match(line)) and page_in(m[1], first, last):
            pages.append(m[1])
        elif k == 1:
            bare, page = split_page(line, first, last)
            headers.append(re.sub(r"\s+", " ", bare))
            if page:
                pages.append(page)
        else:
            body.append(line)
    return "\n".join(body), headers, pages


def read_title(model: LineModel, title: str, first: int | None, last: int | None) -> tuple[str, list[str]]:
    """(title, pages): a number parted from the title by leaders, a wide gap or a mark is put on a line of its own, and the line model decides if it is a page."""
    lines, at, pages = [title], 0, (first, last)
    if m := re.match(rf"^(.*?\S)(?:\s*\.{{3,}}\s*|\s{{2,}}|\s*[|·–—]\s*)({_PAGE})\s*$", title):
        lines, at, pages = [m[1], m[2]], 1, (None, None)  # a list of contents names pages of any place
    elif m := re.match(rf"^({_PAGE})(?:\s{{2,}}|\s*[|·–—]\s*)(\S.*)$", title):
        lines = [m[1], m[2]]
    if len(lines) == 1 or model.decode(features(lines, set(), *pages))[at] != STATES.index("break"):
        return title, []
    return lines[1 - at], [lines[at]]


def pieces(body: str) -> tuple[list[str], list[tuple[str, str, bool]], list[str]]:
    """(words, breaks, spaced) of a body text, lower case: plain words, (left, right, at a line end) of broken ones, and spaced-out words put together."""
    breaks, spaced = [], []

    def broken(m: re.Match) -> str:
        if m[3].lower() in ("and", "or", "to", "und", "oder", "y", "o"):
            return m[0]
        breaks.append((m[1].lower(), m[3].lower(), "\n" in m[2]))
        return " "

    def apart(m: re.Match) -> str:
        spaced.append(re.sub(r"\s", "", m[0]).lower())
        return " "

    rest = _SPACED.sub(apart, _BREAK.sub(broken, body)).replace("­", "")
    return [w.lower() for w in _WORD.findall(rest) if re.search(r"[^\W\d_]", w)], breaks, spaced


def readings(word: str) -> list[str]:
    """What a misread word may have been: one kind of confusion at one place or at all its places, and pairs of places for single marks."""
    out: set[str] = set()
    for a, b in CONFUSIONS:
        if a not in word:
            continue
        at = [m.start() for m in re.finditer(re.escape(a), word)]
        one = {word[:p] + b + word[p + len(a) :] for p in at}
        out |= one | ({word.replace(a, b)} if len(at) > 1 else set())
    marks = [v for v in out if re.search(r"[0-9!|$@†]", v)] if re.search(r"[0-9!|$@†]", word) else []
    for v in marks:  # a second mark in the same word
        for a, b in CONFUSIONS[:19]:
            if a in v:
                out.add(v.replace(a, b))
    return [v for v in out if re.fullmatch(r"[^\W\d_]+(?:-[^\W\d_]+)*", v)]


PARTS = "id string, field string, body string, headers array<string>, pages array<string>, words array<string>, breaks array<struct<l:string,r:string,nl:boolean>>, spaced array<string>"


def read_blocks(blocks: DataFrame) -> DataFrame:
    """PARTS of every block's text and title. `blocks`: id, paper, title, text, first, last; any may be null but the id.

    A line that stands in two or more blocks of its paper counts as repeated; counting is by aggregate, so a paper of any size is no single task.
    """
    blocks = cut(blocks)
    lines = blocks.where("text is not null").select("id", "paper", F.explode(F.split("text", "\n")).alias("line")).where("length(line) between 4 and 100")
    lines = lines.select("id", "paper", F.trim(F.regexp_replace(norm_key(F.col("line")), "[0-9]+| (?=[ivxlc]+$)[ivxlc]+$", " ")).alias("key")).select("id", "paper", F.regexp_replace("key", " +", " ").alias("key")).where("key <> ''").distinct()
    often = lines.groupBy("paper", "key").agg(F.count("*").alias("n")).where("n > 1")
    marked = lines.join(shuffled(often), ["paper", "key"]).groupBy("id").agg(F.collect_set("key").alias("repeated"))  # lines of one block
    rows = cut(blocks.join(shuffled(marked), "id", "left").join(shuffled(running_numbers(blocks)), "id", "left"))
    pairs = lambda r: {(x["before"], x["after"]) for x in r} if r is not None else set()
    take = rows.where(f"text <> '' and length(text) <= {SAMPLE_CHARS}").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_BLOCKS).select("text", "repeated", "first", "last", "running").collect()
    model = LineModel([features(unfold(r[0], r[2], r[3], pairs(r[4])).split("\n"), set(r[1] or ()), r[2], r[3]) for r in take])
    sent = blocks.sparkSession.sparkContext.broadcast(model)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        line_model = sent.value
        for pdf in frames:
            out = []
            for i, title, text, first, last, rep, near in zip(pdf["id"], pdf["title"], pdf["text"], pdf["first"], pdf["last"], pdf["repeated"], pdf["running"]):
                lo, hi = (None if x is None or x != x else int(x) for x in (first, last))
                if text:
                    body, headers, pages = read_text(line_model, unfold(text, lo, hi, pairs(near)), set(rep) if rep is not None else set(), lo, hi)
                    out.append((i, "text", body, headers, pages, *pieces(body)))
                if title:
                    body, pages = read_title(line_model, title, lo, hi)
                    out.append((i, "section_title", body, [], pages, *pieces(body)))
            yield pd.DataFrame(out, columns=["id", "field", "body", "headers", "pages", "words", "breaks", "spaced"])

    return rows.select("id", "title", "text", "first", "last", "repeated", "running").mapInPandas(read, PARTS)


def word_readings(counts: DataFrame, ratio: int = 12, least: int = 8) -> DataFrame:
    """(w, to): words that the corpus has at least `ratio` times less often than a word they may be a misreading of."""

    @F.pandas_udf("array<string>")
    def options(s: pd.Series) -> pd.Series:
        return s.map(readings)

    may = counts.where("length(w) > 1").select("w", "n", F.explode(options("w")).alias("to"))
    known = counts.select(F.col("w").alias("to"), F.col("n").alias("m"))
    enough = (F.col("m") >= F.col("n") * ratio) & (F.col("m") >= least)
    marked = F.col("w").rlike("[a-z][0-9!|$@†]|[0-9!|$@†][a-z]") & (F.col("m") > F.col("n"))
    near = may.join(shuffled(known), "to").where(enough & (F.length("w") > 3) | marked & (F.length("w") > 2) | marked & enough)
    return near.groupBy("w").agg(F.max_by("to", F.struct("m", "to")).alias("to"))


def repairs(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parts, items) of the blocks.

    items: id, field, kind (hyphen, misread, header, page), item, printed - distinct. Blocks without text or title, blank texts and clean texts have none;
    a word with no reading that the corpus knows stays as printed.
    """
    parts = cut(read_blocks(blocks))
    words = parts.select("id", "field", F.explode("words").alias("w"))
    counts = cut(words.groupBy("w").agg(F.count("*").alias("n")))
    better = cut(word_readings(counts))
    known = counts.join(shuffled(better), "w", "left_anti").where("n > 1 or w not rlike '[0-9]'")
    misread = words.distinct().join(shuffled(better), "w").select("id", "field", F.lit("misread").alias("kind"), F.col("to").alias("item"), F.col("w").alias("printed"))
    # spaced-out words: the letters together, or without a first or last one that is a word of its own
    sp = parts.select("id", "field", F.explode("spaced").alias("s")).distinct()
    cuts3 = F.array(F.struct(F.lit(0).alias("k"), F.col("s").alias("w")), F.struct(F.lit(1).alias("k"), F.expr("substring(s, 2)").alias("w")), F.struct(F.lit(1).alias("k"), F.expr("left(s, length(s) - 1)").alias("w")))
    sp = sp.select("id", "field", "s", F.explode(cuts3).alias("x")).select("id", "field", "s", "x.k", "x.w")
    sp = sp.join(shuffled(better), "w", "left").withColumn("w", F.coalesce("to", "w")).drop("to").join(shuffled(known.where("n > 1")), "w")
    sp = sp.groupBy("id", "field", "s").agg(F.min_by("w", F.struct("k", (-F.col("n")).alias("n"))).alias("item"))
    spaced = sp.select("id", "field", F.lit("misread").alias("kind"), "item", F.col("s").alias("printed"))
    # broken words: one word, or one with a hyphen of its own, whichever the corpus has more of
    br = parts.select("id", "field", F.explode("breaks").alias("b")).select("id", "field", "b.l", "b.r", "b.nl").distinct()
    tail = F.regexp_extract("l", "([^-]*)$", 1)
    forms = F.array(F.struct(F.lit(1).alias("k"), F.concat("l", "r").alias("w")), F.struct(F.lit(2).alias("k"), F.concat("l", F.lit("-"), "r").alias("w")), F.struct(F.lit(3).alias("k"), F.concat(tail, F.col("r")).alias("w")))
    br = br.select("*", F.explode(forms).alias("f")).select("id", "field", "l", "r", "nl", "f.k", "f.w").distinct()
    br = br.join(shuffled(better), "w", "left").withColumn("w", F.coalesce("to", "w")).drop("to").join(shuffled(known), "w", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = br.groupBy("id", "field", "l", "r", "nl").agg(F.max_by(F.struct("k", "w", "n"), F.struct("n", (-F.col("k")).alias("k"))).alias("m"))
    whole = F.when(F.col("m.k") == 3, F.concat(F.regexp_extract("l", "^(.*-)[^-]*$", 1), F.col("m.w"))).otherwise(F.col("m.w"))
    hyphen = best.where("nl or m.n > 0").select("id", "field", F.lit("hyphen").alias("kind"), whole.alias("item"), F.concat("l", F.lit(" "), "r").alias("printed"))
    plain = lambda c, k: parts.select("id", "field", F.explode(c).alias("item")).select("id", "field", F.lit(k).alias("kind"), "item", F.col("item").alias("printed"))
    items = misread.unionAll(spaced).unionAll(hyphen).unionAll(plain("headers", "header")).unionAll(plain("pages", "page")).distinct()
    return parts, items


def repaired(parts: DataFrame, items: DataFrame) -> DataFrame:
    """(id, title, text): continuous paragraphs without headers and page numbers, broken and misread words mended. Null where there was no text."""
    fixes = items.where("kind in ('hyphen', 'misread')").groupBy("id", "field").agg(F.collect_set(F.struct("printed", "item")).alias("fixes"))  # of one block

    @F.pandas_udf("string")
    def mend(body: pd.Series, fixes: pd.Series) -> pd.Series:
        return pd.Series([rebuild(b, {x["printed"]: x["item"] for x in f} if f is not None else {}) for b, f in zip(body, fixes)])

    done = parts.join(shuffled(fixes), ["id", "field"], "left").select("id", "field", mend("body", "fixes").alias("t"))
    return done.groupBy("id").agg(F.max(F.when(F.col("field") == "section_title", F.col("t"))).alias("section_title"), F.max(F.when(F.col("field") == "text", F.col("t"))).alias("text"))


def _cased(like: str, word: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word[:1].upper() + word[1:] if like[:1].isupper() else word


def rebuild(body: str, fixes: dict[str, str]) -> str:
    """One body text with `fixes` (printed -> meant) applied and its lines run together; blank lines part paragraphs."""
    if not body:
        return body

    def broken(m: re.Match) -> str:
        to = fixes.get(f"{m[1].lower()} {m[3].lower()}")
        return _cased(m[1], to) if to else m[0]

    def apart(m: re.Match) -> str:
        s = re.sub(r"\s", "", m[0])
        to = fixes.get(s.lower())
        if not to:
            return m[0]
        at = s.lower().find(to)
        return (s[:at] + " " if at > 0 else "") + _cased(s[max(0, at)], to) + (" " + s[at + len(to) :] if at >= 0 and at + len(to) < len(s) else "")

    t = _SPACED.sub(apart, _BREAK.sub(broken, body)).replace("­", "")
    t = _WORD.sub(lambda m: _cased(m[0], fixes[m[0].lower()]) if m[0].lower() in fixes else m[0], t)
    return "\n\n".join(re.sub(r"\s+", " ", p).strip() for p in re.split(r"\n\s*\n", t) if p.strip())
