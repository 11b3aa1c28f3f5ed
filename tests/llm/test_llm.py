import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evispark.llm import canonical, cooccurrence, leakage, matching, names, packing, scans, setjoin, subjects
from evispark.llm.distance import osa


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# 6 co-occurrence -------------------------------------------------------------------------------------------------


def brute_pairs(data, items, least, lift):
    sets = defaultdict(set)
    for b, i in data:
        if b is not None and i in items:
            sets[b].add(i)
    n, one, two = len(sets), Counter(), Counter()
    for s in sets.values():
        one.update(s)
        two.update(combinations(sorted(s), 2))
    return sorted((a, b, n, one[a], one[b], c) for (a, b), c in two.items() if c >= least and c * n >= lift * one[a] * one[b])


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_match_brute_force(spark, seed):
    rng = random.Random(seed)
    data = [(rng.choice([None, *map(str, range(60))]), rng.choice(["hot"] * 5 + [None, "zz"] + [f"i{k}" for k in range(12)])) for _ in range(600)]
    items = ["hot", "unused", *[f"i{k}" for k in range(12)]]
    df = spark.createDataFrame([(b, i, "x") for b, i in data], "basket string, item string, items string")
    got = cooccurrence.cooccurring_pairs(df, spark.createDataFrame([(i,) for i in items] * 2, "item string"), min_pairs=3, min_lift=1.2)
    assert rows(got.select("item_a", "item_b", "n", "n_a", "n_b", "n_ab")) == brute_pairs(data, set(items), 3, 1.2)


def test_pairs_of_empty_tables(spark):
    df, items = spark.createDataFrame([], "basket string, item string"), spark.createDataFrame([("a",)], "item string")
    assert cooccurrence.cooccurring_pairs(df, items).count() == 0
    assert cooccurrence.cooccurring_pairs(spark.createDataFrame([("b", "a")], "basket string, item string"), items.limit(0)).count() == 0


# 7 set join ------------------------------------------------------------------------------------------------------


def _sets(spark, data):
    df = spark.createDataFrame(data, "id string, a array<string>, b array<string>, cls string")
    return setjoin.tag_sets(df, "id", ["a", "b"])


@pytest.mark.parametrize("crowd", [64, 2])
def test_set_join_matches_brute_force(spark, crowd):
    rng = random.Random(5)
    pool = [f"Tag {k}" for k in range(40)]
    base = [rng.sample(pool, 8) for _ in range(25)]
    data = []
    for k in range(120):
        s = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            s[rng.randrange(len(s))] = rng.choice(pool)
        data.append((f"p{k}", s[:4], [*s[4:], None, " ", s[0].upper()], "c"))
    data += [(f"e{k}", None, [], "c") for k in range(3)] + [(f"same{k}", ["x y", "y"], ["z"], "c") for k in range(4)]
    sets = _sets(spark, data)
    tags = {r["id"]: set(r["tags"]) for r in sets.collect()}
    want = sorted(p for p in combinations(sorted(tags), 2) if tags[p[0]] and tags[p[1]] and len(tags[p[0]] & tags[p[1]]) >= 0.6 * len(tags[p[0]] | tags[p[1]]))
    got = rows(setjoin.expand(*setjoin.similar_classes(sets, "id", crowd=crowd), "id"))
    assert set(got) <= set(want)
    assert len(got) >= 0.99 * len(want)
    if crowd == 2:
        assert got == want  # crowded prefixes go the exact way


def test_set_join_empty(spark):
    assert setjoin.expand(*setjoin.similar_classes(_sets(spark, []), "id"), "id").count() == 0


# 3 canonical values ----------------------------------------------------------------------------------------------

ELEMENTS = [
    ("e/1", "m", "acid-treated carbonate membrane", '["ACM", ""]'), ("e/2", "m", "acid-treated carbon membrane", None), ("e/3", "m", "sodium silica powder", "[broken"),
    ("e/4", "n", "reference vessel hold time", '["RVHT"]'), (None, "n", "no id", None), ("e/5", "n", None, None),
]


@pytest.mark.parametrize(
    "facet, surface, found",
    [
        ("m", "Acid-Treated  CARBONATE membrane", "e/1"), ("m", "acm", "e/1"), ("m", "sodium silca powder (this work)", "e/3"), ("m", "powder of sodium silica", "e/3"),
        ("m", "sodiumsilicapowder", "e/3"), ("m", "sodium clay powder", "unmatched"), ("n", "sodium silica powder", "unmatched"), ("n", "RVHT hold time", "e/4"),
        ("n", "refernce vesel hold time method", "e/4"), ("n", "not reported", "unmatched"), ("m", "", "unmatched"), ("m", None, "unmatched"), (None, "ACM", "unmatched"), ("m", "acid-treated carb. membrane", "unmatched"),
    ],
)
def test_mapping(spark, facet, surface, found):
    values = spark.createDataFrame([(facet, surface, 1)] * 2, "facet string, surface string, element_id int")
    got = canonical.map_values(values, spark.createDataFrame(ELEMENTS, "element_id string, facet string, display_name string, aliases_json string")).collect()
    assert [r["element_id"] for r in got] == [found]


def test_mapping_in_parts_and_empty(spark, monkeypatch):
    ref = spark.createDataFrame(ELEMENTS, "element_id string, facet string, display_name string, aliases_json string")
    values = spark.createDataFrame([("m", "sodium silica powdr"), ("n", "RVHT"), ("m", "x" * 5000)], "facet string, surface string")
    whole = rows(canonical.map_values(values, ref).select("facet", "surface", "element_id"))
    more = spark.createDataFrame([(f"x/{i}", "m", f"{a} {b} {c}", None) for i, (a, b, c) in enumerate((a, b, c) for a in ("sodium", "acid", "silver") for b in ("silica", "carbon") for c in ("powder", "membrane", "glass"))], ref.schema)
    typed = values.unionAll(spark.createDataFrame([("m", x) for x in ("sodium silica powder", "silver carbn glass", "acid membrane", "carbon powdr", "sodium silica", "ACM", "acid-treated carb. membrane", "silver carbon glas method")], "facet string, surface string"))
    wide = rows(canonical.map_values(typed, ref.unionAll(more)))
    monkeypatch.setattr(canonical, "PART", 2)
    assert rows(canonical.map_values(values, ref).select("facet", "surface", "element_id")) == whole
    monkeypatch.setattr(canonical, "PART", 5)
    assert rows(canonical.map_values(typed, ref.unionAll(more))) == wide and len({r[2] for r in wide}) > 3
    assert {r["element_id"] for r in canonical.map_values(values, ref.limit(0)).collect()} == {"unmatched"}
    assert canonical.map_values(values.limit(0), ref).count() == 0


# 1 matching ------------------------------------------------------------------------------------------------------

WORKS = "id bigint, title string, doi string, year string, journal string, authors array<string>, score string"


def test_matching_cases(spark):
    left = [
        (1, "Effect of moisture on swelling strain in Jomburlel aerogel", None, "1999", "Arch. Reg. Chem.", ["Lee, M."], "x"),
        (2, "Erratum to: Effect of moisture on swelling strain in Jomburlel aerogel", None, "1999", "Arch. Reg. Chem.", ["Lee, M."], "x"),
        (3, "On the creep behaviour of Kraved tuff. Part II", "10.1000/abc.1", None, None, None, None), (4, None, None, None, None, None, None), (5, "", "", "", "", [], ""), (None, "t", None, None, None, None, None),
        (6, "Survey of Dridved carbon cores, 2008", None, "2008", None, [None, ""], None),
    ]
    right = [
        (1, "EFFECT  OF MOISTURE ON SWELING STRAIN IN JOMBURLEL AEROGEL", None, "1999-08", "Archive for Regional Chemistry", ["Min Lee"], "x"),
        (2, "On the creep behavior of Kraved tuff. Part I", None, None, None, None, None), (3, "On the creep behavior of Kraved tuff. Part II", None, None, None, None, None),
        (4, "Survey of Dridved carbon cores, 2009", None, "2009", None, None, None), (5, None, None, None, None, None, None),
    ]
    a = spark.createDataFrame(left * 2, WORKS).withColumnRenamed("id", "a_id")
    b = spark.createDataFrame(right, WORKS).withColumnRenamed("id", "b_id")
    got = matching.match_works(a, b, "a_id", "b_id")
    assert [r[:2] for r in rows(got)] == [(1, 1), (3, 3)]
    assert all(0 <= r["confidence"] <= 1 for r in got.collect())
    assert matching.match_works(a.limit(0), b, "a_id", "b_id").count() == 0


def test_windows_find_what_all_pairs_find(spark, sf):
    from evispark.tables import table

    fields = ["title", "doi", "year", "journal", "authors"]
    recs = matching.read_records(table(spark, sf, "citations").select("citation_id", *fields), 0, "citation_id").unionAll(matching.read_records(table(spark, sf, "articles").select("article_id", *fields), 1, "article_id")).dropDuplicates(["src", "id"]).cache()
    data = sorted(recs.collect(), key=lambda r: (r["src"], r["id"]))
    cnt = Counter(w for r in data for w in r["names"])
    common = frozenset(w for w, c in cnt.items() if c >= max(4, 0.004 * len(data)))
    cols = [c.split()[0] for c in matching.SCHEMA.split(", ")][2:]
    feats = [tuple(r[c] for c in cols) for r in data]
    brute = {(data[i]["src"], data[i]["id"], data[j]["src"], data[j]["id"]) for i, j in combinations(range(len(data)), 2) if matching.pair_score(feats[i], feats[j], common) >= 4}
    got = {tuple(r)[:4] for r in matching.compare(recs).where("score >= 4").collect()}
    assert got <= brute and len(got) >= 0.97 * len(brute)


def test_hot_work_keeps_every_pair(spark):
    title = "Effect of moisture on swelling strain in Jomburlel aerogel"
    work = (title, "10.1000/abc.1", "1999", "Arch. Reg. Chem.", ["Lee, M."], "x")
    other = ("Survey of Dridved carbon cores", "10.1000/abc.2", "2008", None, ["Brown, B."], "x")
    a = spark.createDataFrame([(i, *work) for i in range(420)] + [(900, *other)], WORKS).withColumnRenamed("id", "a_id")
    b = spark.createDataFrame([(i, *work) for i in range(3)] + [(7, *other)], WORKS).withColumnRenamed("id", "b_id")
    assert {tuple(r)[:2] for r in matching.match_works(a, b, "a_id", "b_id").collect()} == {(i, j) for i in range(420) for j in range(3)} | {(900, 7)}


def test_placeholder_dois_are_told_by_titles(spark):
    words = ["moisture", "strain", "core", "glass", "basin", "tuff", "creep", "pore", "salt", "ice"]
    a = [(i, "Swelling strain of Jomburlel aerogel" + (" in air" if i % 3 else ""), "10.1000/work", None, None, None, None) for i in range(20)]
    a += [(100 + i, f"{words[i]} {words[(i * 3 + 1) % 10]} {words[(i * 7 + 5) % 10]}", "10.0000/none", None, None, None, None) for i in range(10)]
    got = matching.without_placeholders(matching.read_records(spark.createDataFrame(a, WORKS), 0, "id"))
    assert {(r["id"] < 100, r["doi"]) for r in got.collect()} == {(True, "10.1000/work"), (False, "")}


@pytest.mark.parametrize("seed", range(5))
def test_assignment_is_optimal_and_large_ones_are_full(spark, seed):
    rng = random.Random(seed)
    scores = {(x, y): rng.uniform(4, 12) for x in range(6) for y in range(7) if rng.random() < 0.5}
    cost = np.zeros((6, 13))
    for (x, y), s in scores.items():
        cost[x, y] = -matching.confidence(s) - 1e-4 * s
    total = lambda found: sum(cost[p] for p in found)
    best = sum(cost[i, j] for i, j in enumerate(matching.hungarian(cost)))
    assert abs(total(matching.assign(scores)) - best) < 1e-9
    if seed == 0:
        taken = {(r["l"], r["r"]) for r in matching.dominant(spark.createDataFrame([(x, y, s) for (x, y), s in scores.items()], "l bigint, r bigint, score double")).collect()}
        left, right = {x for x, _ in taken}, {y for _, y in taken}
        assert len(left) == len(right) == len(taken) and all(x in left or y in right for x, y in scores) and total(taken) <= best / 2


def test_hungarian_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(2)
    for _ in range(20):
        c = rng.random((4, 5))
        best = min(sum(c[i, p[i]] for i in range(4)) for p in permutations(range(5), 4))
        assert abs(sum(c[i, j] for i, j in enumerate(matching.hungarian(c))) - best) < 1e-9


# 2 names ---------------------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=7), st.lists(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=12, unique=True))
def test_automaton_finds_all_neighbours(word, pool):
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, d = [i, *[0] * len(b)], row
            for j, y in enumerate(b, 1):
                row[j] = min(d[j] + 1, row[j - 1] + 1, d[j - 1] + (x != y))
        return row[-1]

    assert sorted(names.neighbours(names.trie(pool), word, 2)) == sorted(w for w in pool if w != word and lev(word, w) <= 2)


def test_trie_join_matches_brute_force(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abdelmnorsuvz") for _ in range(rng.randrange(4, 9))) for _ in range(60)}
    for w in list(words):
        k = rng.randrange(len(w))
        words.add(w[:k] + rng.choice("xyz") + w[k + 1 :])
        words.add("q" + w[1:-1] + "q")
    got = {(r["a"], r["b"]) for r in names.trie_join(spark.createDataFrame([(w,) for w in words], "w string"), part=25).collect()}
    want = {(a, b) for a in words for b in words if a != b and min(len(a), len(b)) >= 4 and osa(a, b, 2) <= (1 if min(len(a), len(b)) < 6 else 2)}
    assert got == want


def test_works_are_assigned_exactly_at_any_size(spark):
    import inspect

    assert inspect.signature(matching.match_works).parameters["largest"].default is None
    pairs = [(2 * (3 * c + i), 2 * (3 * c + j) + 1, s) for c in range(40) for i, j, s in ((0, 0, 4.2), (0, 1, 4.4), (1, 1, 4.3))]  # the best pair alone leaves two works out
    got = {(r["l"], r["r"]) for r in matching.assign_works(spark.createDataFrame(pairs, "l bigint, r bigint, score double")).collect()}
    assert got == {(a, b) for a, b, s in pairs if s != 4.4}


def test_near_words_of_all_lengths_meet(spark):
    rng = random.Random(5)
    words = {"john", "jhon", "jonh", "lima", "milan", "aaaa"}
    for n in (4, 5, 6, 18, 19, 20, 21, 22, 23):
        for _ in range(4):
            w = "".join(rng.choice("abdelmnorsuvz") for _ in range(n))
            words |= {w, w[1:], w[:2] + "x" + w[2:], w[:-2] + w[-1] + w[-2], w[1] + w[0] + w[2:], w[:3] + "yy" + w[3:]}
    got = {(r["a"], r["b"]): r["d"] for r in names.trie_join(spark.createDataFrame([(w,) for w in words], "w string")).collect()}
    want = {(a, b): osa(a, b, 2) for a in words for b in words if a != b and min(len(a), len(b)) >= 4 and osa(a, b, 2) <= (1 if min(len(a), len(b)) < 6 else 2)}
    assert got.items() <= want.items() and got["john", "jhon"] == 1
    assert not [(a, b) for a, b in want.keys() - got.keys() if b in names.neighbours(names.trie([b]), a, 2)]  # a swap counts as two edits


def test_names_cases(spark):
    data = ["Lee-Brown, Robert", "Bob Lee-Brown, PhD", "LEE-BROWN, Robert", "R. Lee-Brown†", "Lee Brown R", "Robert Lee-Browm", "Anonymous", "", None, " ", "et al.", "The Basin Data Working Group", "Working Group of Basin Data", "Smith, Anna", "Smith, Alan", "A. Smith"]
    got = {frozenset(r) for r in names.variant_pairs(names.entities(spark.createDataFrame([(x,) for x in data + data], "name string"))).collect()}
    people = [x for x in data[:5]]
    assert {frozenset(p) for p in combinations(people, 2)} <= got
    assert frozenset(["The Basin Data Working Group", "Working Group of Basin Data"]) in got
    assert not any(x in p for p in got for x in ("Anonymous", "", "et al.", "A. Smith")) and frozenset(["Smith, Anna", "Smith, Alan"]) not in got
    assert names.entities(spark.createDataFrame([], "name string")).count() == 0


@pytest.mark.parametrize("times", [1, 10])
def test_misspellings_stay_linked_as_names_multiply(spark, times):
    rng = random.Random(9)
    made = ["".join(rng.choice(x) for x in ("bdgklm", "aeiou", "prstvz", "aeiou", "bdgklm", "aeiou", "nrstx")) for _ in range(24 * times)]
    families = sorted({w + x for w, x in zip(made, "qwxyzjkh" * 30)})
    right, wrong, other = families[0::2], families[0 : 4 * times : 2], families[1 : 12 * times : 4]
    data = [f"{f.title()}, Wanda" for f in right] + [f"{f.title()}, Wnada" for f in wrong] + [f"{f.title()}, Wenda" for f in other]
    given = ["Amara", "Bruno", "Clara", "Dmitri", "Emre", "Felix", "Haruto", "Igor", "Jakub", "Kwame", "Lena", "Marta", "Nils", "Olga", "Petra", "Quentin", "Rashid", "Svetlana", "Tariq", "Ulrich"]
    data += [f"Skorzewel, {x}" for x in given] + [f"Skorzwel, {x}" for x in given[: 5 if times > 1 else 2]]
    got = {frozenset(r) for r in names.variant_pairs(names.entities(spark.createDataFrame([(x,) for x in data], "name string"))).collect()}
    assert {frozenset([f"{f.title()}, Wanda", f"{f.title()}, Wnada"]) for f in wrong} <= got
    assert {frozenset([f"Skorzewel, {x}", f"Skorzwel, {x}"]) for x in given[: 5 if times > 1 else 2]} <= got
    assert not any("Wenda" in x for p in got for x in p)


# 9 leakage -------------------------------------------------------------------------------------------------------

ITEM = "The tailor swore that no lighthouse could be rebuilt there in year 68, so that the silent aqueduct of Traayne was carelessly praised near Sadoth"


@pytest.mark.parametrize(
    "text, hit",
    [
        (f"Before. {ITEM}. After", True), (ITEM.upper().replace(" ", "\n"), True), (ITEM.replace("carelessly", "care-\nlessly").replace("silent", "silnt").replace("aqueduct", "aqueducts"), True),
        (" ".join(ITEM.split()[:16]) + " and nothing more of it", True), ("One phrase reads no lighthouse could be rebuilt. The rest is new.", False), ("", False), (None, False), ("word " * 30000, False), ("word " * 30000 + ITEM, True),
        (" ".join(ITEM.split()[:13]) + " (...) [see also the note above] " + " ".join(ITEM.split()[13:]), True),
    ],
)
def test_leaks(spark, text, hit):
    items = [(1, ITEM, "yes"), (1, ITEM, "yes"), (2, "Every lantern except the tenth had been weighed without telling three masons near Hareusk", None), (3, None, None), (4, " ", "x")]
    docs = spark.createDataFrame([(7, text, "x"), (None, ITEM, "x")], "doc_id bigint, text string, item_id string")
    got = [r[:2] for r in rows(leakage.leaks(docs, spark.createDataFrame(items, "item_id bigint, text string, answer string")))]
    assert got == ([(7, 1)] if hit else [])


def test_leaks_dont_depend_on_parts(spark, monkeypatch):
    rng = random.Random(12)
    pool = [f"word{chr(97 + k % 26)}{k}" for k in range(150)]
    items = [(i, " ".join(rng.choices(pool, k=24)), "x") for i in range(20)]
    docs = [(d, " ".join(rng.choices(pool, k=120) + items[d % 20][1].split()[: 8 + d % 16] + rng.choices(pool, k=60))) for d in range(60)]
    run = lambda: rows(leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string, answer string")))
    one = run()
    monkeypatch.setattr(leakage, "PART", 6)
    assert run() == one and 10 < len(one) < 100


def test_search_misses_nothing():
    rng = random.Random(1)
    words = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(rng.choices(words, k=20)), "") for i in range(200)]
    index = leakage.Index(items)
    for _ in range(50):
        q = set(rng.sample(words, 15))
        full = {}
        for t in q:
            for i, w in zip(*index.postings[t][:2]):
                full[int(i)] = full.get(int(i), 0) + w
        assert {i for i, _ in index.search(q, 0.3)} == {i for i, s in full.items() if s >= 0.3 - 1e-12 and s >= 0.3}


# 5 scans ---------------------------------------------------------------------------------------------------------


def test_scans(spark, sf):
    words = "the recharge rate of the river gauge was halved once the sediment plume is disturbed and common discharge".split()
    clean = [(f"c{k}", f"q{k}", "Results", " ".join(words) + ".", 1, 1) for k in range(40)]
    dirty = [
        ("d1", "p", "Resu1ts ..... 12", "The rech-\narge rate of the r i v e r gauge was\n12 A. Basuved et al.\nhalved once the secliment plume is dis-\nturbed and cornmon.", 12, 12),
        ("d2", "p", None, None, None, None), ("d3", "p", "", "", 3, 3), ("d4", "p", "4.1 Results", "13", 13, 13), ("d5", None, "Results", "pre- and post-test values\nagree in 2004.", 5, 5),
    ]
    df = spark.createDataFrame(clean + dirty, "id string, paper string, title string, text string, first int, last int")
    parts, items = scans.repairs(df)
    got = {(r["id"], r["field"], r["kind"], r["item"]) for r in items.collect()}
    assert {("d1", "text", "hyphen", "recharge"), ("d1", "text", "hyphen", "disturbed"), ("d1", "text", "misread", "river"), ("d1", "text", "misread", "sediment"), ("d1", "text", "misread", "common"), ("d1", "section_title", "page", "12"), ("d1", "section_title", "misread", "results")} <= got
    assert ("d1", "text", "header", "A. Basuved et al.") in got and ("d1", "text", "page", "12") in got and ("d4", "text", "page", "13") in got
    assert not any(g[0] in ("d2", "d3", "d5") or g[0].startswith("c") for g in got)
    text = {r["id"]: r["text"] for r in scans.repaired(parts, items).collect()}
    assert text["d1"] == "The recharge rate of the river gauge was halved once the sediment plume is disturbed and common."
    assert scans.repairs(df.limit(0))[1].count() == 0


# 8 packing -------------------------------------------------------------------------------------------------------


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=9, max_size=9))
def test_plan_uses_the_histogram_up(counts):
    h = np.array([0, *counts], np.int64)
    used = np.zeros_like(h)
    for p, n in packing.plan(h)[0]:
        assert n > 0 and sum(p) <= len(h) - 1
        for s in p:
            used[s] += n
    assert (used == h).all()


def test_pack(spark):
    rng = random.Random(3)
    sizes = [(k, rng.choice([0, 1, 7, 50, 50, 50, 50, 99, 100, 101, 250, rng.randrange(1, 400)])) for k in range(700)]
    got = packing.pack(spark.createDataFrame(sizes, "key bigint, tokens int"), 100).collect()
    per, per_key = Counter(), defaultdict(list)
    for r in got:
        per[r["container"]] += r["size"]
        per_key[r["key"]].append((r["piece"], r["start"], r["size"]))
    assert max(per.values()) <= 100 and sum(per.values()) == sum(t for _, t in sizes)
    for k, t in sizes:
        assert len(per_key[k]) == -(-t // 100) and sum(x[2] for x in per_key[k]) == t
    assert len(per) <= 1.06 * sum(t for _, t in sizes) / 100 + 2
    assert packing.pack(spark.createDataFrame([], "key bigint, tokens int"), 100).count() == 0


def test_knapsack_is_best():
    rng, bins = random.Random(8), 9
    for _ in range(40):
        value, most = np.array([0.0] + [rng.random() for _ in range(bins)]), np.array([0] + [rng.randrange(3) for _ in range(bins)])
        best = {0: 0.0}
        for s in range(1, bins + 1):
            for _ in range(int(most[s])):
                best |= {w + s: max(v + value[s], best.get(w + s, -1.0)) for w, v in sorted(best.items(), reverse=True) if w + s <= bins}
        uses = packing.knapsack(value, most, bins)
        if max(best) == 0:
            assert uses is None
        else:
            assert (uses <= most).all() and (uses * np.arange(bins + 1)).sum() == max(best) and abs((uses * value).sum() - best[max(best)]) < 1e-9


def test_most_pieces_stand_in_fitted_patterns():
    rng = random.Random(5)
    for n in (10_000, 30_000):
        h = np.zeros(513, np.int64)
        for _ in range(n):
            h[min(512, max(1, int(rng.lognormvariate(3.3, 0.9))))] += 1
        found, split = packing.plan(h)
        pieces = lambda part: sum(len(p) * k for p, k in part)
        assert pieces(found) == n and pieces(found[:split]) > 0.5 * n
        assert sum(k for _, k in found) <= 1.01 * (h * np.arange(513)).sum() / 512 + 2


def test_token_counts(spark):
    pytest.importorskip("tiktoken")
    df = spark.createDataFrame([(1, "Hello world", 1), (2, "", 1), (3, None, 1), (None, "x", 1), (4, "<|endoftext|>", 1)], "id bigint, text string, tokens int")
    got = {r["key"]: r["tokens"] for r in packing.token_counts(df, "id", "text", "/opt/tokenizers").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and set(got) == {1, 2, 3, 4} and got[4] > 1


# 10 subjects -----------------------------------------------------------------------------------------------------

TOPICS = {"law": "court statute appeal permit clause liability".split(), "sport": "league match sprint referee goal squad".split(), "energy": "turbine battery grid fuel heat power".split()}


def _doc(rng, parts):
    out = []
    for t, n in parts:
        out += [f"The {rng.choice(TOPICS[t])} near the {rng.choice(TOPICS[t])} was measured with the {rng.choice(TOPICS[t])} in {rng.randrange(1990, 2020)}." for _ in range(n)]
    rng.shuffle(out)
    return " ".join(out)


def test_every_term_counts(spark):
    rng = random.Random(3)
    word = lambda i: "".join(chr(97 + (i // 26**n) % 26) for n in range(4))
    data = [(f"the of and {' '.join(word(i) for i in range(at, at + 60))}.", [("one", "two")[at // 60 % 2]]) for at in range(0, 42_000, 60)]
    rng.shuffle(data)
    data = data * 2 + [("the of and onlyonce.", ["one"])]
    counts = subjects.count_terms(spark.createDataFrame(data, "text string, ys array<string>"), ["one", "two"], None)
    totals = counts[counts["term"] == "en|"].iloc[0, 1:].sum()
    terms = sum(len(subjects.terms(ws)) for text, _ in data for ws in subjects.sentences(text))
    assert totals == terms and len(counts) > 80_000
    known = subjects.Terms(counts, ["one", "two"]).weight
    assert len(known) > 80_000 and all(f"en|{word(i)}" in known for i in range(42_000)) and "en|onlyonce" not in known


def test_subjects_held_out(spark):
    rng = random.Random(6)
    truth, docs, labels = {}, [], []
    for k in range(300):
        a, b = rng.sample(sorted(TOPICS), 2)
        parts = [(a, 6)] if k % 3 else [(a, 4), (b, 4)] if k % 2 else [(a, 9), (b, 1)]
        truth[k] = {t for t, n in parts if n > 3}
        docs.append((k, _doc(rng, parts), "s", None, "x"))
        if k % 5 < 2:
            labels += [(k, t.upper() + " ", "d") for t in truth[k]] * 2
    docs += [(900, None, None, None, "x"), (901, "", None, None, "x"), (902, "n/a", "s", "k", "x"), (None, "court", "s", "k", "x")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, section_kind string, subject string")
    l = spark.createDataFrame(labels + [(1, "nonsense", "d"), (None, "law", "d"), (2, None, "d")], "doc_id bigint, subject string, text string")
    areas = spark.createDataFrame([(t, " ".join(w)) for t, w in TOPICS.items()] + [(None, "x")], "subject string, description string")
    got = defaultdict(set)
    for r in subjects.assign(d, l, areas).collect():
        got[r["doc_id"]].add(r["subject"])
    right = sum(got[k] == truth[k] for k in truth if k % 5 > 1)
    assert right >= 0.93 * sum(1 for k in truth if k % 5 > 1) and not any(got[k] for k in (900, 901, 902))
    assert subjects.assign(d, l.limit(0), areas).count() == 0 and subjects.assign(d, l, areas.limit(0)).count() == 0 and subjects.assign(d.limit(0), l, areas).count() == 0


def test_subjects_keep_terms_off_the_driver(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(subjects, "count_terms", lambda *a: pytest.fail("terms on the driver"))
    docs = [(i, _doc(rng, [(t, 6)]), "s", "k") for i in range(90) for t in [sorted(TOPICS)[i % 3]]]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, section_kind string")
    l = spark.createDataFrame([(i, sorted(TOPICS)[i % 3]) for i in range(60)], "doc_id bigint, subject string")
    areas = spark.createDataFrame([(t, " ".join(w)) for t, w in TOPICS.items()], "subject string, description string")
    want = {(i, sorted(TOPICS)[i % 3]) for i in range(90)}
    for chunk in (4_000_000, 500):  # one chunk or many: the same subjects
        monkeypatch.setattr(subjects, "CHUNK", chunk)
        assert {(r[0], r[1]) for r in subjects.assign(d, l, areas).collect()} == want
