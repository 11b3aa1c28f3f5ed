"""Sources, pool, stages, clusters and institutions on small fixtures."""

import json
import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from evispark.operators import atoms, clusters, connect, graph, institutions, pool, portfolio, stages
from evispark.sources import documents


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_sweeps_by_rounds_equal_sweeps_in_one_task(spark, seed):
    rng = random.Random(seed)
    e = {(a, b): round(rng.uniform(0.5, 3), 2) for a in range(24) for b in range(a + 1, 24) if rng.random() < 0.12}
    edges = spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}", s) for (a, b), s in e.items()], "a string, b string, score double")
    nodes = spark.createDataFrame([(f"n{i:02d}",) for i in range(26)], "paper_id string")
    assert rows(graph.label_propagation(edges, nodes)) == rows(graph.label_propagation(edges, nodes, largest=2))


def test_sliced_pairs_equal_plain_ones(spark, monkeypatch):
    rng = random.Random(3)
    f = spark.createDataFrame([(f"p{i:02d}", e, 1.5) for i in range(30) for e in ("hot", rng.choice("abc"), "d")], "paper_id string, element_id string, idf double").distinct()
    plain = rows(graph.pair_sums(f))
    monkeypatch.setattr(graph, "SLICE", 4)
    assert rows(graph.pair_sums(f)) == plain and len(plain) == 30 * 29 // 2
    side = spark.createDataFrame([("p03",), ("p07",)], "paper_id string")
    assert rows(graph.pair_sums(f, side)) == [r for r in plain if r[0] in ("p03", "p07") or r[1] in ("p03", "p07")]


def test_best_edges_and_splits_form_no_pairs(spark, sf, monkeypatch):
    from evispark.plans import graph_queries, map_queries

    rng = random.Random(7)
    f = spark.createDataFrame([(f"p{i:02d}", e) for i in range(60) for e in rng.sample("abcdefgh", rng.randrange(1, 6))], "paper_id string, element_id string")
    w = graph.idf(f, 200)
    want = [(rows(graph.top_edges(graph.pair_scores(f, w, 200), k, least)), k, least) for k, least in ((1, 0.0), (3, 1.0))]
    _, g, n, v = graph_queries._material(spark, sf)
    all_pairs = rows(graph.top_edges(graph.pair_scores(g, v, n)))
    monkeypatch.setattr(graph, "pair_scores", lambda *a, **k: pytest.fail("all pairs"))
    for edges, k, least in want:
        assert rows(graph.best_edges(f, w, 200, k, least)) == edges and edges
    assert rows(graph_queries.g3_edges(spark, sf)) == all_pairs
    assert map_queries.g8_split(spark, sf).count() > 0


def test_best_pairs_by_blocks_are_those_of_all_pairs(spark, monkeypatch):
    from evispark.operators import grid

    rng = random.Random(8)
    weight = {i: w for i, w in enumerate([0.0, 0.0, 1.1, 1.1, 2.3, 3.7, 0.4, 5.1, 0.7])}
    sets = {f"p{i}": sorted(rng.sample(range(9), rng.randrange(1, 6))) for i in range(90)}
    want = set()
    for me, mine in sets.items():
        near = [(round(sum(weight[x] for x in mine if x in its), 9), other, len(set(mine) & set(its))) for other, its in sets.items() if other != me]
        want |= {(me, other, s, n) for s, other, n in sorted((x for x in near if x[0] > 0), reverse=True)[:4]}
    f = spark.createDataFrame([(p, its, [weight[x] for x in its]) for p, its in sets.items()], "id string, items array<bigint>, weights array<double>")
    for block, cells in ((16_384, 1 << 19), (13, 100)):  # workers have their own copy of the second: blocks of any width
        monkeypatch.setattr(grid, "BLOCK", block)
        monkeypatch.setattr(grid, "CELLS", cells)
        assert set(map(tuple, grid.best_pairs(f, 4).collect())) == want
    monkeypatch.setattr(grid, "BLOCK", 4_096)
    many = spark.range(12_000).selectExpr("concat('p', id) as id", "array(0L, 1 + id % 50, 100 + id % 997) as items", "array(0.1D, 2D, 4D) as weights")
    began = time.monotonic()
    assert grid.best_pairs(many, 10).where("s > 4").count() == 120_000
    assert time.monotonic() - began < 60


def test_portfolio_weighs_pairs_of_chosen_papers_only(spark, sf, monkeypatch):
    from evispark.operators import grid
    from evispark.plans import connect_queries, graph_queries

    rng = random.Random(10)
    sets = [(f"p{i}", its, [0.5 + x % 3 for x in its]) for i in range(80) if (its := sorted(rng.sample(range(9), rng.randrange(1, 6))))]
    f = spark.createDataFrame(sets, "id string, items array<bigint>, weights array<double>")
    mine = spark.createDataFrame([(f"p{i}",) for i in [*range(0, 80, 4), 4, 99]], "id string")
    whole = set(map(tuple, grid.best_pairs(f, 4).collect()))
    for block in (16_384, 13):
        monkeypatch.setattr(grid, "BLOCK", block)
        got = grid.best_pairs(f, 4, mine).collect()
        assert len(got) == 80 and set(map(tuple, got)) == {r for r in whole if int(r[0][1:]) % 4 == 0}
    assert grid.best_pairs(f, 4, mine.where("id = 'p99'")).count() == 0
    chosen = connect_queries._chosen(spark, sf).select("paper_id").distinct().cache()
    few, edges = {r[0] for r in chosen.collect()}, rows(graph_queries.c3_candidate_edges(spark, sf))
    assert rows(graph_queries.c3_candidate_edges(spark, sf, chosen)) == [e for e in edges if e[0] in few and e[1] in few]
    part = chosen.orderBy("paper_id").limit(12)
    some = {r[0] for r in part.collect()}
    assert rows(graph_queries.c3_candidate_edges(spark, sf, part)) == [e for e in edges if e[0] in some and e[1] in some]
    asked, plain = [], graph_queries.best_pairs
    monkeypatch.setattr(graph_queries, "best_pairs", lambda s, k, *m: asked.append([{r[0] for r in x.select("id").collect()} for x in m]) or plain(s, k, *m))
    assert connect_queries.pf8_recommended(spark, sf).count() > 0
    assert asked == [[few]]


def test_best_overlap_by_blocks_is_that_of_all_pairs(spark, monkeypatch):
    from evispark.operators import grid, intake

    rng = random.Random(9)
    data = [(i, rng.choice([None, "", " ".join(rng.choices("abcdef", k=rng.randrange(1, 6)))]), "www.x.org/" + rng.choice("pqr")) for i in range(70)] + [(None, "a", "b")]
    words = lambda t: set((t or "").replace(".", " ").replace("/", " ").split())
    want = set()
    for a, *x in data[:-1]:
        for b, *y in data[a + 1 : -1]:
            share = [len(words(u) & words(v)) / m for u, v in zip(x, y) if (m := min(len(words(u)), len(words(v))))]
            want |= {(a, b, round(max(share), 6))} if max(share) >= 0.72 else set()
    df = spark.createDataFrame(data, "id bigint, t string, u string")
    for block in (2_048, 11):
        monkeypatch.setattr(grid, "DENSE_BLOCK", block)
        got = intake.best_overlap(df, "id", {"t": F.col("t"), "u": F.col("u")}).collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want
    monkeypatch.setattr(grid, "DENSE_BLOCK", 2_048)
    many = spark.range(6_000).selectExpr("id", "concat('https://www.example.org/', id) as u")
    began = time.monotonic()
    assert intake.best_overlap(many, "id", {"u": F.col("u")}).where("best = 0.8").count() == 6_000 * 5_999 // 2
    assert time.monotonic() - began < 60


def test_sources_by_words_are_those_of_all_files_and_common_words_cost_nothing(spark):
    rng = random.Random(6)
    word = [f"word{c}" for c in "abcdefghijkl"]
    names = {f"p{i:02d}": rng.sample(word, rng.randrange(1, 9)) for i in range(50)}
    files = sorted({" ".join(rng.sample(word, rng.randrange(2, 10))) + ".pdf" for _ in range(30)} | {" ".join([*names[p], "more"]) + ".pdf" for p in list(names)[:20]})
    want = {}
    for p, ws in names.items():
        near = sorted((-len(set(ws) & set(f[:-4].split())) / len(ws), f) for f in files)
        near = [x for x in near if x[0] <= -0.6]
        want[p] = near[0][1] if near and (len(near) == 1 or -near[0][0] > -near[1][0] + 0.15) else None
    wanted = spark.createDataFrame([(p, " ".join(ws)) for p, ws in names.items()], "paper_id string, name string")
    got = pool.resolve_sources(wanted, spark.createDataFrame([(f,) for f in files], "file string"), ["pdf"])
    assert {r["paper_id"]: r["file"] for r in got.collect()} == want
    many = spark.range(12_000).selectExpr("concat('p', id) as paper_id", "concat('of the core gas flow in coal case', id, '.pdf') as name")
    began = time.monotonic()
    got = pool.resolve_sources(many, many.selectExpr("concat('copy ', name) as file"), [])
    assert got.where("file = concat('copy of the core gas flow in coal case', substring(paper_id, 2), '.pdf') and how = 'title_tokens'").count() == 12_000
    assert time.monotonic() - began < 60


def test_first_places_form_no_pairs(spark, sf, monkeypatch):
    from evispark.plans import map_queries

    monkeypatch.setattr(graph, "pair_scores", lambda *a, **k: pytest.fail("all pairs"))
    assert map_queries.g22_placed(spark, sf).count() == map_queries.load(spark, sf).papers.where("paper_id like '%0'").count()


def test_relaxing_a_crowd_keeps_the_order_of_pushes(spark):
    def plain(ids, at, rounds, least):
        for _ in range(rounds):
            for i in range(len(ids)):
                for j in range(i + 1, len(ids)):
                    dx, dy = at[i][0] - at[j][0], at[i][1] - at[j][1]
                    d = (dx * dx + dy * dy) ** 0.5
                    if d < least:
                        step = (least - d) / 2 + 1e-3
                        for k, sign in ((i, 1), (j, -1)):
                            at[k] = [min(max(v + sign * u / (d + 1e-9) * step, 0.0), 1.0) for v, u in zip(at[k], (dx, dy))]
        return {i: p for i, p in zip(ids, at)}

    rng = random.Random(8)
    many = [(f"p{i:05d}", rng.random() * 0.2, rng.random() * 0.2) for i in range(3_000)]
    few = many[:60]
    got = {r[0]: [r[1], r[2]] for r in clusters.relax(spark.createDataFrame(few, "paper_id string, x double, y double"), 5).collect()}
    want = plain([p[0] for p in few], [list(p[1:]) for p in few], 5, 0.02)
    assert all(abs(a - b) < 1e-9 for i in want for a, b in zip(got[i], want[i]))
    began = time.monotonic()
    assert clusters.relax(spark.createDataFrame(many, "paper_id string, x double, y double"), 8).count() == len(many) and time.monotonic() - began < 60


def test_new_papers_of_a_frequent_element_are_placed_without_all_pairs(spark):
    f = spark.range(60_000).selectExpr("concat('p', lpad(id, 6, '0')) as paper_id", "explode(array('all', concat('e', id % 9))) as element_id")
    w = spark.createDataFrame([("all", 0.1), *[(f"e{i}", 1.0) for i in range(9)]], "element_id string, idf double")
    now = f.groupBy("paper_id").agg(F.lit("x").alias("fingerprint"))
    old = now.where("paper_id not like '%3'")
    began = time.monotonic()
    state, placed = clusters.place_incrementally(old, now, f, w, old.select("paper_id", F.substring("paper_id", 7, 1).alias("label")))
    got = dict(placed.where("paper_id in ('p000003', 'p000013', 'p059993')").collect())
    assert state == "grown" and time.monotonic() - began < 60
    assert got == {"p000003": "2", "p000013": "4", "p059993": "8"}  # 12, 4 and 8 are the least old ones of the same remainder by 9


def test_nearest_is_that_of_all_pairs(spark):
    rng = random.Random(3)
    weight = {f"e{i}": (-0.5, 0.0, 0.1)[i] if i < 3 else 1.0 + i % 5 for i in range(30)}  # one element of more papers than counted, one of all
    sets = {f"p{i:02d}": set(rng.sample(sorted(weight)[:12], rng.randrange(1, 5))) | ({"e0", "e1"} if i % 3 else set()) for i in range(60)}
    sets |= {"w1": set(sorted(weight)[:14]), "w2": set(sorted(weight)[5:25]), "z": {"e29"}}
    f = spark.createDataFrame([(p, e, weight[e]) for p, es in sets.items() for e in es], "paper_id string, element_id string, idf double")
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "paper_id string")
    asks, pool = sorted(sets)[::2], sorted(sets)[::3]
    for k, others in ((3, None), (2, pool)):
        got = {(r["me"], r["other"]): r["score"] for r in graph.nearest(f, ids(asks), k, None if others is None else ids(others)).collect()}
        want = {}
        for me in asks:
            near = sorted((-round(sum(weight[e] for e in sets[me] & sets[o]), 9), o) for o in others or sets if o != me and sets[me] & sets[o])
            want |= {(me, o): -s for s, o in near[:k]}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-8 for x in want)


def test_split_and_merge(spark):
    edges = [(f"x{i}", f"x{j}", 3.0) for i in range(4) for j in range(i + 1, 4)] + [(f"y{i}", f"y{j}", 3.0) for i in range(4) for j in range(i + 1, 4)] + [("x0", "y0", 1.0), ("t0", "x1", 2.0), ("t0", "y1", 1.0)]
    e = spark.createDataFrame(edges, "a string, b string, score double")
    one = spark.createDataFrame([(p, "c") for p in [*(f"x{i}" for i in range(4)), *(f"y{i}" for i in range(4))]], "paper_id string, label string")
    none = spark.createDataFrame([], "paper_id string, element_id string"), spark.createDataFrame([], "element_id string, df long, idf double")
    got = dict(rows(clusters.split_oversized(one, e, *none, n_papers=8, most=6)))
    x, y = ({got[f"{k}{i}"] for i in range(4)} for k in "xy")
    assert len(x) == len(y) == 1 and x != y and min(x).startswith("c>x") and min(y).startswith("c>y")
    assert rows(clusters.split_oversized(one, e, *none, n_papers=8, most=8)) == rows(one)
    l = spark.createDataFrame([(p, "X") for p in ("x0", "x1", "x2")] + [(p, "Y") for p in ("y0", "y1", "y2")] + [("t0", "t"), ("u0", "u")], "paper_id string, label string")
    assert dict(rows(clusters.merge_tiny(l, e)))["t0"] == "X" and dict(rows(clusters.merge_tiny(l, e)))["u0"] == "__misc__"
    assert dict(rows(clusters.merge_tiny(l, e, most=1)))["t0"] == "__misc__" and rows(clusters.merge_tiny(l, e, least=9)) == rows(l)


def test_layout_is_stable_and_inside(spark):
    l = spark.createDataFrame([(f"p{i:02d}", f"c{i % 5}" if i < 20 else "__misc__") for i in range(26)], "paper_id string, label string")
    y = spark.createDataFrame([(f"p{i:02d}", 2000 + i % 7) for i in range(20)], "paper_id string, year int")
    a = clusters.radial_layout(l, y)
    pos = {r["paper_id"]: (r["x"], r["y"]) for r in a.collect()}
    assert len(pos) == 26 and all(0 <= v <= 1 for p in pos.values() for v in p) and rows(a) == rows(clusters.radial_layout(l, y))
    near = spark.createDataFrame([("p00", 0.5, 0.5), ("p01", 0.505, 0.5), ("p02", 0.9, 0.9)], "paper_id string, x double, y double")
    moved = {r[0]: r[1:] for r in rows(clusters.relax(near))}
    assert moved["p02"] == (0.9, 0.9) and sum((a - b) ** 2 for a, b in zip(moved["p00"], moved["p01"])) ** 0.5 >= 0.02 - 1e-9


def test_incremental_states(spark):
    f = spark.createDataFrame([("a", "x"), ("b", "y"), ("n", "x")], "paper_id string, element_id string")
    w, now = graph.idf(f, 3), clusters.fingerprints(f)
    l = spark.createDataFrame([("a", "A"), ("b", "B")], "paper_id string, label string")
    state, got = clusters.place_incrementally(now.where("paper_id <> 'n'"), now, f, w, l)
    assert state == "grown" and dict(rows(got)) == {"a": "A", "b": "B", "n": "A"}
    assert clusters.place_incrementally(now, now, f, w, l)[0] == "same"
    assert clusters.place_incrementally(now.withColumn("fingerprint", F.lit("old")), now, f, w, l)[0] == "rebuild"


def test_institutions_in_order(spark):
    reg = spark.createDataFrame([("elem:institution/known", "institution", "Known Place", ["KP"], None, 1)], "element_id string, facet string, display_name string, aliases array<string>, redirect_to string, ordinal int")
    finals = reg.select("element_id", F.col("element_id").alias("final"))
    df = spark.createDataFrame([("a", ["kp", "New Lab", "", "new  lab"]), ("b", ["NEW LAB", "Known place"]), ("c", []), ("d", None)], "row string, names array<string>")
    got, new = institutions.resolve(df, reg, finals)
    assert {r["row"]: r["institution_ids"] for r in got.collect()} == {"a": ["elem:institution/known", "elem:institution/new-lab"], "b": ["elem:institution/new-lab", "elem:institution/known"], "c": [], "d": []}
    assert [r["display_name"] for r in new.collect()] == ["New Lab"]


DOC = {
    "texts": [{"label": "section_header", "text": "One", "prov": [{"page_no": 1}]}, {"label": "caption", "text": "A figure"}, {"label": "text", "orig": "Inside"}, {"label": "text", "text": "Last", "content_layer": "furniture"}],
    "pictures": [{"captions": [{"$ref": "#/texts/1"}, {"$ref": "#/texts/9"}]}], "groups": [{"children": [{"$ref": "#/texts/2"}, {"$ref": "#/groups/0"}, {"$ref": "#/pictures/0"}]}],
    "body": {"children": [{"$ref": "#/texts/0"}, {"$ref": "#/groups/0"}, {"$ref": "#/texts/0"}, {"$ref": "#/tables/4"}, {"$ref": "#/texts/3"}]},
}


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(DOC))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text("[1]")
    got = documents.read_items(spark, str(tmp_path / "*.json")).orderBy("pos").collect()
    assert [(r["kind"], r["idx"], r["text"], r["caption"], r["page"]) for r in got] == [("texts", 0, "One", "", 1), ("texts", 2, "Inside", "", None), ("pictures", 0, "", "A figure", None), ("texts", 3, "Last", "", None)]


def test_figures(spark, tmp_path):
    (tmp_path / "S1" / "figures").mkdir(parents=True)
    png = lambda w, h: b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", w, h) + b"rest"
    for name, data in (("logo.png", png(40, 400)), ("big.png", png(600, 400)), ("mid.png", png(200, 200)), ("said.png", png(10, 10)), ("x.jpg", b"jpeg"), ("note.txt", b"no")):
        (tmp_path / "S1" / "figures" / name).write_bytes(data)
    meta = spark.createDataFrame([("S1", "big.png", 1, ""), ("S1", "mid.png", 1, None), ("S1", "said.png", 1, "Caption"), ("S1", "x.jpg", 2, "")], "paper_id string, name string, page int, caption string")
    got = {r["name"]: (r["width"], r["hidden"]) for r in documents.figures(spark, str(tmp_path / "*" / "figures" / "*"), meta).collect()}
    assert got == {"logo.png": (40, True), "big.png": (600, False), "mid.png": (200, True), "said.png": (10, False), "x.jpg": (None, False)}


def test_remote_records_and_sinks(spark, tmp_path):
    c = [json.dumps({"DOI": "10.1/X", "title": ["T"], "author": [{"family": "Lee", "given": "Min"}, {"family": "Org"}], "published-online": {"date-parts": [[2003, 4]]}}), "broken", json.dumps({"DOI": None})]
    got = documents.crossref_records(spark.createDataFrame([(x,) for x in c], "value string")).where("doi <> ''").collect()
    assert [tuple(r) for r in got] == [("10.1/x", "T", "", "2003", ["Lee, Min", "Org"])]
    o = [json.dumps({"doi": "https://doi.org/10.1/X", "authorships": [{"author": {"display_name": "A"}, "raw_affiliation_strings": ["U"]}, {"author": {"display_name": "B"}}]})]
    assert [(r["position"], r["name"], r["is_senior"]) for r in documents.openalex_authorship(spark.createDataFrame([(x,) for x in o], "value string")).collect()] == [(1, "A", False), (2, "B", True)]
    documents.write_csv(spark.createDataFrame([("é", 1)], "name string, n int"), str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbfname,n")
    s = documents.Sources()
    s.register("a", search=len, fetch=str)
    s.register("b", search=max)
    assert list(s.of("search")) == ["a", "b"] and list(s.of("fetch")) == ["a"] and s.of("none") == {}


def test_attachments(spark):
    items = spark.createDataFrame([(1, "K1"), (2, "K2"), (3, "K3")], "item int, key string")
    att = spark.createDataFrame([(1, 9, "a.PDF"), (2, None, "b.pdf"), (3, 9, "c.txt")], "item int, parent int, path string")
    val = spark.createDataFrame([(9, "title", "T"), (9, "DOI", "10.1/x"), (9, "other", "o")], "item int, field string, value string")
    assert rows(documents.attachments(items, att, val, ["title", "DOI"])) == [(1, "K1", "a.PDF", 9, 2, "T", "10.1/x"), (2, "K2", "b.pdf", None, 0, None, None)]


def test_file_names(spark):
    cases = {"Lee 等 - 2024 - Gas in pores.pdf": ("2024", "Lee", "Gas in pores"), "2019-Title of it_Min Lee.pdf": ("2019", "Min", "Title of it"), "2019_Title only.pdf": ("2019", "unknown", "Title only"), "Title in 2001_Brown.pdf": ("2001", "Brown", "Title in 2001"), "Plain title.pdf": ("", "unknown", "Plain title"), None: ("", "unknown", "")}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r["n"]: tuple(r["p"]) for r in df.select("n", pool.name_parts(F.col("n")).alias("p")).collect()} == cases


def test_promotion_names(spark):
    r = spark.createDataFrame([("c1", "a" * 20, "X.pdf", 1), ("c2", "b" * 20, "x.PDF".lower(), 2), ("c3", "a" * 12 + "z", "X.pdf", 3), ("c4", "d" * 20, "Y.pdf", 4), ("c5", "e" * 20, "Z.pdf", 5)], "candidate_id string, sha string, target string, arrival int")
    p = spark.createDataFrame([("d" * 20, "old.pdf"), ("q", "z.pdf")], "sha string, name string")
    gone = spark.createDataFrame([], "candidate_id string")
    got = {x[0]: x[1:] for x in rows(pool.promotion_plan(r, p, gone))}
    assert got == {"c1": ("ready", "X.pdf"), "c2": ("ready", "x_" + "b" * 12 + ".pdf"), "c3": ("ready", "X_" + "a" * 12 + ".pdf"), "c4": ("skip_hash_already_in_pool", "Y.pdf"), "c5": ("ready", "Z_" + "e" * 12 + ".pdf")}
    assert {x[0]: x[1] for x in rows(pool.promotion_plan(r, p, gone, "error"))}["c2"] == "error_conflict"


def test_work_selection(spark):
    m = spark.createDataFrame([("S1", "active", False, None), ("S2", "active", True, None), ("S3", "active", False, ["S1"]), ("S4", "gone", False, None)], "paper_id string, status string, deferred boolean, possible_duplicate_of array<string>")
    assert rows(stages.select_work(m, everything=True)) == [("S1", "selected"), ("S2", "deferred"), ("S3", "possible_duplicate")]
    assert rows(stages.select_work(m, ids=["s2", "s3", "S9"], duplicates=True)) == [("S2", "selected"), ("S3", "selected"), ("S9", "missing")] and stages.select_work(m).count() == 0


def test_sample_drift_and_mentions(spark):
    ids = spark.createDataFrame([(f"p{i:03d}",) for i in range(97)], "paper_id string").repartition(5)
    assert [r["paper_id"] for r in atoms.even_sample(ids, "paper_id", 20).orderBy("pos").collect()] == [f"p{i:03d}" for i in range(0, 80, 4)]
    df = spark.createDataFrame([("heated to 350 K at 12 MPa", "heated to 3 50 K"), (None, "x"), ("12", None)], "c string, q string")
    assert [r[0] for r in df.select(atoms.drifted(F.col("c"), F.col("q"))).collect()] == [["12 MPa"], [], []]
    b = spark.createDataFrame([("p", "b1", 1, "results", "paragraph", "Shale gas flows; the shale gas flow rate and gasflow."), ("p", "b2", 2, "references", "paragraph", "shale gas")], "paper_id string, id string, block_order int, section_kind string, reading_type string, text string")
    v = spark.createDataFrame([("shale gas", "shale gas"), ("shale gas flow", "flow of gas"), ("gas", "gas"), ("flow", "other")], "surface string, concept string")
    assert rows(connect.mentions(b, v).select("concept", "id")) == [("flow of gas", "b1"), ("shale gas", "b1")]


def test_portfolio_labels(spark):
    df = spark.createDataFrame([("H₂O – Methane  x",), (None,)], "t string")
    assert [r[0] for r in df.select(portfolio.norm_text(F.col("t"))).collect()] == ["h2o - ch4 methane x", ""]
    n = spark.createDataFrame([(45, 350, 90, 40), (30, 200, 60, 0), (1, 1, 1, 1)], "p int, a int, s int, e int")
    assert [r[0][:10] for r in n.select(portfolio.level(*[F.col(c) for c in "pase"])).collect()] == ["strong_120", "borderline", "insufficie"]
