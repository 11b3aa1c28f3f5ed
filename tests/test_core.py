import glob
import math
import os
import time

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evispark import keys
from evispark.functions.quantities import KNOWN, mentions, number
from evispark.operators import blocks, evidence, graph, quotes, registry, resolution, units
from evispark.operators.components import connected_components
from evispark.plans import queries as core
from evispark.sources import bibliography, library
from evispark.streaming import imports
from evispark.tables import latest


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = core.QUERIES[name](spark, sf)
    found = con.execute(core.SQL[name])
    cols = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(cols)
    canon = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    mine = sorted(tuple(canon(r[c]) for c in sorted(cols)) for r in df.collect())
    at = [cols.index(c) for c in sorted(cols)]
    assert mine == sorted(tuple(canon(r[i]) for i in at) for r in found.fetchall())


def test_keys(spark):
    df = spark.createDataFrame([("X-Ray  Diffraction!",), (None,), ("",), ("éß",)], "s string")
    got = [tuple(r) for r in df.select(keys.norm_key(F.col("s")), keys.slugify(F.col("s")), keys.dedupe_key(F.lit("cells gas analysis"))).collect()]
    assert got[0] == ("x ray diffraction", "x-ray-diffraction", "cell gas analysis")
    assert got[1][0] is None and got[1][1] == "unnamed" and got[2][:2] == ("", "unnamed") and got[3][:2] == ("", "éß")


@pytest.mark.parametrize(
    "text, found",
    [
        ("measured at 333 K up to 25 MPa", [(333, 333, "K"), (25, 25, "MPa")]),
        ("1.42, 4.48 and 6.72 pounds", [(1.42, 1.42, "pounds"), (4.48, 4.48, "pounds"), (6.72, 6.72, "pounds")]),
        ("2.13~6.83 MPa", [(2.13, 6.83, "MPa")]), ("between 20 °C to 30 °C", [(20, 30, "°C")]),
        ("a ramp of 5 K/min", []), ("see Fig. 3 h.", []), ("12 wt% binder", []), ("in run 17", []), ("400 rpm at pH 6.5", []),
        ("1,310 K", [(1310, 1310, "K")]), ("70,9 g", [(70.9, 70.9, "g")]), ("7 899 µm", [(7899, 7899, "µm")]), ("1.5·10^6 nanometres", [(1.5e6, 1.5e6, "nanometres")]),
        ("0.0199 ± 0.01 weeks", [(0.0199, 0.0199, "weeks")]), ("", []), (None, []), ("1 m s-1", []),
    ],
)
def test_mentions(text, found):
    assert [m[:3] for m in mentions(text)] == found


def test_two_part_value():
    assert mentions("23 h and 30 min") == [(23.0, 23.0, "h", 30.0, "min")]


@settings(max_examples=200, deadline=None)
@given(st.floats(1e-4, 9e5), st.sampled_from(sorted(u for u in KNOWN if u[0].isalpha() and len(u) > 2)))
def test_mentions_round_trip(value, unit):
    text = f"{value:.4g}"
    (m,) = mentions(f"kept at {text} {unit} throughout")
    assert m[0] == pytest.approx(number(text)) and KNOWN[m[2]][:1] == KNOWN[unit][:1]


def test_very_long_text_of_numbers():
    assert len(mentions("at 5 K and then " * 2000)) == 2000


def _occ(spark, data):
    return spark.createDataFrame(data, "occ_id bigint, element_id string, quote string, values_json string, key string")


def test_harmonise_cases(spark):
    targets = spark.createDataFrame([("pressure", "Pa"), ("temperature", "K"), ("duration", "s")], "quantity string, common_unit string")
    data = [(1, "e", "2 bar", None, "x"), (1, "e", "2 bar", None, "x"), (2, None, "100 °C", "[]", None), (3, "e", None, "broken", "x"), (4, "e", "", "", "x"), (None, "e", "1 h 30 min", None, "x"), (5, "e", "5 kg", None, "x")]
    got = rows(units.harmonise(_occ(spark, data), targets, "occ_id", "element_id", "quote", "values_json"))
    assert got == sorted([(1, "pressure", 2e5, 2e5), (2, "temperature", 373.15, 373.15), (None, "duration", 5400.0, 5400.0)], key=repr)
    assert units.harmonise(_occ(spark, []), targets, "occ_id", "element_id", "quote", "values_json").count() == 0


def test_unknown_spelling_is_snapped(spark):
    import random

    rng = random.Random(3)
    data, n = [], 0
    for e in range(12):
        for _ in range(60):
            x = 10 ** rng.gauss(e % 4, 0.15)
            data += [(n, f"e{e}", f"{x:.4g} Pa", '[{"raw": "a", "unit": "Pa", "num": "1"}]', ""), (n + 1, f"e{e}", f"{x / 1e3:.4g} kilopasc", '[{"raw": "a", "unit": "kilopasc", "num": "1"}]', "")]
            n += 2
    df = _occ(spark, data)
    extra = tuple(units.unknown_spellings(df, "values_json"))
    assert extra == ("kilopasc",)
    found = units.unit_map(units.stated(df, "occ_id", "element_id", "quote", extra), {"pressure": "Pa"})
    assert found["kilopasc"] == ("pressure", 1e3, 0.0, "snapped") and found["Pa"][3] == "common"


def _recorded(spark, spelling, factor, entities=12, n=60, seed=3):
    """Values of one quantity per entity, recorded in Pa and under a spelling that means `factor` Pa."""
    import random

    rng = random.Random(seed)
    data = []
    for e in range(entities):
        for _ in range(n):
            x = 10 ** rng.gauss(4 + e % 4, 0.15)
            data += [(len(data), f"e{e}", f"{x:.4g} Pa", '[{"raw": "a", "unit": "Pa", "num": "1"}]', ""), (len(data) + 1, f"e{e}", f"{x / factor:.4g} {spelling}", f'[{{"raw": "a", "unit": "{spelling}", "num": "1"}}]', "")]
    return _occ(spark, data)


@pytest.mark.parametrize("spelling, factor, entities, n", [("kilopasc", 1e3, 12, 60), ("megapsc", 1e6, 8, 40), ("barr", 1e5, 20, 12), ("atmosf", 101325.0, 12, 60)])
def test_planted_spellings_are_recovered(spark, spelling, factor, entities, n):
    df = _recorded(spark, spelling, factor, entities, n)
    targets = spark.createDataFrame([("pressure", "Pa")], "quantity string, common_unit string")
    rows_, found = units.conversions_of(df, targets, "occ_id", "element_id", "quote", "values_json")
    assert found[spelling][3] == "snapped" and abs(math.log10(found[spelling][1] / factor)) < 0.02
    got = units.convert(rows_, found)
    assert got.count() == df.count()


@pytest.mark.parametrize("entities, how", [(12, "refused"), (3, "known")])
def test_a_known_unit_used_for_another_is_refused_on_strong_evidence(spark, entities, how):
    df = _recorded(spark, "bar", 1e3, entities)
    targets = spark.createDataFrame([("pressure", "Pa")], "quantity string, common_unit string")
    _, found = units.conversions_of(df, targets, "occ_id", "element_id", "quote", "values_json")
    assert found["bar"][3] == how and found["bar"][1] == pytest.approx(1e3 if how == "refused" else 1e5, rel=0.02)


def test_latest(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 2), (None, "c", 1), (2, None, None)], "id int, v string, t int")
    assert rows(latest(df, ["id"], "t", ["v"])) == sorted([(1, "b"), (2, None), (None, "c")], key=repr)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {x: root(x) for x in parent}


def test_idf_and_edges(spark):
    f = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "x"), ("C", "x"), ("C", "z")], "paper_id string, element_id string")
    assert {r["element_id"]: round(r["idf"], 6) for r in graph.idf(f, 3).collect()} == {"x": 0.0, "y": round(math.log(3), 6), "z": round(math.log(3), 6)}


def test_label_propagation(spark):
    e = [("A", "B", 1.0), ("A", "C", 1.0), ("B", "C", 1.0), ("D", "E", 1.0), ("D", "F", 1.0), ("E", "F", 1.0)]
    edges = spark.createDataFrame(e, "a string, b string, score double")
    nodes = spark.createDataFrame([(x,) for x in "ABCDEFX"], "paper_id string")
    got = {r[0]: r[1] for r in graph.label_propagation(edges, nodes).collect()}
    assert len({got[x] for x in "ABC"}) == 1 and len({got[x] for x in "DEF"}) == 1 and got["X"] == "X" and got["A"] != got["D"]


def test_registry(spark):
    e = spark.createDataFrame([("e:a/1", "a", "Gas cells", '["GC", "", "gas cell"]', 0), ("e:a/2", "a", "gas cell", None, 1), ("e:b/1", "b", "Gas cells", "broken", None)], "element_id string, facet string, display_name string, aliases_json string, human_locked int")
    v = spark.createDataFrame([("a", "gc"), ("a", "Gas-Cells"), ("b", "gc"), (None, "gc"), ("a", None)], "facet string, surface string")
    assert rows(registry.lookup(v, e)) == sorted([("a", "gc", "e:a/1"), ("a", "Gas-Cells", "e:a/1"), ("b", "gc", None), (None, "gc", None), ("a", None, None)], key=repr)


REG = "element_id string, facet string, display_name string, aliases array<string>, redirect_to string, origin string, human_locked int, ordinal int"


def test_redirects_and_duplicates(spark):
    e = [("a", "f", "Gas cells", ["GC"], "b", "seed", 0, 1), ("b", "f", "gas cell", [], "c", "x", 0, 2), ("c", "f", "core", [], None, "x", 0, 3), ("p", "f", "p", [], "q", "x", 0, 4), ("q", "f", "q", None, "p", "x", 0, 5), ("r", "f", "r", [], "p", "x", 0, 6), ("s", "f", "s", [], "gone", "x", 0, 7)]
    df = spark.createDataFrame(e, REG)
    assert dict(rows(registry.resolve_redirects(df))) == {"a": "c", "b": "c", "c": "c", "p": "p", "q": "q", "r": "p", "s": "gone"}
    assert registry.resolve_redirects(df.limit(0)).count() == 0
    found = registry.find(spark.createDataFrame([("f", "gc", 1), ("f", "none", 2), (None, "gc", 3)], "facet string, surface string, ordinal int"), df, registry.resolve_redirects(df))
    assert {r["surface"]: r["element_id"] for r in found.where("facet is not null").collect()} == {"gc": "c", "none": None}
    d = [("a", "f", "Isotherm", [], None, "x", 0, 1), ("b", "f", "isotherms", ["x"], None, "x", 0, 2), ("c", "f", "Isotherms", [], None, "x", 1, 3), ("d", "f", "isotherm", [], None, "x", 1, 4), ("e", "g", "isotherm", [], None, "seed", 0, 5)]
    assert rows(registry.duplicates(spark.createDataFrame(d, REG))) == [("f", "isotherm", "c", "a,b", 1)]
    merged = {r["element_id"]: r["redirect_to"] for r in registry.merge_duplicates(spark.createDataFrame(d, REG)).collect()}
    assert merged == {"a": "c", "b": "c", "c": None, "d": None, "e": None}


def test_new_ids_and_seeds(spark):
    e = spark.createDataFrame([("elem:f/x",), ("elem:f/x-3",)], "element_id string")
    new = spark.createDataFrame([("f", "X", 1), ("f", "x", 2), ("f", "x!", 3), ("f", "y", 4), ("f", "", 5)], "facet string, display_name string, arrival int")
    assert {r["arrival"]: r["element_id"] for r in registry.create_entries(e, new).collect()} == {1: "elem:f/x-2", 2: "elem:f/x-4", 3: "elem:f/x-5", 4: "elem:f/y", 5: "elem:f/unnamed"}
    clash = spark.createDataFrame([("f", "z", 1), ("f", "z", 2), ("f", "z 2", 3)], "facet string, display_name string, arrival int")
    assert {r["arrival"]: r["element_id"] for r in registry.create_entries(e, clash).collect()} == {1: "elem:f/z", 2: "elem:f/z-2", 3: "elem:f/z-2-2"}
    seeds = spark.createDataFrame([("f", "Gas cell", ["gas-cell", "GC"], 1), ("f", "gas  cell", None, 2)], "facet string, canonical string, aliases array<string>, ordinal int")
    assert [(r["element_id"], r["display_name"], r["aliases"]) for r in registry.from_seeds(seeds).collect()] == [("elem:f/gas-cell", "gas  cell", [])]


def test_events(spark):
    e = spark.createDataFrame([("a", "f", "One", [], None, "x", 0, 1), ("b", "f", "Two", ["II"], None, "x", 0, 2), ("c", "f", "Three", [], None, "x", 0, 3)], REG)
    log = [(1, "alias", "a", "one!", "auto"), (2, "alias", "a", "I", "auto"), (3, "alias", "a", "i", "auto"), (4, "merge", "b", "c", "auto"), (5, "merge", "a", "b", "human"), (6, "rename", "c", "Drei", "human"), (7, "merge", "c", "a", "auto"), (8, "alias", "zz", "x", "auto"), (9, "merge", "a", "zz", "auto")]
    got = {r[0]: tuple(r)[1:] for r in registry.fold_events(e, spark.createDataFrame(log, "seq int, event string, element_id string, detail string, source string")).collect()}
    assert got == {"a": ("One", ["I"], "c", 0), "b": ("Two", ["II"], "c", 0), "c": ("Drei", ["Three"], None, 1)}


def test_an_entry_of_very_many_aliases_is_folded_once_per_key(spark):
    e = spark.createDataFrame([("a", "One", [], None, 0), ("b", "Two", [], "a", 0)], "element_id string, display_name string, aliases array<string>, redirect_to string, human_locked int")
    every = spark.range(40_000).selectExpr("id as seq", "'alias' as event", "'a' as element_id", "concat('Name ', if(id % 2 = 0, '', '- '), id % 2000) as detail", "'auto' as source")
    log = every.unionAll(spark.createDataFrame([(500, "rename", "a", "name 7", "human"), (501, "rename", "a", "name 7!", "human"), (-5, "alias", "b", "Zwei", "auto"), (None, "alias", "b", "II", "auto")], "seq bigint, event string, element_id string, detail string, source string"))
    began = time.monotonic()
    got = {r["element_id"]: r for r in registry.fold_events(e, log).collect()}
    assert time.monotonic() - began < 30
    assert (got["a"]["display_name"], got["a"]["human_locked"], len(got["a"]["aliases"])) == ("name 7", 1, 2001) and got["a"]["aliases"][:2] == ["Name 0", "Name - 1"]
    assert tuple(got["b"])[1:] == ("Two", ["Zwei", "II"], "a", 0)


def test_chunks(spark):
    items = [("f", f"k{i:03d}", [f"c{i}", "c0"]) for i in range(65)] + [("g", "k", [f"d{i}" for i in range(300)]), ("g", "m", None), (None, "k", [])]
    got = {(r["facet"], r["key"]): r["chunk"] for r in resolution.pack_chunks(spark.createDataFrame(items, "facet string, key string, ids array<string>")).collect()}
    assert [got["f", f"k{i:03d}"] for i in (0, 29, 30, 59, 60)] == [1, 1, 2, 2, 3] and (got["g", "k"], got["g", "m"]) == (1, 2) and len(got) == 67


def test_quotes(spark):
    text = "The ﬁne montmorillonite was ball-milled for 4 h at 400 rpm under N2."
    cases = [("fine montmorillonite was ... ball-milled for 4 h", True, True, ""), ("montmorillonite was ball-milled for 9 h", True, False, ""), ("short", False, False, "too_short"), (None, False, False, "too_short"), ("entirely other words here", False, False, "not_found")]
    df = spark.createDataFrame([(q, text, i) for i, (q, *_) in enumerate(cases)], "q string, t string, i int")
    got = {r["i"]: (r["quote_verified"], r["digits_verified"], r["quote_reason"]) for r in quotes.verified(df, "q", "t").collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    r = spark.createDataFrame([("gas was stored in the cell", "First there was nothing at all. Gas was stored in the large cell then.")], "q string, t string")
    assert r.select(quotes.repaired_quote(F.col("q"), F.col("t")), quotes.in_block(F.col("q"), F.col("t"))).first()[:] == ("Gas was stored in the large cell then.", False)


BLOCK = "paper_id string, ord int, section_id string, section_kind string, reading_type string, include boolean, page_start int, page_end int, source_ids array<string>, text string, join_reason string, confidence double"


def _block(n, text, kind="paragraph", section="s1", include=True, section_kind="results", ids=None, pages=(1, 1), paper="p"):
    return (paper, n, section, section_kind, kind, include, *pages, ids or [f"b{n}"], text, "", 1.0)


def test_interrupted_paragraphs(spark):
    rows_ = [
        _block(1, "The gas was stored in the", pages=(1, 1)), _block(2, None, "figure"), _block(3, "Where x is the pressure of the cell."), _block(4, "Cell until it was used again.", pages=(2, 2)),
        _block(5, "A whole sentence stands here."), _block(6, "and it goes on after the page.", section_kind="results"), _block(7, "the next section is apart", section="s2"), _block(8, "and stays so.", section="s3"),
        _block(9, "One unfinished list of many", section="s4", section_kind="references"), _block(10, "and its rest.", section="s4", section_kind="references"), _block(1, "", paper="q"), _block(2, None, paper="q"),
    ]
    got = {(r["paper_id"], r["ord"]): r for r in blocks.coalesce_paragraphs(spark.createDataFrame(rows_, BLOCK)).collect()}
    assert got["p", 1]["text"] == "The gas was stored in the Cell until it was used again." and got["p", 1]["source_ids"] == ["b1", "b4"] and (got["p", 1]["page_start"], got["p", 1]["page_end"], got["p", 1]["confidence"]) == (1, 2, 0.75)
    assert got["p", 4]["text"] == "A whole sentence stands here. and it goes on after the page." and "continuation paragraph" in got["p", 4]["join_reason"]
    assert [got["p", n]["text"] for n in (5, 6, 7, 8)] == ["the next section is apart", "and stays so.", "One unfinished list of many", "and its rest."] and len(got) == 10
    assert blocks.coalesce_paragraphs(spark.createDataFrame([], BLOCK)).count() == 0


def test_skips_end(spark):
    far = [_block(1, "The gas was stored in the"), *[_block(k, None, "figure") for k in range(2, 11)], _block(11, "and used again.")]
    near = far[:9] + [_block(10, "and used again.")]
    count = lambda x: blocks.coalesce_paragraphs(spark.createDataFrame(x, BLOCK)).count()
    assert count(far) == len(far) and count(near) == len(near) - 1


def test_first_page(spark):
    rows_ = [_block(1, "We report a gas. which fills", section="a", section_kind="abstract", ids=["x", "y"]), _block(2, "Introduction", "section_heading", section="i", section_kind="introduction"), _block(3, "The pores of rock are known to hold the gas", section="i", section_kind="introduction", pages=(1, 1))]
    content = spark.createDataFrame([("p", "x", 1, "We report a gas."), ("p", "y", 2, "which fills"), ("p", "b3", 1, "The pores")], "paper_id string, block_id string, page int, text string")
    got = {r["ord"]: r for r in blocks.untangle_first_page(spark.createDataFrame(rows_, BLOCK), content).collect()}
    assert got[1]["text"] == "We report a gas." and got[1]["source_ids"] == ["x"] and got[3]["source_ids"] == ["b3", "y"] and got[3]["text"].endswith("hold the gas which fills") and got[3]["page_end"] == 2 and got[3]["confidence"] == 0.65
    same = {r["ord"]: r["source_ids"] for r in blocks.untangle_first_page(spark.createDataFrame(rows_[:2], BLOCK), content).collect()}
    assert same[1] == ["x", "y"]


def test_letters_titles_dois(spark):
    df = spark.createDataFrame([("a j o u r n a l of X Y gas i s",), ("",), ("a b",)], "t string")
    assert [r[0] for r in df.select(blocks.fused_letters(F.col("t"))).collect()] == ["ajournal of X Y gas i s", "", "a b"]
    one = lambda f, x: spark.createDataFrame([(x,)], "t string").select(f(F.col("t"))).first()[0]
    assert one(blocks.stem_title, "S12_2016_Lee_gas_fl ow_in_pores_j.fuel.2016.12.001") == "gas flow in pores" and one(blocks.stem_title, None) == ""
    assert [one(blocks.doi_in, x) for x in ("see 10.1000/abc.5.", "j.fuel-2016.12_001", "x C5RA12345A y", "aic_15123", "123456-pa", None)] == ["10.1000/abc.5", "10.1016/j.fuel.2016.12.001", "10.1039/C5RA12345A", "10.1002/aic.15123", "10.2118/123456-PA", ""]


def test_parse_values(spark):
    df = spark.createDataFrame([("0.1-30 MPa then 4 h at 400 rpm",), ("cooled to -10 °C",), ("25MPa",), ("under nitrogen",)], "q string")
    got = [[tuple(x) for x in r[0]] for r in df.select(evidence.parse_values(F.col("q"))).collect()]
    assert got == [[("0.1-30", "MPa"), ("4", "h"), ("400", "rpm")], [], [("25", "MPa")], []]


def test_cjk(spark):
    df = spark.createDataFrame([("English",), ("中文",), ("ab中文",), (None,), ("",)], "t string")
    got = [tuple(r) for r in df.select(evidence.cjk_share_all(F.col("t")), evidence.cjk_share_letters(F.col("t"))).collect()]
    assert got == [(0.0, 0.0), (1.0, 1.0), (0.5, 0.5), (0.0, 0.0), (0.0, 0.0)]


RIS = "TY  - JOUR\nTI  - First\n  title\nAU  - Lee, M.\nAU  - Brown, B.\nPY  - 2001/05\nDO  - 10.1/x\nUR  - https://x/pii/S12\nER  - \nTY  - JOUR\nTI  - Second\nTY  - JOUR\nTI  - Third\n"


def test_bibliography(spark, tmp_path):
    (tmp_path / "a.ris").write_text(RIS)
    strict = bibliography.read_records(spark, str(tmp_path)).collect()
    assert [(r["title"], r["year"], r["authors"], r["pii"]) for r in strict] == [("First title", "2001", ["Lee, M.", "Brown, B."], "S12")]
    pool = bibliography.read_records(spark, str(tmp_path), flush_on_type=True).collect()
    assert sorted(r["title"] for r in pool) == ["First title", "Second", "Third"]


def test_library_scan_and_tables(spark, tmp_path):
    from pyspark.sql.types import StringType, StructField, StructType

    for name, text in (("S1", '{"paper_id": "S1", "title": "t"}'), ("S2", '{"title": "u"}'), ("S3", "{broken"), ("S4", "[]")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "card.json").write_text(text)
    schema = StructType([StructField("paper_id", StringType()), StructField("title", StringType())])
    got = {(r["paper_id"], r["title"]) for r in library.scan(spark, f"{tmp_path}/*/card.json", schema).collect()}
    assert {("S1", "t"), ("S2", "u")} <= got and not any(p == "S3" for p, _ in got)
    out = str(tmp_path / "table")
    library.replace_table(spark.range(3), out)
    library.replace_table(spark.range(5), out)
    assert library.read_table(spark, out).count() == 5


def test_stream_resolves_once(spark, sf, tmp_path):
    elements = spark.read.parquet(f"{sf}/elements.parquet")
    occ = spark.read.parquet(f"{sf}/occurrences.parquet")
    occ.repartition(3).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    imports.run(imports.arrivals(spark, str(tmp_path / "in"), occ.schema, 1), elements, out, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == occ.count() and got.where("element_id is null").count() <= occ.where("element_id is null").count()


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
