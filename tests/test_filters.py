"""Filters: what reaches the file scan, words, units, zones, hops and merges on small cases."""

import itertools

from plantflow.operators import graph
from plantflow.operators.graph import Tag

SCHEMA = "s string, p string, o_kind string, o string, num double, unit string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], SCHEMA)


def found(tag, rows):
    got = [r.s for r in tag.match(rows).collect()]
    assert len(got) == len(set(got))
    return set(got)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_leaves_reach_the_scan(spark, tmp_path):
    rows = frame(spark, [("a", "x", "marker"), ("a", "y", "marker"), ("b", "y", "marker"), ("c", "z", "num", None, 3.0)])
    rows.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    either = (Tag.has("x") | Tag.number("z", ">", 1)).match(stored)
    assert "PushedFilters: [Or(" in plan(either) and "bool_or" not in plan(either) and {r.s for r in either.collect()} == {"a", "c"}
    both = (Tag.has("y") & ~Tag.has("x")).match(stored)
    assert "PushedFilters: [Or(" in plan(both) and {r.s for r in both.collect()} == {"b"}
    none = (~Tag.has("x")).match(stored)
    assert "PushedFilters: []" in plan(none) and {r.s for r in none.collect()} == {"b", "c"}


def test_every_combination_matches_truth_table(spark):
    sets = [{n for n in range(3) if bits >> n & 1} for bits in range(8)]
    rows = [(f"s{i}", "abc"[n], "marker") for i, has in enumerate(sets) for n in has] + [(f"s{i}", "other", "marker") for i in range(8)]
    a, b, c = (Tag.has(x) for x in "abc")
    cases = {
        "a | b | c": (a | b | c, lambda x, y, z: x or y or z), "a & ~b": (a & ~b, lambda x, y, z: x and not y), "~a | b": (~a | b, lambda x, y, z: not x or y),
        "~(a & b) & c": (~(a & b) & c, lambda x, y, z: not (x and y) and z), "~~a": (~~a, lambda x, y, z: x), "a | ~(b | c)": (a | ~(b | c), lambda x, y, z: x or not (y or z)),
    }
    data = frame(spark, rows)
    for name, (tag, truth) in cases.items():
        want = {f"s{i}" for i, has in enumerate(sets) if truth(*(n in has for n in range(3)))}
        assert found(tag, data) == want, name
    assert len(list(itertools.chain(*sets))) == 12


def test_words(spark):
    family = graph.class_family(spark.createDataFrame([("Rooftop", "AHU", "subclass"), ("Fan", "Thing", "subclass")], "child string, parent string, kind string"))
    known = graph.facts(
        frame(spark, [("r", "a", "ref", "Rooftop"), ("f", "a", "ref", "Fan"), ("t", "hot", "marker"), ("u", "hot", "num", None, 1.0)]), family,
        spark.createDataFrame([("ahu", "hot")], "class string, word string"), spark.createDataFrame([("Thing", ["blow", "spin"])], "class string, words array<string>"),
        spark.createDataFrame([("r", "hasPoint", "q")], "a string, edge string, b string"),
    )
    assert found(Tag.word("hot"), known) == {"r", "t", "u"}
    assert found(Tag.word("spin"), known) == {"f"}
    assert found(Tag.word("AHU"), known) == {"r"} and found(Tag.word("point"), known) == {"q"} and found(Tag.word("equipRef"), known) == {"q"}


def test_units_and_zones(spark):
    data = frame(spark, [
        ("own", "t", "num", None, 75.0, "°F"), ("own", "unit", "str", "°C"), ("entity", "t", "num", None, 75.0), ("entity", "unit", "str", "°F"),
        ("none", "t", "num", None, 75.0), ("other", "t", "num", None, 75.0, "°C"), ("other", "unit", "str", "°F"), ("low", "t", "num", None, 5.0, "°F"),
        ("z", "at", "datetime", None, 10.0, "UTC"), ("r", "at", "datetime", None, 10.0, "Rome"), ("n", "at", "datetime", None, 10.0), ("x", "at", "str", "10")])
    assert found(Tag.measure("t", ">", 70, "°F"), data) == {"own", "entity"}
    assert found(Tag.number("t", ">", 70), data) == {"entity", "none"}
    assert found(Tag.instant("at", "==", 10.0, "UTC"), data) == {"z", "n"}
    assert found(Tag.instant("at", "==", 10.0), data) == found(Tag.instant("at", ">=", 10.0, "UTC"), data) == {"z", "r", "n"}


def test_hops_take_edges_first(spark):
    triples = frame(spark, [("p1", "equipRef", "ref", "urn:equip:a"), ("p2", "equipRef", "str", "b"), ("p3", "equipRef", "str", "not an id!"), ("p4", "equipRef", "ref", "urn:equip:a"), ("urn:equip:a", "ahu", "marker"), ("urn:equip:haystack:b", "ahu", "marker")])
    edges = spark.createDataFrame([("p4", "isPointOf", "urn:equip:c"), ("site", "hasPart", "urn:equip:a")], "s string, p string, o string")
    assert {tuple(r) for r in graph.hop(triples, edges, "equipRef").collect()} == {("p1", "urn:equip:a"), ("p2", "urn:equip:haystack:b"), ("p4", "urn:equip:c")}
    assert {r.s for r in graph.follow(triples, edges, ("equipRef",), Tag.has("ahu")).collect()} == {"p1", "p2"}
    sites = spark.createDataFrame([("site",)], "site string")
    assert {tuple(r) for r in graph.hop(triples, edges, "siteRef", sites).collect()} == {("urn:equip:a", "site")}


def test_merge_rewrites_and_mirrors(spark):
    triples = spark.createDataFrame([("b", "feeds", "x"), ("c", "feeds", "x"), ("c", "hasPoint", "p"), ("a", "feeds", "b"), ("x", "dis", "x"), ("c", "dis", "AHU")], "s string, p string, o string")
    same = spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string")
    inverse = spark.createDataFrame([("feeds", "isFedBy"), ("hasPoint", "isPointOf")], "p string, q string")
    got = {tuple(r) for r in graph.merge(triples, same, inverse).collect()}
    assert got == {("a", "feeds", "x"), ("x", "isFedBy", "a"), ("a", "hasPoint", "p"), ("p", "isPointOf", "a"), ("x", "dis", "x"), ("a", "dis", "AHU")}
