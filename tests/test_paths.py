"""Paths against a plain search, on cyclic and deep graphs."""

import random

import pytest
from pyspark.sql import functions as F

from plantflow.operators import graph, paths
from plantflow.operators.paths import any_of, back, either, maybe, seq, some, step


def brute(triples, path, start):
    """Ends of `path` from `start`, by the meaning of each operator."""
    if path.op == "step":
        name = path.args[0]
        return {o for s, p, o in triples if p == name and s == start} | {s for s, p, o in triples if "^" + p == name and o == start}
    if path.op == "either":
        return set().union(*(brute(triples, p, start) for p in path.args))
    if path.op == "maybe":
        return {start} | brute(triples, path.args[0], start)
    if path.op == "seq":
        at = {start}
        for p in path.args:
            at = set().union(*(brute(triples, p, x) for x in at)) if at else set()
        return at
    found, at = set(), {start}
    while at:
        at = set().union(*(brute(triples, path.args[0], x) for x in at)) - found
        found |= at
    return found


PATHS = {
    "member": paths.MEMBER,
    "sequence": seq(step("a"), back("b"), step("a")),
    "closure in a sequence": seq(some(step("a")), any_of(back("b")), maybe(step("c"))),
    "nested": some(seq(either(step("a"), back("c")), any_of(step("b")))),
    "may be empty": any_of(either(step("a"), back("a"))),
    "some of maybe": some(maybe(seq(step("a"), step("b")))),
}


@pytest.mark.parametrize("name", PATHS)
def test_reach_matches_search(spark, name):
    r = random.Random(len(name))
    nodes = [f"n{i}" for i in range(14)]
    triples = {(r.choice(nodes), r.choice(("a", "b", "c", "hasPart", "feeds", "hasPoint")), r.choice(nodes)) for _ in range(60)}
    frame = spark.createDataFrame(sorted(triples) + [(None, "a", "n1"), ("n1", "a", None), ("n1", "a", "n1")], "s string, p string, o string")
    triples.add(("n1", "a", "n1"))
    starts = nodes[:5]
    want = {(s, e) for s in starts for e in brute(triples, PATHS[name], s)}
    got = paths.reach(frame, PATHS[name], spark.createDataFrame([(s,) for s in [*starts, starts[0]]], "start string")).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    everywhere = {tuple(x) for x in paths.reach(frame, PATHS[name]).collect()}
    known = {x for s, _, o in triples for x in (s, o)}
    assert everywhere == {(s, e) for s in known for e in brute(triples, PATHS[name], s)}


def test_states_that_agree_are_one():
    member = paths.automaton(paths.MEMBER)
    assert {s for s, _, _ in member.moves} == {0, 1} and member.ends == {1}


def test_chain_of_a_thousand(spark):
    edges = spark.range(1000).select(F.col("id").alias("child"), (F.col("id") + 1).alias("parent"))
    n, far, total = graph.closure(edges, reflexive=False).agg(F.count("*"), F.max("depth"), F.sum("depth")).first()
    assert (n, far, total) == (500_500, 1000, 1000 * 1001 * 1002 // 6)
    checked = paths.tree_check(edges).collect()
    assert all((x.root, x.depth, x.cyclic) == (1000, 1000 - x.node, False) for x in checked) and len(checked) == 1001


def test_cycles(spark):
    ring = [(i, (i + 1) % 7) for i in range(7)] + [(100, 3), (101, 100), (50, 51)]
    frame = spark.createDataFrame(ring, "child long, parent long")
    depth = {(x.node, x.ancestor): x.depth for x in graph.closure(frame, reflexive=False).collect()}
    assert depth == {(a, b): (b - a - 1) % 7 + 1 for a in range(7) for b in range(7)} | {(100, b): 1 + (b - 3) % 7 for b in range(7)} | {(101, 100): 1} | {(101, b): 2 + (b - 3) % 7 for b in range(7)} | {(50, 51): 1}
    assert {x.node: (x.root, x.cyclic) for x in paths.tree_check(frame).collect()} == {**{i: (None, True) for i in (*range(7), 100, 101)}, 50: (51, False), 51: (51, False)}
    assert graph.closure(frame, max_depth=3, reflexive=False).agg(F.max("depth")).first()[0] == 3


def test_empty(spark):
    none = spark.createDataFrame([], "s string, p string, o string")
    assert paths.reach(none, paths.MEMBER).count() == 0
    assert paths.reach(none, any_of(step("a")), spark.createDataFrame([("x",)], "start string")).collect() == [("x", "x")]
    assert paths.tree_check(spark.createDataFrame([], "child long, parent long")).count() == 0


def test_fold_of_a_deep_tree(spark):
    r = random.Random(9)
    parent = {i: i - 1 if i < 300 else r.randrange(i) for i in range(1, 900)}
    parent |= {2000: 2001, 2001: 2000, 2002: 2000}  # a cycle and a node below it
    values = [(r.randrange(900), float(r.randint(-9, 9))) for _ in range(700)] + [(5000, 3.0), (2002, 1.0), (4, None), (None, 1.0)]
    want = {}
    for node, v in values:
        while node is not None and node < 2000 and v is not None:
            want.setdefault(node, []).append(v)
            node = parent.get(node)
    got = {x.node: tuple(x)[1:] for x in paths.tree_fold(spark.createDataFrame(list(parent.items()), "child long, parent long"), spark.createDataFrame(values, "node long, value double")).collect()}
    assert got.pop(5000) == (3.0, 1, 3.0, 3.0)
    assert {k: v for k, v in got.items() if v[1]} == {k: (sum(v), len(v), min(v), max(v)) for k, v in want.items()}
    assert set(got) == set(range(900))
