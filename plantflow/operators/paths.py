"""Paths over triples: regular expressions of predicates, with direction, as joins.

A path is built from `step(predicate)`, `back(predicate)` (against the edge), `seq`, `either`,
`some` (one or more), `any_of` (none or more) and `maybe`. It becomes a small automaton whose
states are pairs of what may follow and whether the path may end; states that agree in
both are one. Edges and automaton are joined into a product graph, and what a path reaches is what that
graph reaches: from given starts by a frontier that meets only nodes not seen before, between
all nodes by doubling.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantflow.operators.graph import closure
from plantflow.session import cut


@dataclass(frozen=True)
class Path:
    op: str
    args: tuple = ()


def step(predicate: str) -> Path:
    return Path("step", (predicate,))


def back(predicate: str) -> Path:
    return Path("step", ("^" + predicate,))


def seq(*paths: Path) -> Path:
    return Path("seq", paths)


def either(*paths: Path) -> Path:
    return Path("either", paths)


def some(path: Path) -> Path:
    return Path("some", (path,))


def any_of(path: Path) -> Path:
    return Path("maybe", (some(path),))


def maybe(path: Path) -> Path:
    return Path("maybe", (path,))


@dataclass(frozen=True)
class Automaton:
    """moves: {(state, label, next)}; state 0 is the start; ends: states in which the path may end."""

    moves: frozenset
    ends: frozenset


def automaton(path: Path) -> Automaton:
    """States are the steps of the path (by position), merged where nothing tells them apart."""
    labels: list[str] = []
    follow: dict[int, set[int]] = {0: set()}

    def walk(p: Path) -> tuple[set[int], set[int], bool]:
        """(steps it may begin with, may end with, whether it may be empty)."""
        if p.op == "step":
            labels.append(p.args[0])
            follow[len(labels)] = set()
            return {len(labels)}, {len(labels)}, False
        parts = [walk(a) for a in p.args]
        if p.op == "either":
            return set().union(*(x[0] for x in parts)), set().union(*(x[1] for x in parts)), any(x[2] for x in parts)
        first, last, empty = parts[0]
        for begins, ends, may in parts[1:]:
            for i in last:
                follow[i] |= begins
            first, last, empty = first | (begins if empty else set()), ends | (last if may else set()), empty and may
        if p.op == "some" or (p.op == "maybe" and p.args[0].op == "some"):
            for i in last:
                follow[i] |= first
        return first, last, empty or p.op == "maybe"

    first, last, empty = walk(path)
    follow[0] = first
    ends = last | ({0} if empty else set())
    group = {s: int(s in ends) for s in follow}
    while True:  # split states until all of a group move alike
        looks = {s: (group[s], frozenset((labels[t - 1], group[t]) for t in follow[s])) for s in follow}
        names = {look: i for i, look in enumerate(dict.fromkeys(looks[s] for s in sorted(follow)))}
        fresh = {s: names[looks[s]] for s in follow}
        if len(set(fresh.values())) == len(set(group.values())):
            break
        group = fresh
    first_seen = {g: i for i, g in enumerate(dict.fromkeys(fresh[s] for s in sorted(follow)))}
    state = {s: first_seen[fresh[s]] for s in follow}
    return Automaton(frozenset((state[s], labels[t - 1], state[t]) for s in follow for t in follow[s]), frozenset(state[s] for s in ends))


def _product(triples: DataFrame, machine: Automaton) -> DataFrame:
    """(a, state, b, next): edges of triples (s, p, o) that the automaton can take."""
    labels = {label for _, label, _ in machine.moves}
    ahead, behind = sorted(x for x in labels if x[0] != "^"), sorted(x[1:] for x in labels if x[0] == "^")
    used = triples.where(F.col("p").isin([*ahead, *behind]) & F.col("s").isNotNull() & F.col("o").isNotNull())
    moves = used.where(F.col("p").isin(ahead)).select(F.col("s").alias("a"), F.col("p").alias("label"), F.col("o").alias("b"))
    moves = moves.unionByName(used.where(F.col("p").isin(behind)).select(F.col("o").alias("a"), F.concat(F.lit("^"), "p").alias("label"), F.col("s").alias("b")))
    table = triples.sparkSession.createDataFrame(sorted(machine.moves), "state int, label string, next int")  # a few rows, by the path's length
    return moves.join(F.broadcast(table), "label").select("a", "state", "b", "next").distinct()


def reach(triples: DataFrame, path: Path, starts: DataFrame | None = None) -> DataFrame:
    """(start, end): what `path` leads to from each of `starts` (start), or from every node.

    Rounds are the longest way from a start, each over the newly found only; without starts
    they grow with its logarithm. Cycles are no problem. A path that may be empty leads from each start to itself.
    """
    machine = automaton(path)
    edges = cut(_product(triples, machine))
    if starts is None:
        ends = [s for s in machine.ends]
        nodes = edges.select(F.struct(F.col("a").alias("n"), F.col("state").alias("q")).alias("child"), F.struct(F.col("b").alias("n"), F.col("next").alias("q")).alias("parent"))
        walks = closure(nodes, reflexive=False).where((F.col("node.q") == 0) & F.col("ancestor.q").isin(ends))
        found = walks.select(F.col("node.n").alias("start"), F.col("ancestor.n").alias("end"))
        if 0 in machine.ends:
            every = triples.select(F.col("s").alias("start")).unionByName(triples.select(F.col("o").alias("start"))).where("start is not null")
            found = found.unionByName(every.select("start", F.col("start").alias("end")))
        return found.distinct()
    frontier = cut(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("state")).where("start is not null").distinct())
    seen, going = frontier, sorted({state for state, _, _ in machine.moves})
    while not frontier.isEmpty():
        ahead = frontier.select("start", F.col("node").alias("a"), "state").join(edges, ["a", "state"])
        ahead = ahead.select("start", F.col("b").alias("node"), F.col("next").alias("state")).distinct()
        fresh = cut(ahead.join(seen, ["start", "node", "state"], "left_anti"))
        seen = seen.unionByName(fresh)
        frontier = fresh.where(F.col("state").isin(going))  # a path that has ended needs no round more
    return seen.where(F.col("state").isin(list(machine.ends))).select("start", F.col("node").alias("end")).distinct()


#: How a site reaches its members: parts and points along the edge, feeds against it.
MEMBER = some(either(step("hasPart"), back("feeds"), step("hasPoint")))


def site_of(triples: DataFrame, sites: DataFrame) -> DataFrame:
    """(node, site): each member's site; of several the smallest."""
    members = reach(triples, MEMBER, sites.select(F.col("site").alias("start")))
    return members.groupBy(F.col("end").alias("node")).agg(F.min("start").alias("site"))


def navigation(triples: DataFrame, sites: DataFrame, equips: DataFrame) -> DataFrame:
    """(level, parent, child): sites at the root and beside them equipment that no site reaches; equipment below sites; points below equipment."""
    members = cut(reach(triples, MEMBER, sites.select(F.col("site").alias("start"))))
    inside = members.join(equips.select(F.col("equip").alias("end")).distinct(), "end")
    lost = equips.select("equip").distinct().join(inside.select(F.col("end").alias("equip")), "equip", "left_anti")
    points = reach(triples, either(step("hasPoint"), back("isPointOf")), equips.select(F.col("equip").alias("start")).distinct())
    none = F.lit(None).cast("string")
    return (
        sites.select(F.lit("root").alias("level"), none.alias("parent"), F.col("site").alias("child")).distinct()
        .unionByName(lost.select(F.lit("root").alias("level"), none.alias("parent"), F.col("equip").alias("child")))
        .unionByName(inside.select(F.lit("site").alias("level"), F.col("start").alias("parent"), F.col("end").alias("child")))
        .unionByName(points.select(F.lit("equip").alias("level"), F.col("start").alias("parent"), F.col("end").alias("child")))
    )


def tree_check(edges: DataFrame) -> DataFrame:
    """(node, root, depth, cyclic) of a tree given as (child, parent), by doubling pointers.

    A node on a cycle or below one has neither root nor depth. Of several parents of a child the
    smallest counts. A pointer that hasn't come to a root after as many doublings as cover all nodes never will.
    """
    one = edges.where("child is not null and parent is not null").groupBy("child").agg(F.min("parent").alias("parent"))
    ends = one.select(F.col("parent").alias("node")).distinct().join(one.select(F.col("child").alias("node")), "node", "left_anti")
    state = one.select(F.col("child").alias("node"), F.col("parent").alias("at"), F.lit(1).cast("long").alias("depth"))
    state = cut(state.unionByName(ends.select("node", F.col("node").alias("at"), F.lit(0).cast("long").alias("depth"))))
    for _ in range(math.ceil(math.log2(max(2, state.count()))) + 1):
        on = state.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        state = cut(state.join(on, "at").select("node", F.col("next").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("next") != F.col("at")).alias("moved")))
        if state.where("moved").isEmpty():
            break
        state = state.drop("moved")
    out = state.select("node", "at", "depth").join(ends.select(F.col("node").alias("at"), F.lit(True).alias("rooted")), "at", "left")
    ok = F.coalesce("rooted", F.lit(False))
    return out.select("node", F.when(ok, F.col("at")).alias("root"), F.when(ok, F.col("depth")).alias("depth"), (~ok).alias("cyclic"))


def tree_fold(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(node, total, n, low, high): sum, count, smallest and largest of the values (node, value) of each node and all below it.

    Pointers and partial folds double together: what a node knows of the levels down to 2**k, its
    ancestor 2**k above takes over for the levels beyond its own. So there are as many rounds as the logarithm of the
    depth, each over one row a node; no row per pair of node and ancestor is made. Nodes on a cycle or below one are left out.
    """
    shape = tree_check(edges).where("not cyclic")
    one = edges.where("child is not null and parent is not null").groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("up"))
    own = values.where("node is not null").groupBy("node").agg(F.sum("value").alias("total"), F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    inside = shape.select("node").join(one, "node", "left").join(own, "node", "left")
    alone = own.join(one.select("node").unionByName(one.select(F.col("up").alias("node"))), "node", "left_anti")
    state = cut(inside.withColumn("n", F.coalesce("n", F.lit(0))))
    while not state.where("up is not null").isEmpty():
        sent = state.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("total").alias("t"), F.sum("n").alias("m"), F.min("low").alias("l"), F.max("high").alias("h"))
        beyond = state.where("up is not null").select(F.col("node").alias("up"), F.col("up").alias("next"))
        both = state.join(sent, "node", "left").join(beyond, "up", "left")
        total = F.when(F.col("t").isNull(), F.col("total")).otherwise(F.col("t") + F.coalesce("total", F.lit(0)))
        state = cut(both.select("node", F.col("next").alias("up"), total.alias("total"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), F.least("low", "l").alias("low"), F.greatest("high", "h").alias("high")))
    return state.drop("up").unionByName(alone)
