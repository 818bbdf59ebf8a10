"""Graph operators over edge tables: closures, containment, classes, tag filters, tree rollups.

Walks run until nothing new is found; what was found is a table, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantflow.operators.components import components
from plantflow.session import cut


def closure(edges: DataFrame, max_depth: int | None = None, reflexive: bool = True) -> DataFrame:
    """(node, ancestor, depth): smallest number of steps from each node to each ancestor.

    Each round doubles the length of the walks that are known: only pairs exactly as far apart as
    the longest known walk are joined with the known walks, since every longer shortest walk begins with such
    a pair. Each result is met about once, the rounds grow with the logarithm of the longest
    way, and there is no cap unless `max_depth` names one. Works on cyclic graphs: a node on a cycle is its own ancestor.
    """
    known = cut(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct())
    edge, length = known, 1
    while not edge.isEmpty() and (max_depth is None or length < max_depth):
        on = known.select(F.col("node").alias("middle"), "ancestor", "depth")
        longer = edge.select("node", F.col("ancestor").alias("middle")).join(on, "middle")
        longer = longer.groupBy("node", "ancestor").agg((F.min("depth") + length).alias("depth"))
        if max_depth is not None:
            longer = longer.where(F.col("depth") <= max_depth)
        fresh = cut(longer.join(known, ["node", "ancestor"], "left_anti"))
        length *= 2
        known, edge = known.unionByName(fresh), fresh.where(F.col("depth") == length)
    walks = known
    if reflexive:
        nodes = edges.select(F.col("child").alias("node")).unionByName(edges.select(F.col("parent").alias("node"))).distinct()
        walks = walks.unionByName(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")))
        walks = walks.groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))
    return walks


def undirected(edges: DataFrame, kinds: tuple[str, ...] = ("equivalent", "alias", "replaced_by")) -> DataFrame:
    """Class edges with equivalences read in both directions."""
    both = edges.where(F.col("kind").isin(*kinds)).select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    return edges.select("child", "parent").unionByName(both).distinct()


def effective_tags(up: DataFrame, class_tags: DataFrame) -> DataFrame:
    """Tags of each class with those of its ancestors; `up` is a closure."""
    return up.join(class_tags, up["ancestor"] == class_tags["class"]).select(F.col("node").alias("class"), "tag").distinct()


def tree_rollup(up: DataFrame, leaves: DataFrame, fold: str = "sum") -> DataFrame:
    """Associative fold of leaf values (node, value) at every ancestor."""
    agg = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[fold]
    return up.join(leaves, "node").groupBy("ancestor").agg(agg("value").alias("value"))


def tree_rollup_by_level(edges: DataFrame, leaves: DataFrame, fold) -> DataFrame:
    """Children before parents: `fold` makes a node's value from its own values and its children's computed ones.

    `fold` takes a Column and returns an aggregate of it, so children are combined in the map
    tasks and a node with very many of them is no problem. There is one round per level of the
    tree, however deep; nodes on a cycle, and those above them, have no value.
    """
    pending = cut(edges.select("child", "parent").distinct())
    nodes = pending.select(F.col("child").alias("node")).unionByName(pending.select(F.col("parent").alias("node"))).unionByName(leaves.select("node")).distinct()
    ready = cut(nodes.join(pending.select(F.col("parent").alias("node")), "node", "left_anti"))
    done = None
    while not ready.isEmpty():
        own = leaves.join(ready, "node", "left_semi").select("node", "value")
        if done is not None:
            below = edges.join(ready, edges["parent"] == ready["node"], "left_semi").join(done.withColumnRenamed("node", "child"), "child")
            own = own.unionByName(below.select(F.col("parent").alias("node"), "value"))
        value = cut(own.where("value is not null").groupBy("node").agg(fold(F.col("value")).alias("value")))
        done = value if done is None else done.unionByName(value)
        reached = pending.join(ready.withColumnRenamed("node", "child"), "child", "left_semi").select(F.col("parent").alias("node")).distinct()
        pending = cut(pending.join(ready.withColumnRenamed("node", "child"), "child", "left_anti"))
        ready = cut(reached.join(pending.select(F.col("parent").alias("node")), "node", "left_anti"))
    return done if done is not None else leaves.limit(0)


def chain(edges: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """(start, node, level): upstream nodes of each start with their smallest level."""
    walks = closure(edges, max_depth, reflexive=False)
    return start.join(walks, start["node"] == walks["node"]).select(start["node"].alias("start"), F.col("ancestor").alias("node"), F.col("depth").alias("level"))


def class_family(edges: DataFrame) -> DataFrame:
    """(class, ancestor), both in lower case: every class with those it counts as, itself included.

    `edges` are (child, parent, kind); equivalences, aliases and replacements hold both ways.
    """
    low = edges.select(F.lower("child").alias("child"), F.lower("parent").alias("parent"), "kind")
    return closure(undirected(low)).select(F.col("node").alias("class"), "ancestor").distinct()


def classified(triples: DataFrame, family: DataFrame) -> DataFrame:
    """Triples with a row (s, 'is', class) for each class that the type of a subject counts as, in lower case."""
    types = triples.where("p = 'a'").select("s", F.lower("o").alias("class"))
    known = types.join(family, "class", "left").select("s", F.coalesce("ancestor", "class").alias("o")).distinct()
    shaped = known.select("s", F.lit("is").alias("p"), F.lit("class").alias("o_kind"), "o", F.lit(None).cast("double").alias("num"), F.lit(None).cast("string").alias("unit"))
    return triples.unionByName(shaped)


def facts(triples: DataFrame, family: DataFrame, class_words: DataFrame, rules: DataFrame, links: DataFrame) -> DataFrame:
    """Triples with all that a bare word may mean: classes, words of classes, words that mapping rules turn into classes, structural markers.

    `family` is (class, ancestor) in lower case, `class_words` (class, word), `rules` (class, words) of which any word finds the
    class and what lies below it, `links` edges (a, edge, b).
    """
    typed = classified(triples, family)
    given = class_words.select(F.lower("class").alias("o"), "word").unionByName(rules.select(F.lower("class").alias("o"), F.explode("words").alias("word"))).distinct()
    words = typed.where("p = 'is'").select("s", "o").join(given, "o").select("s", F.col("word").alias("o")).distinct()
    none = F.lit(None)
    shaped = words.select("s", F.lit("word").alias("p"), F.lit("word").alias("o_kind"), "o", none.cast("double").alias("num"), none.cast("string").alias("unit"))
    return typed.unionByName(shaped).unionByName(structural(links))


# Fixed value: what a reference's text looks like.
REFERENCE = r"^[A-Za-z0-9_:.~/-]+$"


def hop(triples: DataFrame, edges: DataFrame, name: str, sites: DataFrame | None = None) -> DataFrame:
    """(a, b): where the reference tag `name` leads, over all its forms.

    A value like an id is followed, as it is where it begins with urn: and else below urn:equip:haystack:. For equipRef the
    edge isPointOf (s, p, o) goes before any value; for siteRef the sites (site) that contain the subject count too.
    """
    from plantflow.operators import paths

    value = triples.where((F.col("p") == name) & F.col("o").rlike(REFERENCE))
    found = value.select(F.col("s").alias("a"), F.when(F.col("o").startswith("urn:"), F.col("o")).otherwise(F.concat(F.lit("urn:equip:haystack:"), "o")).alias("b"))
    if name == "equipRef":
        linked = edges.where("p = 'isPointOf'").select(F.col("s").alias("a"), F.col("o").alias("b"))
        found = found.join(linked.select("a"), "a", "left_anti").unionByName(linked)
    if name == "siteRef" and sites is not None:
        inside = paths.reach(edges, paths.MEMBER, sites.select(F.col("site").alias("start")))
        found = found.unionByName(inside.select(F.col("end").alias("a"), F.col("start").alias("b")))
    return found.distinct()


def follow(triples: DataFrame, edges: DataFrame, names: tuple[str, ...], leaf: Tag, sites: DataFrame | None = None) -> DataFrame:
    """Subjects (s) whose path of reference tags leads to one that `leaf` matches; walked back from the end, so each hop keeps only what leads there."""
    ends = leaf.match(triples).select(F.col("s").alias("b"))
    for name in reversed(names):
        ends = hop(triples, edges, name, sites).join(ends, "b", "left_semi").select(F.col("a").alias("b")).distinct()
    return ends.select(F.col("b").alias("s"))


def merge(triples: DataFrame, same: DataFrame, inverse: DataFrame) -> DataFrame:
    """Triples (s, p, o) with subjects that are the same (a, b) made one, the smallest of them, and every edge in both directions.

    Both ends of all triples are rewritten to the canonical node; what that makes equal is one triple, and an edge
    from a node to itself by merging goes. `inverse` (p, q) names the predicates of edges and their opposites.
    """
    roots = cut(components(same))
    for end in ("s", "o"):
        named = roots.select(F.col("node").alias(end), F.col("root").alias("to"))
        triples = triples.join(named, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    both = inverse.unionByName(inverse.select(F.col("q").alias("p"), F.col("p").alias("q"))).distinct()
    edges = triples.join(both, "p")
    back = edges.select(F.col("o").alias("s"), F.col("q").alias("p"), F.col("s").alias("o"))
    out = triples.select("s", "p", "o").unionByName(back).distinct()
    loops = out.where(F.col("s") == F.col("o")).join(both.select("p").distinct(), "p", "left_semi")
    return out.join(loops.select("s", "p", "o"), ["s", "p", "o"], "left_anti")


def roster(triples: DataFrame, family: DataFrame, name: str) -> DataFrame:
    """Subjects of a class or of one that counts as it."""
    return Tag.of_class(name).match(classified(triples, family))


def structural(links: DataFrame) -> DataFrame:
    """Triples that edges (a, edge, b) imply: point, equip and site markers with equipRef and siteRef references."""
    rows = F.explode(
        F.when(F.col("edge") == "hasPoint", F.array(*(F.struct(*x) for x in _implied("equip", "point", "equipRef"))))
        .when(F.col("edge") == "hasEquip", F.array(*(F.struct(*x) for x in _implied("site", "equip", "siteRef"))))
    )
    return links.select(rows.alias("t")).select("t.*").distinct()


def _implied(upper: str, lower: str, ref: str) -> list[list[Column]]:
    none, number = F.lit(None).cast("string"), F.lit(None).cast("double").alias("num")
    row = lambda s, p, kind, o: [F.col(s).alias("s"), F.lit(p).alias("p"), F.lit(kind).alias("o_kind"), o.alias("o"), number, none.alias("unit")]
    return [row("a", upper, "marker", none), row("b", lower, "marker", none), row("b", ref, "ref", F.col("a"))]


def preferred(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, preferred): the preferred class of an alias (alias, class), others as they are."""
    return names.join(aliases.select(F.col("alias").alias("name"), "class"), "name", "left").select("name", F.coalesce("class", "name").alias("preferred"))


def records_only(subjects: DataFrame, vocabulary: DataFrame, nested: str = "urn:dict:") -> DataFrame:
    """Subjects (s) that are records: neither nodes of the vocabulary (s) nor nested dictionaries."""
    return subjects.where(~F.col("s").startswith(nested)).join(vocabulary.select("s"), "s", "left_anti")


def near_misses(word: str, known: DataFrame, least: float = 0.75, n: int = 3) -> DataFrame:
    """Known names (name) most like a word that matched nothing: one less the edit distance over the longer length."""
    a, b = F.lit(word.lower()), F.lower("name")
    alike = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    return known.select("name", alike.alias("alike")).where(F.col("alike") >= least).orderBy(F.desc("alike"), "name").limit(n)


def neighbours(pairs: DataFrame) -> DataFrame:
    """Both directions of pairs that are stored once."""
    return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def orphans(points: DataFrame, owned: DataFrame) -> DataFrame:
    return points.join(owned, "point_uri", "left_anti")


def point_groups(points: DataFrame, min_points: int = 2) -> DataFrame:
    """Unlinked points grouped by the path above them."""
    parent = F.regexp_replace("point_uri", r"/[^/]*$", "")
    return points.groupBy(parent.alias("parent")).agg(F.count("*").alias("n")).where(F.col("n") >= min_points)


def lacking_path(subjects: DataFrame, refs: DataFrame, ends: DataFrame) -> DataFrame:
    """Subjects (s) whose reference (s, o) leads nowhere or to a node that isn't among `ends` (s)."""
    good = refs.join(ends.select(F.col("s").alias("o")), "o", "left_semi").select("s")
    bad = refs.join(ends.select(F.col("s").alias("o")), "o", "left_anti").select("s")
    return subjects.join(good, "s", "left_anti").unionByName(bad.join(subjects, "s", "left_semi")).distinct()


def expand_points(matched: DataFrame, same: DataFrame, has_point: DataFrame) -> DataFrame:
    """Points of matched equipment (s), through everything that is the same (a, b), and points matched themselves."""
    found = components(same)
    mine = matched.join(found.select(F.col("node").alias("s"), "root"), "s").select("root").distinct()
    group = found.join(mine, "root", "left_semi").select(F.col("node").alias("equip"))
    equips = matched.select(F.col("s").alias("equip")).unionByName(group).distinct()
    points = has_point.join(equips, "equip", "left_semi").select(F.col("point").alias("s"))
    return points.unionByName(matched.where(F.col("s").startswith("urn:point:"))).distinct()


def apply_messages(triples: DataFrame, messages: DataFrame) -> DataFrame:
    """Triples (s, p, o) after tag messages (seq, s, p, o): the last message of a tag wins, null removes it."""
    last = messages.groupBy("s", "p").agg(F.max_by(F.struct("o"), "seq").alias("m")).select("s", "p", "m.o")
    kept = triples.join(last.select("s", "p"), ["s", "p"], "left_anti")
    return kept.unionByName(last.where("o is not null"))


class Tag:
    """Filters over tag triples. A missing tag makes every comparison false, and `~` is the complement over all subjects.

    Each leaf is evaluated once as a set of subjects; the tree combines flags.
    """

    def __init__(self, test, parts: tuple = ()):
        self.test, self.parts = test, parts

    @staticmethod
    def has(tag: str) -> Tag:
        return Tag(lambda t: F.col("p") == tag)

    @staticmethod
    def word(name: str) -> Tag:
        """A bare word over triples that went through `facts`: a tag with or without value, a class, a word of a class, or a structural marker."""
        return Tag(lambda t: (F.col("p") == name) | ((F.col("p") == "is") & (F.col("o") == name.lower())) | ((F.col("p") == "word") & (F.col("o") == name)))

    @staticmethod
    def measure(tag: str, op: str, value: float, unit: str) -> Tag:
        """A number in `unit`: the tag's own, or the subject's (its tag `unit`) where the tag has none."""
        bare = Tag.number(tag, op, value, None)
        return Tag.number(tag, op, value, unit) | (bare & Tag.text("unit", unit))

    @staticmethod
    def instant(tag: str, op: str, epoch_s: float, zone: str | None = None) -> Tag:
        """A time by its instant (kind datetime: `num` in seconds, `unit` the stored zone); == also wants the zone where one is stored."""
        compare = {"==": "__eq__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}[op]
        same = F.col("unit").isNull() | (F.col("unit") == zone) if op == "==" and zone else F.lit(True)
        return Tag(lambda t: (F.col("p") == tag) & (F.col("o_kind") == "datetime") & getattr(F.col("num"), compare)(epoch_s) & same)

    @staticmethod
    def number(tag: str, op: str, value: float, unit: str | None = None) -> Tag:
        """Comparison of numbers with the identical unit; nothing is converted."""
        compare = {"==": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}[op]
        same = F.col("unit").eqNullSafe(F.lit(unit))
        if op == "!=":
            return Tag(lambda t: (F.col("p") == tag) & ~F.coalesce((F.col("o_kind") == "num") & same & (F.col("num") == value), F.lit(False)))
        return Tag(lambda t: (F.col("p") == tag) & (F.col("o_kind") == "num") & same & getattr(F.col("num"), compare)(value))

    @staticmethod
    def text(tag: str, value: str) -> Tag:
        return Tag(lambda t: (F.col("p") == tag) & (F.col("o_kind") == "str") & (F.col("o") == value))

    @staticmethod
    def date(tag: str, op: str, value: str) -> Tag:
        """Comparison of dates or times written as ISO text, in their own order; other text never matches."""
        compare = {"==": "__eq__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}[op]
        iso = F.col("o").rlike(r"^\d{4}-\d{2}-\d{2}")
        return Tag(lambda t: (F.col("p") == tag) & iso & getattr(F.col("o"), compare)(value))

    @staticmethod
    def ref(tag: str, value: str) -> Tag:
        return Tag(lambda t: (F.col("p") == tag) & (F.col("o_kind") == "ref") & (F.col("o") == value))

    @staticmethod
    def of_class(name: str) -> Tag:
        """Subjects of a class, whatever its case, over triples that went through `classified`."""
        return Tag(lambda t: (F.col("p") == "is") & (F.col("o") == name.lower()))

    @staticmethod
    def every(markers: list[str]) -> Tag:
        """All of the markers: a spec with its required ones, or a symbol such as ^hot-water as its parts."""
        out = Tag.has(markers[0])
        for marker in markers[1:]:
            out = out & Tag.has(marker)
        return out

    @staticmethod
    def symbol(name: str) -> Tag:
        return Tag.every(name.lstrip("^").split("-"))

    @staticmethod
    def flag(tag: str, value: bool) -> Tag:
        """A boolean tag; text that reads like one never matches."""
        return Tag(lambda t: (F.col("p") == tag) & (F.col("o_kind") == "bool") & (F.col("o") == str(value).lower()))

    @staticmethod
    def uri(tag: str, value: str) -> Tag:
        return Tag(lambda t: (F.col("p") == tag) & (F.col("o_kind") == "uri") & (F.col("o") == value))

    def __and__(self, other: Tag) -> Tag:
        return Tag("and", (self, other))

    def __or__(self, other: Tag) -> Tag:
        return Tag("or", (self, other))

    def __invert__(self) -> Tag:
        return Tag("not", (self,))

    def _leaves(self) -> list[Tag]:
        return [self] if callable(self.test) else [leaf for part in self.parts for leaf in part._leaves()]

    def _flag(self, names: dict) -> Column:
        if callable(self.test):
            return F.col(names[id(self)])
        flags = [p._flag(names) for p in self.parts]
        return ~flags[0] if self.test == "not" else flags[0] & flags[1] if self.test == "and" else flags[0] | flags[1]

    def _holds(self, leaf: bool) -> bool:
        """What the filter says where every leaf is `leaf`."""
        if callable(self.test):
            return leaf
        parts = [p._holds(leaf) for p in self.parts]
        return not parts[0] if self.test == "not" else all(parts) if self.test == "and" else any(parts)

    def _only(self, op: str) -> bool:
        return callable(self.test) or (self.test == op and all(p._only(op) for p in self.parts))

    def match(self, triples: DataFrame) -> DataFrame:
        """Subjects that satisfy the filter.

        Where a subject without any fact can't match, only triples that some leaf is about are read: the leaves,
        joined by or, reach the file scan. A filter of nothing but `or` then needs no flags; others take one
        aggregate over the triples for all leaves. A filter that holds for subjects without facts (a negation) reads all.
        """
        leaves = self._leaves()
        if not self._holds(False):
            about = leaves[0].test(None)
            for leaf in leaves[1:]:
                about = about | leaf.test(None)
            triples = triples.where(about)
            if self._only("or"):
                return triples.select("s").distinct()
        names = {id(leaf): f"f{i}" for i, leaf in enumerate(leaves)}
        flags = [F.bool_or(F.coalesce(leaf.test(None), F.lit(False))).alias(names[id(leaf)]) for leaf in leaves]
        return triples.groupBy("s").agg(*flags).where(self._flag(names)).select("s")


def nested_inventory(equips: DataFrame, points: DataFrame) -> DataFrame:
    """(equip, dis, classes, tags, points) of every piece of equipment: its facts folded, its points nested in order of their ids.

    `equips` is (equip, field, value) with the fields dis, class and tag; `points` (equip, point, class, tags).
    """
    of = lambda field: F.when(F.col("field") == field, F.col("value"))
    own = equips.groupBy("equip").agg(F.min(of("dis")).alias("dis"), F.array_sort(F.collect_set(of("class"))).alias("classes"), F.array_sort(F.collect_set(of("tag"))).alias("tags"))
    below = points.groupBy("equip").agg(F.array_sort(F.collect_set(F.struct("point", "class", F.array_sort("tags").alias("tags")))).alias("points"))
    rows = own.join(below, "equip", "left")
    none = F.array().cast(dict(below.dtypes)["points"])
    return rows.select("equip", F.coalesce("dis", F.replace(F.col("equip"), F.lit("urn:equip:"), F.lit(""))).alias("dis"), "classes", "tags", F.coalesce("points", none).alias("points"))


def described(points: DataFrame, facts: DataFrame, classes: DataFrame) -> DataFrame:
    """(point, dis, unit, kind, class, equip) of `points` (point).

    `facts` is (point, field, value) with the fields dis, unit, kind and equip; of several the smallest counts.
    `classes` is (point, class, source): a class of the brick source goes before one of an extension, that before a
    project's. Without a dis the last part of the point's name stands in.
    """
    fields = {f: F.min(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in ("dis", "unit", "kind", "equip")}
    known = facts.groupBy("point").agg(*fields.values())
    place = F.when(F.col("source") == "brick", 0).when(F.col("source") == "extension", 1).otherwise(2)
    named = classes.groupBy("point").agg(F.min_by("class", F.struct(place, "class")).alias("class"))
    rows = points.select("point").distinct().join(known, "point", "left").join(named, "point", "left")
    tail = F.regexp_extract("point", "([^/:]*)$", 1)
    return rows.select("point", F.coalesce("dis", tail).alias("dis"), "unit", "kind", "class", "equip")
