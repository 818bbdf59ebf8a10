"""Registered queries: paths over mixed, directed predicates, site membership, navigation, trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantflow.operators import paths
from plantflow.registry import register
from plantflow.session import table


def plant(spark, sf_dir):
    """Triples of a plant: regions have nations as parts, suppliers feed nations or one another, suppliers have parts as points."""
    named = lambda kind, key: F.concat(F.lit(f"urn:{kind}:"), key.cast("string"))
    n, s, li = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    rows = n.where("n_regionkey < 4").select(named("site", F.col("n_regionkey")).alias("s"), F.lit("hasPart").alias("p"), named("floor", F.col("n_nationkey")).alias("o"))
    fed = F.when(F.col("s_suppkey") % 3 == 0, named("floor", F.col("s_nationkey"))).otherwise(named("equip", F.col("s_suppkey") + 1))
    rows = rows.unionByName(s.select(named("equip", F.col("s_suppkey")).alias("s"), F.lit("feeds").alias("p"), fed.alias("o")))
    points = li.select(named("equip", F.col("l_suppkey")).alias("e"), named("point", F.col("l_partkey")).alias("x"), (F.col("l_partkey") % 2 == 0).alias("even")).distinct()
    rows = rows.unionByName(points.where("even").select(F.col("e").alias("s"), F.lit("hasPoint").alias("p"), F.col("x").alias("o")))
    return rows.unionByName(points.where("not even").select(F.col("x").alias("s"), F.lit("isPointOf").alias("p"), F.col("e").alias("o")))


PLANT = """t AS (SELECT 'urn:site:' || n_regionkey AS s, 'hasPart' AS p, 'urn:floor:' || n_nationkey AS o FROM nation WHERE n_regionkey < 4
    UNION ALL SELECT 'urn:equip:' || s_suppkey, 'feeds', CASE WHEN s_suppkey % 3 = 0 THEN 'urn:floor:' || s_nationkey ELSE 'urn:equip:' || (s_suppkey + 1) END FROM supplier
    UNION ALL SELECT DISTINCT 'urn:equip:' || l_suppkey, 'hasPoint', 'urn:point:' || l_partkey FROM lineitem WHERE l_partkey % 2 = 0
    UNION ALL SELECT DISTINCT 'urn:point:' || l_partkey, 'isPointOf', 'urn:equip:' || l_suppkey FROM lineitem WHERE l_partkey % 2 <> 0),
    g AS (SELECT s AS a, o AS b FROM t WHERE p IN ('hasPart', 'hasPoint') UNION SELECT o, s FROM t WHERE p = 'feeds'),
    m AS (SELECT a AS site, b AS node FROM g WHERE a LIKE 'urn:site:%' UNION SELECT m.site, g.b FROM m JOIN g ON g.a = m.node)"""


def sites(spark, sf_dir):
    return table(spark, sf_dir, "region").select(F.concat(F.lit("urn:site:"), F.col("r_regionkey").cast("string")).alias("site"))


@register("site_membership", f"WITH RECURSIVE {PLANT} SELECT node, min(site) AS site FROM m GROUP BY 1")
def site_membership(spark, sf_dir):
    """Site of every node: along parts and points, against feeds."""
    return paths.site_of(plant(spark, sf_dir), sites(spark, sf_dir))


@register(
    "navigation_levels",
    f"""WITH RECURSIVE {PLANT}, e AS (SELECT 'urn:equip:' || s_suppkey AS equip FROM supplier)
    SELECT 'root' AS level, CAST(NULL AS VARCHAR) AS parent, 'urn:site:' || r_regionkey AS child FROM region
    UNION ALL SELECT 'root', NULL, equip FROM e WHERE equip NOT IN (SELECT node FROM m)
    UNION ALL SELECT 'site', site, node FROM m JOIN e ON equip = node
    UNION ALL SELECT 'equip', equip, x FROM e JOIN (SELECT s AS q, o AS x FROM t WHERE p = 'hasPoint' UNION SELECT o, s FROM t WHERE p = 'isPointOf') ON q = equip""",
)
def navigation_levels(spark, sf_dir):
    equips = table(spark, sf_dir, "supplier").select(F.concat(F.lit("urn:equip:"), F.col("s_suppkey").cast("string")).alias("equip"))
    return paths.navigation(plant(spark, sf_dir), sites(spark, sf_dir), equips)


@register(
    "path_pairs",
    f"""WITH RECURSIVE {PLANT}, f AS (SELECT s AS a, o AS b FROM t WHERE p = 'feeds' UNION SELECT f.a, t.o FROM f JOIN t ON t.p = 'feeds' AND t.s = f.b)
    SELECT DISTINCT f.a AS start, t.s AS "end" FROM f JOIN t ON t.p = 'hasPart' AND t.o = f.b""",
)
def path_pairs(spark, sf_dir):
    """Equipment with the sites that it serves, over any number of feeds and back up a part."""
    return paths.reach(plant(spark, sf_dir), paths.seq(paths.some(paths.step("feeds")), paths.back("hasPart")))


@register(
    "space_tree",
    """WITH RECURSIVE e AS (SELECT p_partkey AS child, CASE WHEN p_partkey % 100 = 98 THEN p_partkey + 1 WHEN p_partkey % 100 = 99 THEN p_partkey - 1 ELSE p_partkey // 2 END AS parent FROM part WHERE p_partkey > 1),
    n AS (SELECT child AS node FROM e UNION SELECT parent FROM e), d AS (SELECT node, node AS root, CAST(0 AS BIGINT) AS depth FROM n WHERE node NOT IN (SELECT child FROM e) UNION ALL SELECT e.child, d.root, d.depth + 1 FROM d JOIN e ON e.parent = d.node)
    SELECT n.node, d.root, d.depth, d.node IS NULL AS cyclic FROM n LEFT JOIN d ON d.node = n.node""",
)
def space_tree(spark, sf_dir):
    """Spaces with root and depth; pairs that are each other's parent, and all below them, are cyclic."""
    k = F.col("p_partkey")
    parent = F.when(k % 100 == 98, k + 1).when(k % 100 == 99, k - 1).otherwise(F.floor(k / 2))
    return paths.tree_check(table(spark, sf_dir, "part").where(k > 1).select(k.alias("child"), parent.alias("parent")))


@register(
    "tree_fold",
    """WITH RECURSIVE e AS (SELECT p_partkey AS child, CASE WHEN p_partkey <= 100 THEN p_partkey - 1 ELSE p_partkey // 3 END AS parent FROM part),
    v AS (SELECT l_partkey AS node, l_quantity AS value FROM lineitem), up AS (SELECT node, node AS at, value FROM v UNION ALL SELECT up.node, e.parent, up.value FROM up JOIN e ON e.child = up.at)
    SELECT at AS node, round(sum(value), 4) AS total, count(*) AS n, min(value) AS low, max(value) AS high FROM up GROUP BY 1""".replace("SELECT node, node AS at", "SELECT node, node AS at_node").replace("up.at)", "up.at_node)").replace("SELECT at AS node", "SELECT at_node AS node"),
)
def tree_fold(spark, sf_dir):
    """Quantities of each part with all below it, in a tree with a chain of a hundred at its top."""
    k = F.col("p_partkey")
    edges = table(spark, sf_dir, "part").select(k.alias("child"), F.when(k <= 100, k - 1).otherwise(F.floor(k / 3)).alias("parent"))
    values = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_quantity").alias("value"))
    found = paths.tree_fold(edges, values).where("n > 0")
    return found.select("node", F.round("total", 4).alias("total"), "n", "low", "high")
