"""Registered queries: bare words, measures and instants in filters, reference hops of all forms, merged equipment."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantflow.operators import graph
from plantflow.operators.graph import Tag
from plantflow.plans import path_queries
from plantflow.plans.class_queries import classes, customers, triple, urn
from plantflow.registry import register
from plantflow.session import table


@register(
    "filter_words",
    """SELECT 'urn:customer:' || c_custkey AS s FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
    WHERE (r_name = 'ASIA' OR n_nationkey = 3) AND c_mktsegment <> 'BUILDING' AND c_custkey IN (SELECT o_custkey FROM orders)""",
)
def filter_words(spark, sf_dir):
    """(east or north) and equip and not segment == "BUILDING": words of a class above, of a mapping rule run backwards, and structure."""
    family = graph.class_family(classes(spark, sf_dir))
    words = spark.createDataFrame([("Asia", "east"), ("Europe", "west")], "class string, word string")
    rules = spark.createDataFrame([("Alias_3", ["cold", "north"])], "class string, words array<string>")
    o = table(spark, sf_dir, "orders").withColumn("b", F.col("o_orderkey").cast("string"))
    links = o.select(urn("customer", "o_custkey").alias("a"), F.lit("hasPoint").alias("edge"), urn("order", "b").alias("b"))
    known = graph.facts(customers(spark, sf_dir), family, words, rules, links)
    return ((Tag.word("east") | Tag.word("north")) & Tag.word("equip") & ~Tag.text("segment", "BUILDING")).match(known)


@register("filter_measures", "SELECT 'urn:part:' || p_partkey AS s FROM part WHERE p_size > 20 AND (p_size % 3 = 0 OR p_partkey % 2 = 0)")
def filter_measures(spark, sf_dir):
    """size > 20in: the tag's unit, else that of the subject."""
    p = table(spark, sf_dir, "part")
    s = urn("part", "p_partkey")
    rows = triple(p, s, "size", "num", num=F.col("p_size").cast("double"), unit=F.when(F.col("p_size") % 3 == 0, "in"))
    rows = rows.unionByName(triple(p, s, "unit", "str", F.when(F.col("p_partkey") % 2 == 0, "in").otherwise("cm")))
    return Tag.measure("size", ">", 20, "in").match(rows)


@register("filter_instants", "SELECT 'urn:order:' || o_orderkey AS s FROM orders WHERE o_orderdate = '1995-03-05' AND o_orderkey % 3 < 2")
def filter_instants(spark, sf_dir):
    """placed == 1995-03-05T00:00:00Z UTC: the same instant, in the same zone where one is stored."""
    o = table(spark, sf_dir, "orders")
    zone = F.when(F.col("o_orderkey") % 3 == 1, "UTC").when(F.col("o_orderkey") % 3 == 2, "Rome")
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / F.lit(1e6)
    return Tag.instant("placed", "==", 794361600.0, "UTC").match(triple(o, urn("order", "o_orderkey"), "placed", "datetime", num=at, unit=zone))


def point_tags(spark, sf_dir):
    """Every part as a point with an equipRef value, and the name of every site."""
    p, r = table(spark, sf_dir, "part"), table(spark, sf_dir, "region")
    ref = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("urn:equip:"), (F.col("p_partkey") % 10 + 1).cast("string"))).otherwise((F.col("p_partkey") % 7).cast("string"))
    return triple(p, urn("point", "p_partkey"), "equipRef", "ref", ref).unionByName(triple(r, urn("site", "r_regionkey"), "name", "str", F.col("r_name")))


@register(
    "filter_hops",
    f"""WITH RECURSIVE {path_queries.PLANT}, h AS (SELECT s AS a, o AS b FROM t WHERE p = 'isPointOf' UNION SELECT 'urn:point:' || p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'urn:equip:' || (p_partkey % 10 + 1) ELSE 'urn:equip:haystack:' || (p_partkey % 7) END
      FROM part WHERE 'urn:point:' || p_partkey NOT IN (SELECT s FROM t WHERE p = 'isPointOf'))
    SELECT DISTINCT h.a AS s FROM h JOIN m ON m.node = h.b JOIN region ON 'urn:site:' || r_regionkey = m.site WHERE r_name IN ('ASIA', 'AMERICA')""",
)
def filter_hops(spark, sf_dir):
    """equipRef->siteRef->name: the edge before the value, the site by containment."""
    wanted = Tag.text("name", "ASIA") | Tag.text("name", "AMERICA")
    return graph.follow(point_tags(spark, sf_dir), path_queries.plant(spark, sf_dir), ("equipRef", "siteRef"), wanted, path_queries.sites(spark, sf_dir))


@register(
    "merge_equips",
    f"""WITH RECURSIVE {path_queries.PLANT}, pr AS (SELECT x.s_suppkey AS k, y.s_suppkey AS l, least('urn:equip:' || x.s_suppkey, 'urn:equip:' || y.s_suppkey) AS root FROM supplier x JOIN supplier y ON y.s_suppkey = x.s_suppkey + 1 WHERE x.s_suppkey % 4 = 1),
    k AS (SELECT 'urn:equip:' || k AS a, root FROM pr UNION ALL SELECT 'urn:equip:' || l, root FROM pr), n AS (SELECT coalesce(x.root, t.s) AS s, t.p, coalesce(y.root, t.o) AS o FROM t LEFT JOIN k x ON x.a = t.s LEFT JOIN k y ON y.a = t.o),
    i(p, q) AS (VALUES ('feeds', 'isFedBy'), ('hasPart', 'isPartOf'), ('hasPoint', 'isPointOf'), ('isPointOf', 'hasPoint'))
    SELECT s, p, o FROM (SELECT s, p, o FROM n UNION SELECT o, q, s FROM n JOIN i USING (p)) WHERE s <> o""",
)
def merge_equips(spark, sf_dir):
    """Pairs of suppliers made one, all edges rewritten and given in both directions."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 4 = 1").withColumn("next", F.col("s_suppkey") + 1)
    pairs = s.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("next")), "next").select(urn("equip", "s_suppkey").alias("a"), urn("equip", "next").alias("b"))
    inverse = spark.createDataFrame([("feeds", "isFedBy"), ("hasPart", "isPartOf"), ("hasPoint", "isPointOf")], "p string, q string")
    return graph.merge(path_queries.plant(spark, sf_dir), pairs, inverse)
