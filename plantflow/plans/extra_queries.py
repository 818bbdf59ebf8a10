"""Registered queries: dates and references in filters, message application, spec matching, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantflow.functions import mapping, scalars
from plantflow.operators import graph, timejoin, verify, windows
from plantflow.operators.graph import Tag
from plantflow.plans.history_queries import H, ntz, r6
from plantflow.plans.series_queries import pair
from plantflow.registry import register
from plantflow.session import table
from plantflow.sources import history as hs
from plantflow.sources.adapter import history
from plantflow.streaming import faults


def order_tags(spark, sf_dir):
    """Order triples: an ISO date and a customer reference."""
    o = table(spark, sf_dir, "orders").withColumn("s", F.concat(F.lit("urn:order:"), F.col("o_orderkey").cast("string")))
    none = F.lit(None)
    made = lambda p, kind, o_: o.select("s", F.lit(p).alias("p"), F.lit(kind).alias("o_kind"), o_.alias("o"), none.cast("double").alias("num"), none.cast("string").alias("unit"))
    return made("placed", "date", F.date_format("o_orderdate", "yyyy-MM-dd")).unionByName(made("custRef", "ref", F.concat(F.lit("urn:customer:"), F.col("o_custkey").cast("string"))))


@register("tag_dates", "SELECT 'urn:order:' || o_orderkey AS s FROM orders WHERE o_orderdate >= '1997-03-01' AND o_orderdate < '1997-04-01'")
def tag_dates(spark, sf_dir):
    return (Tag.date("placed", ">=", "1997-03-01") & Tag.date("placed", "<", "1997-04-01")).match(order_tags(spark, sf_dir))


@register("tag_reference", "SELECT 'urn:order:' || o_orderkey AS s FROM orders WHERE o_custkey = 77 OR (o_custkey <> 78 AND o_orderdate >= '2001-06-01')")
def tag_reference(spark, sf_dir):
    return (Tag.ref("custRef", "urn:customer:77") | (~Tag.ref("custRef", "urn:customer:78") & Tag.date("placed", ">=", "2001-06-01"))).match(order_tags(spark, sf_dir))


@register("tag_not_path", "SELECT 'urn:order:' || o_orderkey AS s FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey % 5 <> 0)")
def tag_not_path(spark, sf_dir):
    """not custRef->solvent: the path leads nowhere or its end lacks the tag."""
    triples = order_tags(spark, sf_dir)
    ends = table(spark, sf_dir, "customer").where("c_acctbal > 0 and c_custkey % 5 <> 0").select(F.concat(F.lit("urn:customer:"), F.col("c_custkey").cast("string")).alias("s"))
    return graph.lacking_path(triples.select("s").distinct(), triples.where("p = 'custRef'").select("s", "o"), ends)


@register("time_parts", "SELECT event_id, ts::DATE AS day, strftime(ts, '%H:%M:%S') AS clock FROM events WHERE ts::DATE = '2024-01-07'")
def time_parts(spark, sf_dir):
    """ts->date and ts->time of a timestamp tag."""
    e = table(spark, sf_dir, "events").where(F.to_date("ts") == F.lit("2024-01-07").cast("date"))
    return e.select("event_id", F.to_date("ts").alias("day"), F.date_format("ts", "HH:mm:ss").alias("clock"))


@register(
    "expand_points",
    f"""WITH {H}, hp AS (SELECT DISTINCT 'urn:equip:' || regexp_extract(point_uri, 'u([0-9]+)', 1) AS equip, point_uri AS point FROM h),
    g AS (SELECT DISTINCT 'urn:equip:' || user_id AS equip FROM events WHERE user_id % 60 <> 0 AND user_id // 60 IN (0, 1))
    SELECT point AS s FROM hp WHERE equip IN (SELECT equip FROM g) UNION SELECT 'urn:point:u99/view'""",
)
def expand_points(spark, sf_dir):
    h = history(spark, sf_dir).select("point_uri").distinct()
    equip = lambda k: F.concat(F.lit("urn:equip:"), k.cast("string"))
    has_point = h.select(equip(F.regexp_extract("point_uri", "u([0-9]+)", 1)).alias("equip"), F.col("point_uri").alias("point"))
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    # Chains of up to 59 merged equipments, from users 1 to 59, 61 to 119 and so on.
    same = u.where("user_id % 60 not in (0, 59)").select(equip(F.col("user_id")).alias("a"), equip(F.col("user_id") + 1).alias("b"))
    matched = spark.createDataFrame([("urn:equip:3",), ("urn:equip:110",), ("urn:point:u99/view",)], "s string")
    return graph.expand_points(matched, same, has_point)


@register("display_order", "SELECT id, row_number() OVER (ORDER BY coalesce(equip, ''), dis, id) AS place FROM (SELECT p_partkey AS id, p_name AS dis, CASE WHEN p_size % 3 > 0 THEN p_brand END AS equip FROM part)")
def display_order(spark, sf_dir):
    """Final order of series: equipment name (blank first), name, id."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("dis"), F.coalesce(F.when(F.col("p_size") % 3 > 0, F.col("p_brand")), F.lit("")).alias("equip"))
    return windows.numbered(p, "place", "equip", "dis", "id").select("id", F.col("place").cast("long").alias("place"))


@register("registry_changes", f"WITH {H}, a AS (SELECT point_uri, max(ts) AS t FROM h WHERE ts < '2024-01-28' GROUP BY 1), b AS (SELECT point_uri, max(ts) AS n FROM h WHERE ts >= '2024-01-27' GROUP BY 1) SELECT point_uri, n AS newest_ts FROM b LEFT JOIN a USING (point_uri) WHERE t IS NULL OR n > t")
def registry_changes(spark, sf_dir):
    """Registry rows a batch really changes."""
    h = history(spark, sf_dir)
    known = hs.registry(h.where(F.col("ts") < ntz("2024-01-28"))).withColumnRenamed("newest_ts", "known")
    batch = hs.registry(h.where(F.col("ts") >= ntz("2024-01-27")))
    return batch.join(known, "point_uri", "left").where("known is null or newest_ts > known").select("point_uri", "newest_ts")


@register(
    "schedule_import",
    """SELECT o_orderkey AS task, c_name AS wbs, p.preds FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 10 <> 0
    LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS preds FROM lineitem WHERE l_linenumber > 3 GROUP BY 1) p ON p.l_orderkey = o_orderkey""",
)
def schedule_import(spark, sf_dir):
    """Task, work breakdown and predecessors in one left-joined row."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0")
    preds = table(spark, sf_dir, "lineitem").where("l_linenumber > 3").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("preds"))
    rows = o.join(c, o["o_custkey"] == c["c_custkey"], "left").join(preds, o["o_orderkey"] == preds["l_orderkey"], "left")
    return rows.select(F.col("o_orderkey").alias("task"), F.col("c_name").alias("wbs"), "preds")


@register("incomplete_page", "SELECT p_partkey, (SELECT count(*) FROM part WHERE p_size > 25) > 100 AS incomplete FROM part WHERE p_size > 25 ORDER BY p_partkey LIMIT 100")
def incomplete_page(spark, sf_dir):
    """A limited result with the flag that there was more, from one row beyond the limit."""
    from pyspark.sql.window import Window

    page = table(spark, sf_dir, "part").where("p_size > 25").select("p_partkey").orderBy("p_partkey").limit(101)
    w = Window.orderBy("p_partkey")
    ranked = page.withColumn("rn", F.row_number().over(w)).withColumn("incomplete", F.count("*").over(Window.partitionBy()) > 100)
    return ranked.where("rn <= 100").select("p_partkey", "incomplete")


@register("link_references", "SELECT 'urn:order:' || o_orderkey AS a, 'urn:customer:' || c_custkey AS b, 'custRef' AS edge FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT 'urn:customer:' || c_custkey, 'urn:order:' || o_orderkey, 'hasOrder' FROM orders JOIN customer ON c_custkey = o_custkey")
def link_references(spark, sf_dir):
    """Reference literals that resolve become edges in both directions."""
    known = table(spark, sf_dir, "customer").select(F.concat(F.lit("urn:customer:"), F.col("c_custkey").cast("string")).alias("o"))
    refs = order_tags(spark, sf_dir).where("p = 'custRef'").join(known, "o", "left_semi")
    out = refs.select(F.col("s").alias("a"), F.col("o").alias("b"), F.lit("custRef").alias("edge"))
    return out.unionByName(refs.select(F.col("o").alias("a"), F.col("s").alias("b"), F.lit("hasOrder").alias("edge")))


@register("apply_messages", "SELECT 'p' || p_partkey AS s, 'brand' AS p, CASE WHEN p_size % 3 = 1 THEN p_type ELSE p_brand END AS o FROM part WHERE p_size % 3 <> 2 UNION ALL SELECT 'p' || p_partkey, 'type', p_type FROM part WHERE p_size % 5 = 0")
def apply_messages(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("s", F.concat(F.lit("p"), F.col("p_partkey").cast("string")))
    triples = p.select("s", F.lit("brand").alias("p"), F.col("p_brand").alias("o"))
    one = lambda rows, seq, tag, o: rows.select(F.lit(seq).alias("seq"), "s", F.lit(tag).alias("p"), o.alias("o"))
    messages = one(p.where("p_size % 3 = 1"), 1, "brand", F.lit("old")).unionByName(one(p.where("p_size % 3 = 1"), 2, "brand", F.col("p_type")))
    messages = messages.unionByName(one(p.where("p_size % 3 = 2"), 3, "brand", F.lit(None).cast("string"))).unionByName(one(p.where("p_size % 5 = 0"), 4, "type", F.col("p_type")))
    return graph.apply_messages(triples, messages)


@register(
    "class_candidates",
    """WITH e AS (SELECT DISTINCT p_partkey AS id, unnest(string_split(p_name, ' ') || [lower(p_type)]) AS word FROM part), v(class, word, weight) AS (VALUES ('A', 'red', 2.0), ('A', 'widget', 1.0), ('B', 'small', 1.5), ('B', 'ring', 1.0), ('B', 'economy', 0.5), ('C', 'economy', 1.0)),
    s AS (SELECT id, class, sum(CAST(weight AS DOUBLE)) - 0.75::DOUBLE * ((SELECT count(*) FROM v x WHERE x.class = v.class) - count(*)) AS score FROM e JOIN v USING (word) GROUP BY id, class)
    SELECT id, class, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, class) AS rank FROM s) WHERE rank <= 2""",
)
def class_candidates(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    evidence = p.select(F.col("p_partkey").alias("id"), F.explode(F.concat(F.split("p_name", " "), F.array(F.lower("p_type")))).alias("word"))
    listed = [("A", "red", 2.0), ("A", "widget", 1.0), ("B", "small", 1.5), ("B", "ring", 1.0), ("B", "economy", 0.5), ("C", "economy", 1.0)]
    return mapping.class_candidates(evidence, spark.createDataFrame(listed, "class string, word string, weight double"), 2).select("id", "class", r6("score"), "rank")


@register("class_veto", "SELECT p_partkey AS id, p_type AS class FROM part WHERE NOT (p_type = 'ECONOMY' AND p_size % 2 = 1) AND NOT (p_type = 'PROMO' AND p_size % 5 <> 0)")
def class_veto(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    unit = F.when(F.col("p_size") % 2 == 1, "kW").otherwise("°F")
    c = p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("class"), unit.alias("unit"), (F.col("p_size") % 5 == 0).alias("is_bool"))
    rules = spark.createDataFrame([("ECONOMY", ["°F", "°C"], None), ("PROMO", None, True)], "class string, allowed array<string>, is_state boolean")
    return mapping.veto(c, rules)


@register(
    "loop_report",
    """WITH s AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view'), p AS (SELECT user_id, ts, value FROM events WHERE event_type = 'click'),
    e AS (SELECT s.user_id, s.ts, s.value - p.value AS d FROM s ASOF JOIN p ON s.user_id = p.user_id AND s.ts >= p.ts), o AS (SELECT user_id, ts >= '2024-01-16' AS late, sign(d) AS side, lag(sign(d)) OVER (PARTITION BY user_id, ts >= '2024-01-16' ORDER BY ts) AS was FROM e WHERE abs(d) > 10),
    c AS (SELECT user_id, late, CAST(count(*) FILTER (was <> side) AS DOUBLE) AS rate FROM o GROUP BY 1, 2)
    SELECT n.user_id, n.rate, b.rate AS base, round(n.rate / greatest(b.rate, 1), 6) AS ratio, n.rate > greatest(coalesce(b.rate * 1.5::DOUBLE, 4), 1) AS hunting FROM (SELECT * FROM c WHERE late) n LEFT JOIN (SELECT * FROM c WHERE NOT late) b USING (user_id)""",
)
def loop_report(spark, sf_dir):
    """Error crossings in the second half of the month against the first."""
    e = timejoin.asof(*pair(spark, sf_dir), "user_id").where("match is not null").withColumn("error", F.col("value") - F.col("match"))
    rate = lambda rows: windows.crossings(rows, "user_id", 10.0).select("user_id", F.col("crossings").cast("double").alias("rate"))
    out = verify.loop_report(rate(e.where(F.col("ts") >= ntz("2024-01-16"))), rate(e.where(F.col("ts") < ntz("2024-01-16"))), "user_id", 1.5, 4.0)
    return out.select("user_id", "rate", "base", F.when(F.col("base").isNotNull(), F.round("ratio", 6)).otherwise(F.col("rate")).alias("ratio"), "hunting")


@register(
    "setpoint_deadband",
    """WITH c AS (SELECT l_suppkey, l_linenumber, CASE WHEN l_orderkey % 2 = 0 THEN 5.0::DOUBLE / 9 ELSE 1 END AS scale, l_quantity FROM lineitem)
    SELECT l_suppkey, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS bad, CASE WHEN count(*) FILTER (NOT ok) > 0 THEN 'fail' WHEN count(*) FILTER (ok) > 0 THEN 'pass' ELSE 'untested' END AS status
    FROM (SELECT l_suppkey, CASE WHEN l_linenumber > 2 THEN (l_quantity - l_linenumber) * scale > 2.27::DOUBLE END AS ok FROM c) GROUP BY 1""",
)
def setpoint_deadband(spark, sf_dir):
    """Setpoints in either unit are judged in Celsius."""
    li = table(spark, sf_dir, "lineitem")
    unit = F.when(F.col("l_orderkey") % 2 == 0, "°F").otherwise("°C")
    none = F.lit(None)
    celsius = lambda value: scalars.sequence_number(value, none.cast("string"), none.cast("boolean"), unit, "temperature")
    heat = F.when(F.col("l_linenumber") > 2, F.col("l_linenumber").cast("double"))
    return verify.deadband(li.select("l_suppkey", celsius(F.col("l_quantity")).alias("cool"), celsius(heat).alias("heat")), "l_suppkey")


@register("supply_reset", "SELECT user_id, max(value) - min(value) >= (200 - min(value)) * 0.25::DOUBLE * 0.99::DOUBLE AS ok FROM events WHERE event_type = 'view' GROUP BY 1")
def supply_reset(spark, sf_dir):
    return verify.reset_range(pair(spark, sf_dir)[0], "user_id", 200.0)


@register("bench_tests", "SELECT p_partkey AS step, count(l_quantity) AS n, arg_min(l_quantity, (l_shipdate, l_orderkey, l_linenumber)) FILTER (abs(l_quantity - p_size) <= 5) AS baseline, CASE WHEN count(l_quantity) = 0 THEN 'untested' WHEN count(*) FILTER (abs(l_quantity - p_size) <= 5) > 0 THEN 'pass' ELSE 'fail' END AS status FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def bench_tests(spark, sf_dir):
    steps = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("step"), F.col("p_size").cast("double").alias("target"), F.lit(5.0).alias("tolerance"))
    li = table(spark, sf_dir, "lineitem")
    return verify.bench_tests(steps, li.select(F.col("l_partkey").alias("step"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at"), F.col("l_quantity").alias("value")))


@register("spec_match", "SELECT c_name AS spec, 1.0::DOUBLE AS score, replace(c_name, '#', '-') AS field FROM customer")
def spec_match(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("tag"))
    numbered = names.withColumn("tag", F.regexp_replace("tag", "#", "-"))
    spec = names.withColumn("tag", F.regexp_replace("tag", "(?<=r)#", "#"))
    return verify.spec_match(spec, numbered.where("tag like '%-%'")).select("spec", "score", "field")


@register(
    "alarm_events",
    """WITH a AS (SELECT user_id AS key, ts, event_type IN ('error', 'purchase') AS active, CASE WHEN value > 60 THEN 'critical' WHEN value > 20 THEN 'warning' ELSE 'info' END AS severity FROM events),
    w AS (SELECT *, coalesce(lag(active) OVER p, false) AS was, lag(severity) OVER p AS before FROM a WINDOW p AS (PARTITION BY key ORDER BY ts))
    SELECT * FROM (SELECT key, ts, CASE WHEN active AND NOT was THEN 'open' WHEN active AND was AND severity <> before THEN 'update' WHEN NOT active AND was THEN 'resolve' END AS event, severity FROM w) WHERE event IS NOT NULL""",
)
def alarm_events(spark, sf_dir):
    severity = F.when(F.col("value") > 60, "critical").when(F.col("value") > 20, "warning").otherwise("info")
    e = table(spark, sf_dir, "events")
    return faults.alarm_events(e.select(F.col("user_id").alias("key"), "ts", F.col("event_type").isin("error", "purchase").alias("active"), severity.alias("severity")))


@register("judge_overlap", f"WITH {H}, j AS (SELECT point_uri, max(ts) AS t FROM h WHERE ts < '2024-01-20' AND point_uri LIKE '%/view' GROUP BY 1) SELECT point_uri, count(*) AS n FROM h LEFT JOIN j USING (point_uri) WHERE (t IS NULL OR epoch_us(ts) > epoch_us(t) - 86400000000) AND ts <= '2024-01-25' GROUP BY 1")
def judge_overlap(spark, sf_dir):
    h = history(spark, sf_dir)
    judged = h.where((F.col("ts") < ntz("2024-01-20")) & F.col("point_uri").endswith("/view")).groupBy("point_uri").agg(F.max("ts").alias("judged_to"))
    width = faults.overlap_for(86400 / 1.25, 86400)
    return faults.to_judge(h, judged, width, ntz("2024-01-25")).groupBy("point_uri").agg(F.count("*").alias("n"))


@register("alarm_severity", "SELECT o_orderkey, CASE WHEN o_custkey % 256 <= 63 THEN 'critical' WHEN o_custkey % 256 <= 127 THEN 'warning' ELSE 'info' END AS severity FROM orders")
def alarm_severity(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.alarm_severity(F.col("o_custkey") % 256).alias("severity"))
