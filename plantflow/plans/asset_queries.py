"""Registered queries: verification, lifecycle, derivations, streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from plantflow.operators import derive, lifecycle, timejoin, verify, windows
from plantflow.plans.history_queries import GOOD, H, ntz, r6
from plantflow.plans.series_queries import SENSOR_SQL, pair
from plantflow.registry import register
from plantflow.session import table
from plantflow.sources.adapter import history
from plantflow.streaming import faults


@register(
    "check_existence",
    f"""WITH {H}, p AS (SELECT DISTINCT point_uri FROM h UNION SELECT 'urn:point:never'), n AS (SELECT point_uri, max(ts) AS newest, max(ts) FILTER (value IS NOT NULL OR value_text IS NOT NULL OR value_bool IS NOT NULL) AS valued FROM h GROUP BY 1)
    SELECT point_uri, CASE WHEN newest IS NULL THEN 'inconclusive' WHEN valued >= TIMESTAMP '2024-01-31' - INTERVAL 3 DAY THEN 'pass' ELSE 'fail' END AS status FROM p LEFT JOIN n USING (point_uri)""",
)
def check_existence(spark, sf_dir):
    h = history(spark, sf_dir)
    points = h.select("point_uri").distinct().unionByName(spark.createDataFrame([("urn:point:never",)], "point_uri string"))
    return verify.existence(points, h, ntz("2024-01-31"), 3 * 86400)


@register(
    "check_liveness",
    f"WITH {H} SELECT point_uri, CASE WHEN count(value) < 3 THEN 'inconclusive' WHEN max(value) - min(value) <= 0.01 THEN 'fail' ELSE 'pass' END AS status FROM h GROUP BY 1",
)
def check_liveness(spark, sf_dir):
    return verify.liveness(history(spark, sf_dir))


@register(
    "check_agreement",
    f"""WITH {SENSOR_SQL}, m AS (SELECT s.user_id, s.value / 100 AS value, p.value / 100 AS match FROM s ASOF JOIN p ON s.user_id = p.user_id AND s.ts >= p.ts)
    SELECT user_id, count(*) AS n, round(avg(CAST((value > 0.5) = (match > 0.5) AS INTEGER)), 6) AS ratio,
    CASE WHEN count(*) < 3 THEN 'inconclusive' WHEN avg(CAST((value > 0.5) = (match > 0.5) AS INTEGER)) >= 0.6 THEN 'pass' ELSE 'fail' END AS status FROM m GROUP BY 1""",
)
def check_agreement(spark, sf_dir):
    m = timejoin.asof(*pair(spark, sf_dir), "user_id").where("match is not null")
    scaled = m.withColumn("value", F.col("value") / 100).withColumn("match", F.col("match") / 100)
    return verify.agreement(scaled, "user_id", needed=0.6).select("user_id", "n", r6("ratio"), "status")


@register(
    "check_tracking",
    f"""WITH {SENSOR_SQL}, m AS (SELECT s.user_id, s.value, p.value AS match FROM s ASOF JOIN p ON s.user_id = p.user_id AND s.ts >= p.ts)
    SELECT user_id, count(*) AS n, round(avg(abs(value - match) / match), 5) AS mae, CASE WHEN count(*) < 3 THEN 'inconclusive' WHEN avg(abs(value - match) / match) <= 2 THEN 'pass' ELSE 'fail' END AS status FROM m WHERE match > 0 GROUP BY 1""",
)
def check_tracking(spark, sf_dir):
    m = timejoin.asof(*pair(spark, sf_dir), "user_id").where("match is not null")
    return verify.tracking(m, "user_id", 2.0, relative=True).select("user_id", "n", F.round("mae", 5).alias("mae"), "status")


@register(
    "check_tail_flat",
    """WITH e AS (SELECT user_id, min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT user_id, max(value) - min(value) <= 1.0 AS flat FROM events JOIN e USING (user_id) WHERE event_type = 'error' AND epoch_us(ts) >= hi - 0.25::DOUBLE * (hi - lo) GROUP BY 1""",
)
def check_tail_flat(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", "ts", "value")
    return verify.tail_flat(e, "user_id", flat=1.0)


@register(
    "check_ladder",
    """WITH r AS (SELECT l_orderkey AS k, max(CASE WHEN l_linenumber = 1 THEN s END) AS r1, max(CASE WHEN l_linenumber = 2 THEN s END) AS r2, max(CASE WHEN l_linenumber = 3 THEN s END) AS r3
      FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'fail' WHEN 'N' THEN 'pass' ELSE 'inconclusive' END AS s FROM lineitem WHERE l_linenumber <= 3) GROUP BY 1),
    c AS (SELECT *, CASE WHEN r1 IS DISTINCT FROM 'pass' THEN 0 WHEN r2 <> 'pass' THEN 1 WHEN r3 IS DISTINCT FROM 'pass' THEN CASE WHEN r2 = 'pass' THEN 2 ELSE 1 END ELSE 3 END AS highest FROM r)
    SELECT k, CAST(highest AS INTEGER) AS highest, CASE WHEN 'fail' IN (coalesce(r1, ''), coalesce(r2, ''), coalesce(r3, '')) THEN 'fail' WHEN highest = 3 THEN 'pass' ELSE 'inconclusive' END AS status FROM c""",
)
def check_ladder(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "A", "fail").when(F.col("l_returnflag") == "N", "pass").otherwise("inconclusive")
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3")
    return verify.ladder(li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("rung"), status.alias("status")), "k")


@register(
    "worst_status",
    """SELECT l_suppkey, CASE min(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN CASE WHEN l_quantity > 2 THEN NULL ELSE 1 END ELSE 2 END) WHEN 0 THEN 'fail' WHEN 1 THEN 'inconclusive' WHEN 2 THEN 'pass' ELSE 'not_applicable' END AS status
    FROM lineitem WHERE l_quantity < 6 AND l_linenumber > 5 GROUP BY 1""",
)
def worst_status(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_quantity < 6 and l_linenumber > 5")
    status = F.when(F.col("l_returnflag") == "A", "fail").when(F.col("l_returnflag") == "N", F.when(F.col("l_quantity") > 2, "not_applicable").otherwise("inconclusive")).otherwise("pass")
    return li.withColumn("status", status).groupBy("l_suppkey").agg(verify.worst(F.col("status")).alias("status"))


@register(
    "template_completeness",
    """WITH t(type, class) AS (VALUES (0, 'click'), (0, 'view'), (0, 'signup'), (1, 'error'), (1, 'purchase')), e AS (SELECT DISTINCT user_id AS equip, user_id % 2 AS type FROM events),
    p AS (SELECT DISTINCT user_id AS equip, event_type AS class FROM events WHERE value > 100) SELECT e.equip, count(*) AS needed, count(p.class) AS met FROM e JOIN t ON t.type = e.type LEFT JOIN p ON p.equip = e.equip AND p.class = t.class GROUP BY 1""",
)
def template_completeness(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    templates = spark.createDataFrame([(0, "click"), (0, "view"), (0, "signup"), (1, "error"), (1, "purchase")], "type long, class string")
    equips = e.select(F.col("user_id").alias("equip"), (F.col("user_id") % 2).alias("type")).distinct()
    return verify.completeness(equips, e.where("value > 100").select(F.col("user_id").alias("equip"), F.col("event_type").alias("class")), templates)


@register(
    "economizer",
    """SELECT l_suppkey AS key, count(*) FILTER (l_quantity > 26) AS hot, count(*) FILTER (l_quantity > 26 AND l_discount * 1000 > 25) AS hot_fail,
    count(*) FILTER (l_tax * 100 > 5 AND l_quantity < 24 AND l_quantity < l_linenumber * 8 - 1) AS cool, count(*) FILTER (l_tax * 100 > 5 AND l_quantity < 24 AND l_quantity < l_linenumber * 8 - 1 AND l_discount * 1000 <= 25) AS cool_fail FROM lineitem GROUP BY 1""",
)
def economizer(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(
        F.col("l_suppkey").alias("key"), F.col("l_quantity").alias("oat"), (F.col("l_discount") * 1000).alias("damper"),
        (F.col("l_tax") * 100).alias("cooling"), (F.col("l_linenumber") * 8).cast("double").alias("rat"),
    )
    return verify.economizer(rows, 25)


@register(
    "sequence_check",
    """SELECT user_id, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS bad, CASE WHEN count(*) FILTER (NOT ok) > 0.5::DOUBLE * count(ok) THEN 'fail' WHEN count(*) FILTER (ok) > 0 THEN 'pass' ELSE 'untested' END AS status
    FROM (SELECT user_id, CASE WHEN event_type IN ('click', 'view') THEN value > 50 END AS ok FROM events) GROUP BY 1""",
)
def sequence_check(spark, sf_dir):
    test = F.when(F.col("event_type").isin("click", "view"), F.col("value") > 50)
    return verify.sequence(table(spark, sf_dir, "events"), "user_id", test, 0.5)


@register(
    "compliance",
    """WITH c AS (SELECT user_id, least(coalesce(lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts), epoch_us(TIMESTAMP '2024-01-31')) - epoch_us(ts), 43200000000) AS c, epoch_us(ts) AS t FROM events WHERE event_type = 'view' AND ts >= '2024-01-01' AND ts < '2024-01-31'),
    v AS (SELECT user_id, round(100 * least(sum(c) + least(min(t) - epoch_us(TIMESTAMP '2024-01-01'), 43200000000), 2592000000000) / 2592000000000.0, 2) AS pct FROM c GROUP BY 1),
    s AS (SELECT user_id, count(*) FILTER (value < 0.2 OR value > 250) AS n_bad, max_by(value, (abs(value - 125.1::DOUBLE), ts)) AS worst FROM events WHERE event_type = 'view' GROUP BY 1)
    SELECT user_id, n_bad, worst, CASE WHEN n_bad > 0 THEN 'fail' WHEN coalesce(pct, 0) < 30 THEN 'inconclusive' ELSE 'pass' END AS status FROM s LEFT JOIN v USING (user_id)""",
)
def compliance(spark, sf_dir):
    s, _ = pair(spark, sf_dir)
    cover = windows.availability(s, "user_id", "2024-01-01 00:00:00", "2024-01-31 00:00:00", 43200)
    return verify.compliance(s, "user_id", 0.2, 250, cover, 30)


@register(
    "phase_gate",
    """SELECT l_shipmode_phase AS phase, coalesce(open, 0) AS open, open IS NULL AS passed FROM (SELECT DISTINCT l_linestatus || l_linenumber AS l_shipmode_phase FROM lineitem) p
    LEFT JOIN (SELECT l_linestatus || l_linenumber AS k, count(*) AS open FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 49 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 97 <> 3) GROUP BY 1) f ON f.k = l_shipmode_phase""",
)
def phase_gate(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    status = F.when((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 49), "fail").otherwise("pass")
    results = li.select(F.col("l_orderkey").alias("item"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("phase"), status.alias("status"))
    waived = table(spark, sf_dir, "orders").where("o_orderkey % 97 <> 3").select(F.col("o_orderkey").alias("item"))
    return verify.gate(results, waived)


@register(
    "issue_states",
    """WITH i AS (SELECT o_orderkey AS key, CASE o_orderstatus WHEN 'F' THEN 'open' WHEN 'O' THEN 'resolved' ELSE 'accepted' END AS state FROM orders WHERE o_orderkey % 3 <> 0),
    r AS (SELECT o_orderkey AS key, CASE WHEN o_totalprice > 250000 THEN 'fail' ELSE 'pass' END AS status FROM orders WHERE o_orderkey % 2 = 0)
    SELECT * FROM (SELECT key, CASE WHEN state IS NULL AND status = 'fail' THEN 'open' WHEN state IN ('open', 'accepted') AND status = 'pass' THEN 'resolved' WHEN state = 'resolved' AND status = 'fail' THEN 'reopened' ELSE state END AS state FROM i FULL JOIN r USING (key)) WHERE state IS NOT NULL""",
)
def issue_states(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "key")
    state = F.when(F.col("o_orderstatus") == "F", "open").when(F.col("o_orderstatus") == "O", "resolved").otherwise("accepted")
    status = F.when(F.col("o_totalprice") > 250000, "fail").otherwise("pass")
    return verify.issue_transitions(o.where("key % 3 <> 0").select("key", state.alias("state")), o.where("key % 2 = 0").select("key", status.alias("status")))


@register(
    "fault_mirror",
    """SELECT o_orderkey AS key, 'open' AS action FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 2 <> 0 UNION ALL SELECT o_orderkey, 'close' FROM orders WHERE o_custkey % 2 = 0 AND o_orderstatus <> 'F'""",
)
def fault_mirror(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "key")
    return verify.mirror_plan(o.where("o_orderstatus = 'F'"), o.where("o_custkey % 2 = 0"))


@register(
    "warranty_status",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'voided' WHEN DATE '1998-06-01' < l_shipdate::DATE THEN 'pending' WHEN DATE '1998-06-01' > l_shipdate::DATE + 365 THEN 'expired'
    WHEN (l_shipdate::DATE + 365) - DATE '1998-06-01' <= 90 THEN 'expiring' ELSE 'active' END AS status FROM lineitem""",
)
def warranty_status(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    start = F.to_date("l_shipdate")
    voided = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), F.lit("1990-01-01").cast("date"))
    return li.select("l_orderkey", "l_linenumber", lifecycle.warranty_status(F.lit("1998-06-01").cast("date"), start, F.date_add(start, 365), voided).alias("status"))


@register(
    "pm_due",
    """SELECT id, due_at, CASE WHEN due_at - DATE '1998-06-01' < 0 THEN 'overdue' WHEN due_at - DATE '1998-06-01' <= 14 THEN 'due' ELSE 'later' END AS status, CAST(CASE WHEN due_at - DATE '1998-06-01' < 0 THEN 0 WHEN due_at - DATE '1998-06-01' <= 14 THEN 1 ELSE 2 END AS INTEGER) AS rank
    FROM (SELECT o_orderkey AS id, o_orderdate::DATE + CAST(30 + o_custkey % 300 AS INTEGER) AS due_at FROM orders)""",
)
def pm_due(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    tasks = o.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("last_done"), (30 + F.col("o_custkey") % 300).cast("int").alias("every_days"))
    return lifecycle.pm_due(tasks, F.lit("1998-06-01").cast("date"))


@register(
    "condition_index",
    """WITH v AS (SELECT l_partkey AS a, arg_max(l_extendedprice, l_shipdate * 1) AS value FROM (SELECT l_partkey, l_extendedprice, epoch_us(l_shipdate) * 10 + l_linenumber AS l_shipdate FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY epoch_us(lineitem.l_shipdate) * 10 + l_linenumber DESC, l_extendedprice DESC) = 1) GROUP BY 1),
    i AS (SELECT DISTINCT p_partkey FROM part WHERE p_size > 10) SELECT round(c.cost, 2) AS cost, round(t.value, 2) AS value, round(c.cost / t.value, 6) AS fci
    FROM (SELECT sum(o_totalprice) AS cost FROM orders WHERE o_orderstatus = 'O') c, (SELECT sum(value) AS value FROM v WHERE a IN (FROM i)) t""",
)
def condition_index(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    deferred = o.select(F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"), F.col("o_totalprice").alias("cost"))
    as_of = F.struct(F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 10 + F.col("l_linenumber"), "l_extendedprice")
    values = li.select(F.col("l_partkey").alias("asset_id"), as_of.alias("as_of"), F.col("l_extendedprice").alias("value"))
    installed = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("asset_id"))
    out = lifecycle.condition_index(deferred, values, installed)
    return out.select(F.round("cost", 2).alias("cost"), F.round("value", 2).alias("value"), r6("fci"))


@register(
    "capital_plan",
    """SELECT CAST(year AS INTEGER) AS year, round(sum(a), 2) AS replace, round(sum(b), 2) AS repair FROM (SELECT greatest(1980 + p_size % 30 + 15 + p_size % 7, 2005) AS year, p_retailprice AS a, 0.0::DOUBLE AS b FROM part
    UNION ALL SELECT greatest(year(o_orderdate) + 6, 2005), 0.0, o_totalprice FROM orders WHERE o_orderstatus = 'O') GROUP BY 1""",
)
def capital_plan(spark, sf_dir):
    p, o = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    assets = p.select((1980 + F.col("p_size") % 30).alias("first_year"), (15 + F.col("p_size") % 7).cast("double").alias("median_years"), F.col("p_retailprice").alias("value"))
    status = F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed")
    deferred = o.select((F.year("o_orderdate") + 6).alias("target_year"), F.col("o_totalprice").alias("cost"), status.alias("status"))
    out = lifecycle.capital_plan(assets, deferred, 2005)
    return out.select("year", F.round("replace", 2).alias("replace"), F.round("repair", 2).alias("repair"))


@register(
    "schedule_value",
    """WITH w(dow, minute, value) AS (VALUES (0, 360, 21.0), (0, 1080, 16.0), (1, 360, 21.5), (2, 420, 20.0), (4, 0, 19.0)), x(day, priority, minute, value) AS (VALUES (DATE '2024-01-08', 5, 0, 12.0), (DATE '2024-01-08', 3, 600, 25.0), (DATE '2024-01-10', 16, 300, 11.0)),
    r AS (SELECT event_id AS id, ts, isodow(ts) - 1 AS dow, ts::DATE AS day, hour(ts) * 60 + minute(ts) AS now FROM events),
    e AS (SELECT id, x.value AS ev FROM r JOIN x USING (day) WHERE x.minute <= now QUALIFY row_number() OVER (PARTITION BY id ORDER BY priority, x.minute DESC) = 1),
    k AS (SELECT id, w.value AS wv FROM r JOIN w USING (dow) WHERE w.minute <= now QUALIFY row_number() OVER (PARTITION BY id ORDER BY w.minute DESC) = 1)
    SELECT r.id, r.ts, CAST(coalesce(ev, wv, 15.0) AS DOUBLE) AS value FROM r LEFT JOIN e USING (id) LEFT JOIN k USING (id)""",
)
def schedule_value(spark, sf_dir):
    from datetime import date

    weekly = spark.createDataFrame([(0, 360, 21.0), (0, 1080, 16.0), (1, 360, 21.5), (2, 420, 20.0), (4, 0, 19.0)], "dow int, minute int, value double")
    special = spark.createDataFrame([(date(2024, 1, 8), 5, 0, 12.0), (date(2024, 1, 8), 3, 600, 25.0), (date(2024, 1, 10), 16, 300, 11.0)], "day date, priority int, minute int, value double")
    return lifecycle.schedule_value(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts"), weekly, special, 15.0)


@register("calendar_match", "SELECT o_orderkey FROM orders WHERE month(o_orderdate) % 2 = 1 AND o_orderdate::DATE = last_day(o_orderdate)")
def calendar_match(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(lifecycle.date_matches(F.to_date("o_orderdate"), month="odd", dom="last")).select("o_orderkey")


@register(
    "earned_evidence",
    """WITH p AS (SELECT l_orderkey AS a, bool_and(l_returnflag = 'N') AS proven FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1)
    SELECT o_orderkey AS activity, CASE WHEN proven THEN 'done_by_data' WHEN proven IS NULL THEN 'not_linked' WHEN o_orderdate <= '1998-01-01' THEN 'due_not_evidenced' ELSE 'open' END AS state FROM orders LEFT JOIN p ON a = o_orderkey""",
)
def earned_evidence(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_linenumber <= 2")
    check = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    links = li.select(F.col("l_orderkey").alias("activity"), check.alias("check"), "l_returnflag")
    judged = links.groupBy("check").agg(F.min(F.when(F.col("l_returnflag") == "N", "pass").otherwise("fail")).alias("status"))
    return lifecycle.earned_evidence(o.select(F.col("o_orderkey").alias("activity"), F.col("o_orderdate").alias("finish")), links.drop("l_returnflag"), judged, ntz("1998-01-01"))


@register(
    "derivation_formula",
    """WITH w AS (SELECT user_id, event_type, arg_max(value, ts) AS v FROM events WHERE event_type IN ('view', 'click') AND ts BETWEEN TIMESTAMP '2024-01-25' - INTERVAL 5 DAY AND '2024-01-25' GROUP BY ALL)
    SELECT 't' || u.user_id AS target, round(a.v - b.v, 6) AS value, CAST(NULL AS VARCHAR) AS error FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN w a ON a.user_id = u.user_id AND a.event_type = 'view' LEFT JOIN w b ON b.user_id = u.user_id AND b.event_type = 'click'""",
)
def derivation_formula(spark, sf_dir):
    """Last of a minus last of b for every target, over a trailing window."""
    e = table(spark, sf_dir, "events")
    point = F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type")
    users = e.select("user_id").distinct()
    ends = F.explode(F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("view"), F.lit("click")))).alias("name", "event_type")
    targets = users.select("user_id", ends).select(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("target"), "name", point.alias("point_uri"))
    out = derive.evaluate(e.select(point.alias("point_uri"), "ts", "value"), targets, derive.last_difference, ntz("2024-01-25"), 5 * 86400, keep=1)
    return out.select("target", r6("value"), "error")


@register(
    "target_health",
    "SELECT target, count(*) = 5 AND bool_and(failed) AS disabled FROM (SELECT user_id AS target, event_type IN ('error', 'view', 'click') AS failed FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 5) GROUP BY 1",
)
def target_health(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return derive.target_health(e.select(F.col("user_id").alias("target"), F.col("ts").alias("at"), F.col("event_type").isin("error", "view", "click").alias("failed")))


def _events_stream(spark, sf_dir):
    """The events table as a file stream."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def _drain(stream, spark):
    """Run a stream over what is there and read what it wrote, both below the checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-plantflow-")
    base = f"{base}/stream-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@register(
    "stream_faults",
    """WITH f AS (SELECT CAST(user_id AS VARCHAR) AS point_uri, ts, value > 60 AS bad FROM events WHERE event_type = 'view' AND event_id % 9 <> 0),
    c AS (SELECT *, coalesce(lag(bad) OVER (PARTITION BY point_uri ORDER BY ts), false) AS was FROM f) SELECT point_uri, CASE WHEN bad THEN 'open' ELSE 'resolve' END AS action, ts AS at FROM c WHERE bad <> was""".replace("ts AS at", 'ts AS "at"'),
)
def stream_faults(spark, sf_dir):
    """Structured Streaming: open and resolve events; flagged readings (every ninth) change nothing."""
    e = _events_stream(spark, sf_dir).where("event_type = 'view'")
    quality = F.when(F.col("event_id") % 9 == 0, "fault")
    readings = e.select(F.col("user_id").cast("string").alias("point_uri"), F.col("ts").cast("timestamp").alias("ts"), "value", quality.alias("quality"))
    return _drain(faults.fault_stream(readings, -1.0, 60.0), spark).withColumn("at", F.col("at").cast("timestamp_ntz"))


@register(
    "stream_rollup",
    """SELECT event_type AS point_uri, time_bucket(INTERVAL 1 DAY, ts) AS bucket, round(sum(value), 6) AS vsum, count(value) AS vcount FROM events
    WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 30 SECOND GROUP BY 1, 2""",
)
def stream_rollup(spark, sf_dir):
    """Structured Streaming: day windows that the watermark has closed."""
    e = _events_stream(spark, sf_dir).select(F.col("event_type").alias("point_uri"), F.col("ts").cast("timestamp").alias("ts"), "value")
    out = _drain(faults.rollup_stream(e, "1 day", "30 seconds"), spark)
    return out.select("point_uri", F.col("bucket").cast("timestamp_ntz").alias("bucket"), r6("vsum"), "vcount")


@register(
    "late_samples",
    f"WITH {H}, j AS (SELECT point_uri, max(ts) AS judged_to FROM h WHERE ts < '2024-01-15' AND {GOOD} GROUP BY 1) SELECT point_uri, ts FROM h JOIN j USING (point_uri) WHERE ts >= '2024-01-10' AND ts <= judged_to",
)
def late_samples(spark, sf_dir):
    from plantflow.sources.history import good

    h = history(spark, sf_dir)
    judged = h.where((F.col("ts") < ntz("2024-01-15")) & good()).groupBy("point_uri").agg(F.max("ts").alias("judged_to"))
    return faults.split_late(h.where(F.col("ts") >= ntz("2024-01-10")), judged)[1].select("point_uri", "ts")


@register(
    "alert_states",
    """WITH o AS (SELECT CAST(user_id AS VARCHAR) AS key, ts, event_type IN ('error', 'view') AS present FROM events), g AS (SELECT *, CASE WHEN lag(present) OVER w = present THEN 0 ELSE 1 END AS edge FROM o WINDOW w AS (PARTITION BY key ORDER BY ts)),
    r AS (SELECT *, sum(edge) OVER (PARTITION BY key ORDER BY ts) AS run FROM g), s AS (SELECT *, min(ts) OVER (PARTITION BY key, run) AS start FROM r),
    e AS (SELECT key, run, present, min(ts) AS "at" FROM s WHERE ts - start >= INTERVAL 1 HOUR GROUP BY 1, 2, 3)
    SELECT key, CASE WHEN present THEN 'firing' ELSE 'resolved' END AS event, "at" FROM (SELECT *, coalesce(lag(present) OVER (PARTITION BY key ORDER BY "at"), false) AS was FROM e) WHERE present <> was""",
)
def alert_states(spark, sf_dir):
    """Firing and resolved alerts per user."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "ts", F.col("event_type").isin("error", "view").alias("present"))
    return faults.alert_states(e, 3600, 3600)


@register(
    "override_tests",
    """WITH RECURSIVE c AS (SELECT user_id AS k, ts, floor(value / 20) * 20 AS v FROM events WHERE event_type = 'view'), e AS (SELECT *, lag(v) OVER w AS p, row_number() OVER w AS i FROM c WINDOW w AS (PARTITION BY k ORDER BY ts, v)),
    z AS (SELECT k, i, ts, NULL::DOUBLE AS hv, NULL::DOUBLE AS hp, NULL::TIMESTAMP AS ha, NULL::BOOLEAN AS hr, NULL::TIMESTAMP AS done_at, NULL::DOUBLE AS dv, NULL::DOUBLE AS dp, NULL::TIMESTAMP AS dt, NULL::BOOLEAN AS dr FROM e WHERE i = 1
    UNION ALL SELECT e.k, e.i, e.ts, CASE WHEN stays THEN hv WHEN steps THEN e.v END, CASE WHEN stays THEN hp WHEN steps THEN e.p END, CASE WHEN stays THEN ha WHEN steps THEN e.ts END, CASE WHEN stays THEN hr WHEN steps THEN hv IS NOT NULL AND NOT hr AND abs(e.v - hp) < 20 END,
      CASE WHEN NOT stays AND hv IS NOT NULL THEN ha END, CASE WHEN NOT stays THEN hv END, CASE WHEN NOT stays THEN hp END, CASE WHEN NOT stays AND hv IS NOT NULL THEN e.ts END, CASE WHEN NOT stays THEN hr END
      FROM (SELECT z.hv, z.hp, z.ha, z.hr, e.*, coalesce(abs(e.v - z.hv) < 20, false) AS stays, abs(e.v - e.p) >= 20 AS steps FROM z JOIN e ON e.k = z.k AND e.i = z.i + 1) e),
    s AS (SELECT k, done_at AS a, dv AS v, dp AS p, dt AS u, dr AS r FROM z WHERE done_at IS NOT NULL UNION ALL SELECT k, ha, hv, hp, NULL, hr FROM (SELECT *, max(i) OVER (PARTITION BY k) AS n FROM z) WHERE i = n AND hv IS NOT NULL),
    o AS (SELECT s.*, CASE WHEN r THEN 'release' WHEN coalesce(u, '2024-01-31') - a < INTERVAL 12 HOUR AND u IS NOT NULL THEN 'not_held' WHEN coalesce(u, '2024-01-31') - a < INTERVAL 12 HOUR THEN 'standing'
      WHEN EXISTS (SELECT 1 FROM events x WHERE x.user_id = s.k AND x.event_type = 'purchase' AND x.ts BETWEEN a - INTERVAL 6 HOUR AND a + INTERVAL 6 HOUR) THEN 'own'
      WHEN EXISTS (SELECT 1 FROM events x WHERE x.user_id = s.k AND x.event_type = 'signup' AND x.ts BETWEEN a - INTERVAL 6 HOUR AND a + INTERVAL 6 HOUR) THEN 'schedule' ELSE 'override' END AS verdict FROM s),
    j AS (SELECT k, a, v, u, a + INTERVAL 1 DAY AS dl, least(a + INTERVAL 1 DAY, coalesce(u, a + INTERVAL 1 DAY), TIMESTAMP '2024-01-31') AS fin FROM o WHERE verdict = 'override'),
    t AS (SELECT j.k, j.a, any_value(v) AS v, any_value(u) AS u, any_value(dl) AS dl, any_value(fin) AS fin, count(x.ts) AS n, count(*) FILTER (abs(x.value - v) <= 30) AS hits FROM j LEFT JOIN events x ON x.user_id = j.k AND x.event_type = 'click' AND x.ts BETWEEN a AND fin GROUP BY 1, 2),
    w AS (SELECT t.*, coalesce((SELECT arg_max(value > 60, ts) FROM events x WHERE x.user_id = t.k AND x.event_type = 'error' AND x.ts <= a), false) OR EXISTS (SELECT 1 FROM events x WHERE x.user_id = t.k AND x.event_type = 'error' AND x.value > 60 AND x.ts BETWEEN a AND fin) AS unocc FROM t),
    g AS (SELECT k, a, CASE WHEN hits > 0 THEN 'pass' WHEN NOT (dl <= '2024-01-31' OR coalesce(u <= '2024-01-31', false)) THEN 'pending' WHEN unocc THEN 'not_applicable' WHEN n = 0 THEN 'inconclusive' WHEN coalesce(u < dl, false) THEN 'inconclusive' ELSE 'fail' END AS status FROM w)
    SELECT k, arg_max(status, a) FILTER (status <> 'pending') AS status, count(*) FILTER (status <> 'pending') AS judged, count(*) FILTER (status = 'pending') AS pending,
      coalesce((SELECT count(*) FROM o WHERE o.k = g.k AND verdict NOT IN ('override', 'standing')), 0) AS excluded FROM g GROUP BY 1 HAVING count(*) FILTER (status <> 'pending') > 0""",
)
def override_tests(spark, sf_dir):
    """Overrides of a user's views, answered by clicks; purchases are our own writes, signups a schedule, large errors an unoccupied state."""
    from plantflow.operators import overrides

    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "k")
    of = lambda kind: e.where(F.col("event_type") == kind).select("k", "ts", "value")
    now = ntz("2024-01-31")
    commands = of("view").withColumn("value", F.floor(F.col("value") / 20) * 20)
    found = overrides.detect(commands, "k", 20.0, now, min_hold_s=12 * 3600, own=of("purchase"), own_slack_s=6 * 3600, schedule=of("signup"), schedule_slack_s=6 * 3600)
    unoccupied = of("error").withColumn("value", (F.col("value") > 60).cast("double"))
    judged = overrides.judge(found.where("verdict = 'override'"), of("click"), "k", 30.0, now, within_s=86_400, unoccupied=unoccupied)
    return overrides.summary(found, judged, "k")
