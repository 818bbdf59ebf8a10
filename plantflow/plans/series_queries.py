"""Registered queries: joins in time, sequence windows, rules, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantflow.operators import quality as q
from plantflow.operators import rules, timejoin, windows
from plantflow.plans.history_queries import GOOD, H, ntz, r6
from plantflow.registry import register
from plantflow.session import table
from plantflow.sources.adapter import history

SENSOR_SQL = "s AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view'), p AS (SELECT user_id, ts, value FROM events WHERE event_type = 'click')"


def pair(spark, sf_dir):
    """(sensor, setpoint): two event types of one user."""
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'view'").select("user_id", "ts", "value"), e.where("event_type = 'click'").select("user_id", "ts", "value")


@register(
    "asof_backward",
    f"WITH {SENSOR_SQL} SELECT s.user_id, s.ts, s.value, p.ts AS match_ts, p.value AS match FROM s ASOF JOIN p ON s.user_id = p.user_id AND s.ts >= p.ts",
)
def asof_backward(spark, sf_dir):
    return timejoin.asof(*pair(spark, sf_dir), "user_id").where("match_ts is not null")


@register(
    "nearest_in_tolerance",
    f"""WITH {SENSOR_SQL}, b AS (SELECT s.*, p.ts AS bt, p.value AS bv FROM s ASOF LEFT JOIN p ON s.user_id = p.user_id AND s.ts >= p.ts),
    f AS (SELECT b.*, p.ts AS ft, p.value AS fv FROM b ASOF LEFT JOIN p ON b.user_id = p.user_id AND b.ts <= p.ts),
    g AS (SELECT *, bt IS NULL OR (ft - ts) <= (ts - bt) AS later FROM f)
    SELECT user_id, ts, value, CASE WHEN later THEN ft ELSE bt END AS match_ts, CASE WHEN later THEN fv ELSE bv END AS match FROM g
    WHERE abs(epoch_us(CASE WHEN later THEN ft ELSE bt END) - epoch_us(ts)) <= 7200000000""",
)
def nearest_in_tolerance(spark, sf_dir):
    return timejoin.nearest(*pair(spark, sf_dir), "user_id", 7200)


@register(
    "held_grid",
    f"""WITH {SENSOR_SQL}, g AS (SELECT user_id, unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-04', INTERVAL 1 HOUR)) AS ts FROM (SELECT DISTINCT user_id FROM s))
    SELECT g.user_id, g.ts, CASE WHEN epoch_us(g.ts) - epoch_us(s.ts) <= 10800000000 THEN s.value END AS value
    FROM g ASOF LEFT JOIN s ON g.user_id = s.user_id AND g.ts >= s.ts""",
)
def held_grid(spark, sf_dir):
    s, _ = pair(spark, sf_dir)
    spans = s.select("user_id").distinct().withColumn("lo", ntz("2024-01-02")).withColumn("hi", ntz("2024-01-04"))
    return timejoin.held_grid(s, spans, "user_id", 3600, 3)


@register(
    "aligned_roles",
    """WITH l AS (SELECT user_id, event_type AS role, epoch_us(ts) // 21600000000 AS b, arg_max(value, ts) AS v FROM events GROUP BY ALL),
    e AS (SELECT user_id, min(b) lo, max(b) hi FROM l GROUP BY 1), r AS (SELECT DISTINCT user_id, role FROM l),
    g AS (SELECT e.user_id, r.role, unnest(range(e.lo, e.hi + 1)) AS b FROM e JOIN r USING (user_id)),
    f AS (SELECT g.*, last_value(v IGNORE NULLS) OVER (PARTITION BY g.user_id, g.role ORDER BY g.b ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS v FROM g LEFT JOIN l USING (user_id, role, b))
    SELECT user_id, role, make_timestamp(b * 21600000000) AS ts, v FROM f WHERE v IS NOT NULL""",
)
def aligned_roles(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("role"), "ts", "value")
    return timejoin.aligned(e, "user_id", "role", 21600)


@register(
    "pivot_batch",
    """SELECT date_trunc('hour', ts) AS ts, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view,
    max(value) FILTER (event_type = 'purchase') AS purchase FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1""",
)
def pivot_batch(spark, sf_dir):
    """One column per point, one row per time."""
    e = table(spark, sf_dir, "events")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    wanted = ["click", "view", "purchase"]
    return e.where(F.col("event_type").isin(wanted)).groupBy(hour).pivot("event_type", wanted).agg(F.max("value"))


@register(
    "interval_join",
    """WITH i AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderdate AS lo, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS hi FROM orders),
    p AS (SELECT user_id AS k, event_id, ts - INTERVAL 9000 DAY + INTERVAL 8000 DAY - INTERVAL 7000 DAY + INTERVAL 500 DAY AS t FROM events WHERE event_type = 'error')
    SELECT p.event_id, i.id FROM p JOIN i USING (k) WHERE t >= lo AND (hi IS NULL OR t < hi)""",
)
def interval_join(spark, sf_dir):
    """Failures in the install interval that held at the time."""
    from pyspark.sql.window import Window

    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    intervals = o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("lo"), F.lead("o_orderdate").over(w).alias("hi"))
    points = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("k"), "event_id", F.expr("ts - INTERVAL 7500 DAY").alias("at"))
    return timejoin.in_interval(points, intervals, "k").select("event_id", "id")


@register(
    "run_state_diff",
    """WITH b AS (SELECT l_orderkey AS k, CASE min(l_returnflag) WHEN 'A' THEN 'fail' WHEN 'N' THEN 'pass' ELSE 'inconclusive' END AS was FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1),
    a AS (SELECT l_orderkey AS k, CASE min(l_returnflag) WHEN 'A' THEN 'fail' WHEN 'N' THEN 'pass' ELSE 'inconclusive' END AS now FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1)
    SELECT k, was, now, CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'gone' WHEN was = now AND now = 'fail' THEN 'still_failing' WHEN was = now AND now = 'pass' THEN 'still_passing'
      WHEN was = now THEN 'unchanged' WHEN now = 'pass' THEN 'resolved' WHEN now = 'fail' THEN 'regressed' ELSE 'changed' END AS change FROM b FULL JOIN a USING (k)""",
)
def run_state_diff(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    status = F.when(F.min("l_returnflag") == "A", "fail").when(F.min("l_returnflag") == "N", "pass").otherwise("inconclusive").alias("status")
    run = lambda rows: rows.groupBy(F.col("l_orderkey").alias("k")).agg(status)
    return timejoin.state_diff(run(li.where("l_linenumber <= 3")), run(li.where("l_linenumber >= 3")), "k")


@register(
    "edge_response",
    """WITH t AS (SELECT user_id, ts, CAST(value > 60 AS DOUBLE) AS v, lag(CAST(value > 60 AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM events WHERE event_type = 'click'),
    e AS (SELECT user_id, ts AS edge FROM t WHERE v = 1 AND was = 0)
    SELECT e.user_id, edge, round(max(r.value) - min(r.value), 6) AS swing, count(*) AS n FROM e JOIN events r ON r.user_id = e.user_id AND r.event_type = 'view'
      AND r.ts >= edge AND epoch_us(r.ts) - epoch_us(edge) <= 86400000000 GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def edge_response(spark, sf_dir):
    s, p = pair(spark, sf_dir)
    on = p.withColumn("value", (F.col("value") > 60).cast("double"))
    return timejoin.edge_response(on, s, "user_id", 1.0, 86400).select("user_id", "edge", r6("swing"), "n")


@register(
    "availability",
    f"""WITH {H}, v AS (SELECT point_uri, epoch_us(ts) AS t FROM h WHERE (value IS NOT NULL OR value_text IS NOT NULL OR value_bool IS NOT NULL) AND ts >= '2024-01-05' AND ts < '2024-01-25'),
    c AS (SELECT *, least(coalesce(lead(t) OVER (PARTITION BY point_uri ORDER BY t), epoch_us(TIMESTAMP '2024-01-25')) - t, 21600000000) AS c FROM v)
    SELECT point_uri, round(100 * least(sum(c) + least(min(t) - epoch_us(TIMESTAMP '2024-01-05'), 21600000000), 1728000000000) / 1728000000000.0, 2) AS pct FROM c GROUP BY 1""",
)
def availability(spark, sf_dir):
    h = history(spark, sf_dir).where("value is not null or value_text is not null or value_bool is not null")
    return windows.availability(h, "point_uri", "2024-01-05 00:00:00", "2024-01-25 00:00:00", 21600)


@register(
    "run_hours",
    f"""WITH {H}, n AS (SELECT point_uri, epoch_us(ts) AS t, coalesce(value_bool, value > 0.5, lower(value_text) IN ('on', 'true', 'run', 'running', 'active', 'start'), false) AS o FROM h),
    b AS (SELECT epoch_us(TIMESTAMP '2024-01-05') AS lo, epoch_us(TIMESTAMP '2024-01-25') AS hi),
    r AS (SELECT point_uri, t, o FROM n, b WHERE t >= lo AND t < hi UNION ALL SELECT point_uri, lo, arg_max(o, t) FROM n, b WHERE t < lo AND t >= lo - 21600000000 GROUP BY 1, 2),
    c AS (SELECT r.*, least(coalesce(lead(t) OVER (PARTITION BY point_uri ORDER BY t), hi) - t, 21600000000) AS held FROM r, b)
    SELECT point_uri, round(sum(CASE WHEN o THEN held ELSE 0 END) / 3.6e9, 6) AS hours FROM c GROUP BY 1""",
)
def run_hours(spark, sf_dir):
    return windows.run_hours(history(spark, sf_dir), "point_uri", "2024-01-05 00:00:00", "2024-01-25 00:00:00", 21600).select("point_uri", r6("hours"))


@register(
    "spikes",
    """WITH w AS (SELECT event_type, event_id, value, user_id, list(value) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) || list(value) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS n FROM events),
    m AS (SELECT *, list_median(n) AS m FROM w WHERE len(n) = 10),
    d AS (SELECT *, list_median(list_transform(n, lambda x: abs(x - m))) AS mad FROM m)
    SELECT event_type, event_id, value FROM d WHERE abs(value - m) > 6.0 * 1.4826 * greatest(mad, greatest(abs(m) * 0.001, 1e-6))""",
)
def spikes(spark, sf_dir):
    """Spikes of each point's own series."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "ts", "value", F.struct("user_id", "event_type").alias("point"))
    return windows.spikes(e, "point").select("event_type", "event_id", "value")


@register(
    "edge_detection",
    "SELECT user_id, ts FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM events) WHERE event_type = 'purchase' AND was <> 'purchase'",
)
def edge_detection(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_type").alias("value"))
    return windows.edges(e, "user_id", "purchase").select("user_id", "ts")


@register(
    "setpoint_edits",
    """SELECT user_id, ts, was, value FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM events WHERE event_type = 'click') WHERE was <> value AND ts >= '2024-01-10' AND ts < '2024-01-20'""",
)
def setpoint_edits(spark, sf_dir):
    _, p = pair(spark, sf_dir)
    return windows.edits(p, "user_id", ntz("2024-01-10"), ntz("2024-01-20")).select("user_id", "ts", "was", "value")


@register(
    "error_crossings",
    f"""WITH {SENSOR_SQL}, e AS (SELECT s.user_id, s.ts, s.value - p.value AS d FROM s ASOF JOIN p ON s.user_id = p.user_id AND s.ts >= p.ts),
    o AS (SELECT user_id, sign(d) AS side, lag(sign(d)) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM e WHERE abs(d) > 10)
    SELECT user_id, count(*) FILTER (was <> side) AS crossings FROM o GROUP BY 1""",
)
def error_crossings(spark, sf_dir):
    matched = timejoin.asof(*pair(spark, sf_dir), "user_id").where("match is not null")
    return windows.crossings(matched.withColumn("error", F.col("value") - F.col("match")), "user_id", 10.0)


@register(
    "step_holds",
    """WITH a AS (SELECT user_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM events WHERE event_type = 'click'),
    b AS (SELECT user_id, ts, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts)) / 1e6 AS held_s FROM a WHERE abs(value - was) >= 20)
    SELECT user_id, ts, round(held_s, 6) AS held_s FROM b WHERE held_s >= 7200""",
)
def step_holds(spark, sf_dir):
    _, p = pair(spark, sf_dir)
    return windows.holds(p, "user_id", 20, 7200).select("user_id", "ts", r6("held_s"))


INSTALL_SQL = """ev AS (SELECT o_custkey AS asset_id, o_orderkey AS id, o_orderdate AS t, CASE WHEN o_orderkey % 3 = 0 THEN 'remove' ELSE 'install' END AS kind, o_custkey % 40 AS position FROM orders),
    iv AS (SELECT asset_id, position, t AS lo, hi FROM (SELECT *, lead(t) OVER (PARTITION BY asset_id ORDER BY t, kind <> 'remove', id) AS hi FROM ev) WHERE kind = 'install')"""


def installs(spark, sf_dir):
    kind = F.when(F.col("o_orderkey") % 3 == 0, "remove").otherwise("install")
    o = table(spark, sf_dir, "orders")
    events = o.select(F.col("o_custkey").alias("asset_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), kind.alias("kind"), (F.col("o_custkey") % 40).alias("position"))
    return windows.install_intervals(events)


@register("install_intervals", f"WITH {INSTALL_SQL} SELECT * FROM iv")
def install_intervals(spark, sf_dir):
    return installs(spark, sf_dir)


@register("asset_at", f"WITH {INSTALL_SQL} SELECT position, max(asset_id) AS asset_id, count(*) AS n FROM iv WHERE lo <= '1998-06-01' AND (hi IS NULL OR hi > '1998-06-01') GROUP BY 1")
def asset_at(spark, sf_dir):
    at = ntz("1998-06-01")
    held = installs(spark, sf_dir).where((F.col("lo") <= at) & (F.col("hi").isNull() | (F.col("hi") > at)))
    return held.groupBy("position").agg(F.max("asset_id").alias("asset_id"), F.count("*").alias("n"))


@register(
    "replacements",
    f"WITH {INSTALL_SQL} SELECT position, previous, asset_id, lo AS \"at\" FROM (SELECT *, lag(asset_id) OVER (PARTITION BY position ORDER BY lo, asset_id) AS previous FROM (SELECT DISTINCT position, asset_id, lo FROM iv)) WHERE previous IS NOT NULL",
)
def replacements(spark, sf_dir):
    return windows.replacements(installs(spark, sf_dir).select("position", "asset_id", "lo").distinct())


RANGES_SQL = "r AS (SELECT l_suppkey AS k, l_shipdate AS lo, l_shipdate + INTERVAL 5 DAY AS hi FROM lineitem WHERE l_shipdate < '1996-07-01')"
MERGED_SQL = """w AS (SELECT *, max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
    m AS (SELECT k, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY lo, hi) AS i FROM w) GROUP BY k, i)"""


def ranges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") < ntz("1996-07-01"))
    return li.select(F.col("l_suppkey").alias("k"), F.col("l_shipdate").alias("lo"), F.expr("l_shipdate + INTERVAL 5 DAY").alias("hi"))


@register("merge_ranges", f"WITH {RANGES_SQL}, {MERGED_SQL} SELECT * FROM m")
def merge_ranges(spark, sf_dir):
    return windows.merge_ranges(ranges(spark, sf_dir), "k")


@register(
    "range_gaps",
    f"""WITH {RANGES_SQL}, {MERGED_SQL}, g AS (SELECT k, hi AS lo, coalesce(lead(lo) OVER (PARTITION BY k ORDER BY lo), TIMESTAMP '1996-07-01') AS hi FROM m
    UNION ALL SELECT k, TIMESTAMP '1995-01-01', min(lo) FROM m GROUP BY k) SELECT * FROM g WHERE lo < hi""",
)
def range_gaps(spark, sf_dir):
    return windows.gaps_in(ranges(spark, sf_dir), "k", ntz("1995-01-01"), ntz("1996-07-01"))


@register("rule_stale", f"WITH {H} SELECT point_uri, max(ts) AS newest FROM h GROUP BY 1 HAVING max(ts) <= TIMESTAMP '2024-01-31' - INTERVAL 4 DAY")
def rule_stale(spark, sf_dir):
    return rules.stale(history(spark, sf_dir), ntz("2024-01-31"), 4 * 86400)


@register(
    "rule_stuck",
    f"""WITH {H} SELECT point_uri, count(*) AS n FROM h WHERE {GOOD} AND ts >= '2024-01-20' AND (value IS NOT NULL OR value_text IS NOT NULL OR value_bool IS NOT NULL) GROUP BY 1
    HAVING count(DISTINCT coalesce('b' || value_bool, 't' || value_text, 'n' || value)) = 1""",
)
def rule_stuck(spark, sf_dir):
    return rules.stuck(history(spark, sf_dir), ntz("2024-01-20"))


@register("rule_range", f"WITH {H} SELECT point_uri, ts, value FROM h WHERE (value < 1 OR value > 200) AND point_uri GLOB 'urn:point:u1*/view'")
def rule_range(spark, sf_dir):
    h = history(spark, sf_dir).where(rules.glob_filter("point_uri", "urn:point:u1*/view"))
    return rules.out_of_range(h, 1, 200).select("point_uri", "ts", "value")


TURNED_SQL = "z.d <> 0 AND z.d * (e.value - z.best) < 0 AND z.d * (z.best - e.value) > 5"
MOVED_SQL = f"CASE WHEN z.d = 0 THEN abs(e.value - z.anchor) > 5 ELSE z.d * (e.value - z.best) >= 0 OR {TURNED_SQL} END"


@register(
    "rule_hunting",
    f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts, value) AS i FROM (SELECT event_type || '/' || CAST(user_id % 50 AS VARCHAR) AS series, ts, value FROM events)),
    z AS (SELECT series, i, value AS anchor, 0 AS d, value AS best, ts AS best_ts, CAST(NULL AS DOUBLE) AS turn, CAST(NULL AS TIMESTAMP) AS turn_ts FROM e WHERE i = 1
    UNION ALL SELECT e.series, e.i, z.anchor, CASE WHEN z.d = 0 AND abs(e.value - z.anchor) > 5 THEN CASE WHEN e.value > z.anchor THEN 1 ELSE -1 END WHEN {TURNED_SQL} THEN -z.d ELSE z.d END,
      CASE WHEN {MOVED_SQL} THEN e.value ELSE z.best END, CASE WHEN {MOVED_SQL} THEN e.ts ELSE z.best_ts END, CASE WHEN {TURNED_SQL} THEN z.best END, CASE WHEN {TURNED_SQL} THEN z.best_ts END
      FROM z JOIN e ON e.series = z.series AND e.i = z.i + 1),
    m AS (SELECT series, ts, abs(value - lag(value) OVER w) AS travel, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS gap FROM e WINDOW w AS (PARTITION BY series ORDER BY i)),
    s AS (SELECT series, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS hours, sum(travel) AS travel, median(gap) AS gap FROM m GROUP BY 1),
    t AS (SELECT series, abs(turn - lag(turn) OVER w) / 2 AS swing, (epoch_us(turn_ts) - lag(epoch_us(turn_ts)) OVER w) / 1e6 AS apart FROM z WHERE turn_ts IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY turn_ts, turn)),
    c AS (SELECT series, count(*) AS turns, median(apart) AS apart, median(swing) AS swing FROM t GROUP BY 1), j AS (SELECT *, n >= 10 AND hours > 0 AS judged FROM s LEFT JOIN c USING (series))
    SELECT series, judged, round(CASE WHEN judged THEN coalesce(turns, 0) / hours END, 6) AS rate, round(CASE WHEN judged THEN 2 * apart END, 6) AS period_s, round(CASE WHEN judged THEN swing END, 6) AS amplitude,
    round(CASE WHEN judged THEN travel / hours END, 6) AS travel_h, coalesce(judged AND coalesce(turns, 0) / hours > 0.5, false) AS fault FROM j""",
)
def rule_hunting(spark, sf_dir):
    """Reversals, period, amplitude and travel of every series."""
    e = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("/"), (F.col("user_id") % 50).cast("string")).alias("series"), "ts", "value")
    found = rules.hunting(e, "series", 5.0, 0.5, max_interval_s=1e9)
    return found.select("series", "judged", r6("rate"), r6("period_s"), r6("amplitude"), r6("travel_h"), "fault")


@register(
    "fault_intervals",
    """WITH f AS (SELECT user_id, ts, value > 60 AS bad FROM events WHERE event_type = 'view'),
    c AS (SELECT *, coalesce(lag(bad) OVER (PARTITION BY user_id ORDER BY ts), false) AS was FROM f)
    SELECT user_id, started_at, ended_at FROM (SELECT user_id, bad, ts AS started_at, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS ended_at FROM c WHERE bad <> was) WHERE bad""",
)
def fault_intervals(spark, sf_dir):
    s, _ = pair(spark, sf_dir)
    return rules.fault_intervals(s.select("user_id", "ts", (F.col("value") > 60).alias("bad")), "user_id")


@register(
    "fault_resolve",
    f"""WITH {H} SELECT DISTINCT point_uri FROM h WHERE ts < '2024-01-10' AND value > 100
    AND point_uri NOT IN (SELECT point_uri FROM h WHERE ts >= '2024-01-20' AND value > 100) AND point_uri NOT IN (SELECT point_uri FROM h WHERE ts >= '2024-01-28')""",
)
def fault_resolve(spark, sf_dir):
    h = history(spark, sf_dir)
    opened = h.where((F.col("ts") < ntz("2024-01-10")) & (F.col("value") > 100)).select("point_uri").distinct()
    return rules.resolvable(opened, h, h.where((F.col("ts") >= ntz("2024-01-20")) & (F.col("value") > 100)), h.where(F.col("ts") >= ntz("2024-01-28")))


@register(
    "plausible_range",
    """WITH p AS (SELECT 'urn:p' || p_partkey AS u, p_partkey % 6 AS c, CASE WHEN p_partkey % 2 = 0 THEN '°F' ELSE '°C' END AS unit FROM part)
    SELECT u AS point_uri, CAST(CASE c WHEN 0 THEN 32 WHEN 1 THEN -50 WHEN 2 THEN -40 WHEN 3 THEN 0 WHEN 4 THEN -60 END AS DOUBLE) AS lo,
    CAST(CASE c WHEN 0 THEN 120 WHEN 1 THEN 60 WHEN 2 THEN 200 WHEN 3 THEN 127 WHEN 4 THEN 300 END AS DOUBLE) AS hi FROM p WHERE c < 5""",
)
def plausible_range(spark, sf_dir):
    classes = ["Zone_Air_Temperature_Sensor", "Outside_Air_Temperature_Sensor", "Supply_Air_Temperature_Sensor", "Hot_Water_Temperature_Sensor", "Coil_Temperature_Sensor", "Occupancy_Sensor"]
    p = table(spark, sf_dir, "part")
    name = F.element_at(F.array(*map(F.lit, classes)), (F.col("p_partkey") % 6 + 1).cast("int"))
    unit = F.when(F.col("p_partkey") % 2 == 0, "°F").otherwise("°C")
    return q.plausible(p.select(F.concat(F.lit("urn:p"), F.col("p_partkey").cast("string")).alias("point_uri"), name.alias("brick_class"), unit.alias("unit")))


@register(
    "unit_suspects",
    f"""WITH {H} SELECT point_uri, count(value) AS n, round(median(value), 6) AS m FROM h GROUP BY 1
    HAVING count(value) >= 10 AND (median(value) < 60 OR median(value) > 120) AND avg(CAST(value BETWEEN 60 AND 120 AS INTEGER)) <= 0.9 AND min(value) >= 0 AND max(value) <= 250""",
)
def unit_suspects(spark, sf_dir):
    return q.unit_suspects(history(spark, sf_dir), F.lit(60), F.lit(120), F.lit(0), F.lit(250)).select("point_uri", "n", r6("m"))


@register(
    "quality_judge",
    f"""WITH {H}, su AS (SELECT point_uri FROM h GROUP BY 1 HAVING count(value) >= 10 AND (median(value) < 60 OR median(value) > 120) AND avg(CAST(value BETWEEN 60 AND 120 AS INTEGER)) <= 0.9 AND min(value) >= 0 AND max(value) <= 250),
    a AS (SELECT point_uri, ts, value, coalesce(quality, CASE WHEN value IS NOT NULL AND point_uri IN (FROM su) THEN 'unit_suspect' WHEN value IS NOT NULL AND NOT value BETWEEN 0.5 AND 300 THEN 'out_of_range' END) AS q FROM h),
    w AS (SELECT *, list(value) OVER (PARTITION BY point_uri ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) || list(value) OVER (PARTITION BY point_uri ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS n FROM a WHERE q IS NULL AND value IS NOT NULL),
    m AS (SELECT *, list_median(n) AS m FROM w WHERE len(n) = 10), d AS (SELECT *, list_median(list_transform(n, lambda x: abs(x - m))) AS mad FROM m),
    s AS (SELECT point_uri, ts FROM d WHERE abs(value - m) > 6.0 * 1.4826 * greatest(mad, greatest(abs(m) * 0.001, 1e-6)))
    SELECT coalesce(q, CASE WHEN s.ts IS NOT NULL THEN 'spike' END) AS quality, count(*) AS n FROM a LEFT JOIN s USING (point_uri, ts) GROUP BY 1""",
)
def quality_judge(spark, sf_dir):
    h = history(spark, sf_dir)
    suspects = q.unit_suspects(h, F.lit(60), F.lit(120), F.lit(0), F.lit(250))
    judged = q.judge(h.select("point_uri", "ts", "value", "quality"), suspects, 0.5, 300)
    return judged.groupBy("quality").agg(F.count("*").alias("n"))


@register(
    "input_masking",
    f"""WITH {H}, f AS (SELECT point_uri FROM h GROUP BY 1 HAVING max(ts) <= TIMESTAMP '2024-01-27') SELECT point_uri, count(*) AS n FROM h WHERE point_uri NOT IN (FROM f) GROUP BY 1""",
)
def input_masking(spark, sf_dir):
    h = history(spark, sf_dir)
    open_faults = rules.stale(h, ntz("2024-01-31"), 4 * 86400).select("point_uri", F.lit("stale").alias("rule"))
    ranged = h.where("value > 100").select("point_uri", F.lit("range").alias("rule"))
    return rules.masked_inputs(h, open_faults.unionByName(ranged)).groupBy("point_uri").agg(F.count("*").alias("n"))
