"""Registered queries: hunting loops with onset, and what changed around it."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantflow.operators import loops
from plantflow.plans.history_queries import ntz
from plantflow.registry import register
from plantflow.session import table

LIMITS = loops.Limits(ratio=1.2, least_rate=0.05, floor=0.01, command_deadband=20.0, error_deadband=20.0, min_samples=2, max_interval_s=1e9, hours=48.0)


def plant(spark, sf_dir):
    """Loops of users that share a number: views are the sensor, clicks the setpoint in steps of 25, purchases and signups commands."""
    e = table(spark, sf_dir, "events").where("event_type <> 'error'").withColumn("loop", (F.col("user_id") % 25).cast("string"))
    point = F.concat_ws("/", "loop", "event_type")
    value = F.when(F.col("event_type") == "click", F.floor(F.col("value") / 25) * 25).otherwise(F.col("value"))
    samples = e.select(point.alias("point"), "ts", value.alias("value"))
    role = F.when(F.col("event_type") == "view", "sensor").when(F.col("event_type") == "click", "setpoint").otherwise("command")
    members = e.select("loop", role.alias("role"), point.alias("point")).distinct()
    # Every third loop has no baseline.
    base = e.select("loop").distinct().where(F.col("loop").cast("int") % 3 > 0).select("loop", ntz("2024-01-05").alias("lo"), ntz("2024-01-10").alias("hi"))
    return samples, members, base, ntz("2024-01-28")


LOOPS = """e AS (SELECT CAST(user_id % 25 AS VARCHAR) AS loop, event_type, ts, CASE WHEN event_type = 'click' THEN floor(value / 25) * 25 ELSE value END AS v FROM events WHERE event_type <> 'error'),
    p AS (SELECT *, 'now' AS win FROM e WHERE ts BETWEEN TIMESTAMP '2024-01-28' - INTERVAL 48 HOUR AND '2024-01-28' UNION ALL SELECT *, 'base' FROM e WHERE CAST(loop AS INTEGER) % 3 > 0 AND ts >= '2024-01-05' AND ts < '2024-01-10'
      UNION ALL SELECT e.*, CAST(d AS VARCHAR) FROM e JOIN (SELECT unnest(range(7)) AS d) ON ts >= TIMESTAMP '2024-01-28' - to_days(CAST(d + 1 AS INTEGER)) AND ts < TIMESTAMP '2024-01-28' - to_days(CAST(d AS INTEGER))),
    c AS (SELECT *, row_number() OVER (PARTITION BY loop, win, event_type ORDER BY ts, v) AS i FROM p WHERE event_type NOT IN ('view', 'click')),
    z AS (SELECT loop, win, event_type, i, v AS anchor, 0 AS d, v AS best, 0 AS turn FROM c WHERE i = 1
      UNION ALL SELECT c.loop, c.win, c.event_type, c.i, anchor, CASE WHEN d = 0 AND abs(c.v - anchor) > 20 THEN CASE WHEN c.v > anchor THEN 1 ELSE -1 END WHEN d <> 0 AND d * (best - c.v) > 20 THEN -d ELSE d END,
        CASE WHEN (d = 0 AND abs(c.v - anchor) > 20) OR (d <> 0 AND (d * (c.v - best) >= 0 OR d * (best - c.v) > 20)) THEN c.v ELSE best END, CASE WHEN d <> 0 AND d * (best - c.v) > 20 THEN 1 ELSE 0 END
        FROM z JOIN c ON c.loop = z.loop AND c.win = z.win AND c.event_type = z.event_type AND c.i = z.i + 1),
    h AS (SELECT loop, win, event_type, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS hours FROM c GROUP BY 1, 2, 3),
    t AS (SELECT loop, win, event_type, sum(turn) AS turns FROM z GROUP BY 1, 2, 3),
    w AS (SELECT loop, win, max(round(turns / hours, 2)) AS worst FROM h JOIN t USING (loop, win, event_type) WHERE n >= 2 AND hours > 0 GROUP BY 1, 2),
    er AS (SELECT s.loop, s.win, s.ts, s.v - x.v AS err FROM (SELECT * FROM p WHERE event_type = 'view') s ASOF JOIN (SELECT loop, win, ts, max(v) AS v FROM p WHERE event_type = 'click' GROUP BY 1, 2, 3) x ON s.loop = x.loop AND s.win = x.win AND s.ts >= x.ts),
    sd AS (SELECT loop, win, sign(err) AS side, lag(sign(err)) OVER (PARTITION BY loop, win ORDER BY ts) AS was FROM er WHERE abs(err) > 20),
    eh AS (SELECT loop, win, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS hours FROM er GROUP BY 1, 2 HAVING count(*) >= 2 AND max(ts) > min(ts)),
    ex AS (SELECT eh.loop, eh.win, round(coalesce(x, 0) / hours, 2) AS rate FROM eh LEFT JOIN (SELECT loop, win, count(*) FILTER (was <> side) AS x FROM sd GROUP BY 1, 2) USING (loop, win)),
    r AS (SELECT loop, win, coalesce(w.worst, ex.rate) AS rate FROM w FULL JOIN ex USING (loop, win)),
    b AS (SELECT l.loop, n.rate, b.rate AS base, greatest(coalesce(b.rate * 1.2::DOUBLE, 0.05::DOUBLE), 0.01::DOUBLE) AS lim FROM (SELECT DISTINCT loop FROM e) l LEFT JOIN r n ON n.loop = l.loop AND n.win = 'now' LEFT JOIN r b ON b.loop = l.loop AND b.win = 'base'),
    q AS (SELECT b.loop, min(d) FILTER (coalesce(r.rate, -1) <= lim) AS quiet FROM b JOIN (SELECT unnest(range(7)) AS d) ON true LEFT JOIN r ON r.loop = b.loop AND r.win = CAST(d AS VARCHAR) GROUP BY 1),
    f AS (SELECT b.loop, rate, base, CASE WHEN base IS NOT NULL AND rate IS NOT NULL THEN round(rate / greatest(base, 1), 2) END AS ratio, round(lim, 2) AS threshold, CASE WHEN rate IS NULL THEN 'inconclusive' WHEN rate > lim THEN 'hunting' ELSE 'steady' END AS verdict,
      CASE WHEN rate > lim AND coalesce(quiet, 7) > 0 THEN TIMESTAMP '2024-01-28' - to_days(CAST(coalesce(quiet, 7) AS INTEGER)) END AS onset FROM b JOIN q USING (loop))"""


@register("loop_onset", f"WITH RECURSIVE {LOOPS} SELECT * FROM f")
def loop_onset(spark, sf_dir):
    """Rate now and at the baseline, verdict and first day of the run above the threshold."""
    return loops.report(*plant(spark, sf_dir), LIMITS)


@register(
    "loop_causes",
    f"""WITH RECURSIVE {LOOPS}, k AS (SELECT loop, onset - INTERVAL 1 DAY AS lo, least(TIMESTAMP '2024-01-28', onset + INTERVAL 1 DAY) AS hi FROM f WHERE onset IS NOT NULL),
    s AS (SELECT k.loop, ts, v, lag(v) OVER (PARTITION BY k.loop ORDER BY ts, v) AS was, lo FROM k JOIN e ON e.loop = k.loop AND event_type = 'click' AND ts >= lo - INTERVAL 1 DAY AND ts < hi)
    SELECT loop, ts AS "at", 'setpoint_edit' AS kind, was, v AS value, CAST(NULL AS VARCHAR) AS detail FROM s WHERE ts >= lo AND was <> v
    UNION ALL SELECT k.loop, x.ts, 'asset_error', NULL, NULL, CAST(x.event_id AS VARCHAR) FROM k JOIN events x ON x.event_type = 'error' AND CAST(x.user_id % 25 AS VARCHAR) = k.loop AND x.ts >= lo AND x.ts < hi""",
)
def loop_causes(spark, sf_dir):
    """Setpoint edits and errors within a day of each onset."""
    samples, members, base, now = plant(spark, sf_dir)
    errors = table(spark, sf_dir, "events").where("event_type = 'error'")
    events = errors.select((F.col("user_id") % 25).cast("string").alias("loop"), F.col("ts").alias("at"), F.lit("error").alias("kind"), F.col("event_id").cast("string").alias("detail"))
    return loops.causes(loops.report(samples, members, base, now, LIMITS), samples, members, events, now)
