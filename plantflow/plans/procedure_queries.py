"""Registered queries: criteria of procedures, reports by class, review candidates, manifests, snippets, watches."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantflow.functions import mapping
from plantflow.operators import graph, procedures
from plantflow.plans.domain_queries import UP_SQL
from plantflow.plans.evidence_queries import named
from plantflow.plans.history_queries import ntz, r6
from plantflow.registry import register
from plantflow.session import table
from plantflow.sources import history as hs
from plantflow.sources.adapter import containment
from plantflow.streaming import faults

CRITERIA = "criterion string, point_class string, point string, required boolean"
TOTALS = "count(*) FILTER (st = 'pass') AS n_pass, count(*) FILTER (st = 'fail') AS n_fail, count(*) FILTER (st = 'inconclusive') AS n_inconclusive"
WORST = "CASE WHEN count(*) FILTER (st = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (st = 'inconclusive') > 0 THEN 'inconclusive' WHEN count(*) FILTER (st = 'pass') > 0 THEN 'pass'"


def users_as_equipment(spark, sf_dir):
    """(equips, points, samples, family): users with temperatures in two units and a status."""
    e = table(spark, sf_dir, "events").where("event_type in ('view', 'purchase', 'click')")
    point = F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type")
    kind = F.when(F.col("event_type") == "view", "Supply_Temp").when(F.col("event_type") == "purchase", "Zone_Temp").otherwise("Run_Status")
    unit = F.when(F.col("event_type") == "view", "°F").when(F.col("event_type") == "purchase", "°C")
    points = e.select(F.col("user_id").alias("equip"), point.alias("point_uri"), kind.alias("class"), unit.alias("unit")).distinct()
    family = spark.createDataFrame([("supply_temp", "temp"), ("zone_temp", "temp")], "class string, ancestor string")
    equips = table(spark, sf_dir, "events").select(F.col("user_id").alias("equip")).distinct()
    return equips, points, e.select(point.alias("point_uri"), "ts", "value", "event_type"), family


def applied(equips, criteria):
    return equips.join(F.broadcast(criteria.select("criterion")))  # a handful of criteria


RANGES_SQL = f"""t AS (SELECT user_id AS equip, event_type, 'r1' AS criterion, true AS inside, value, CASE event_type WHEN 'view' THEN 0.5 ELSE (0.5 - 32) * 5 / 9 END AS lo, CASE event_type WHEN 'view' THEN 300.0 ELSE (300.0 - 32) * 5 / 9 END AS hi FROM events WHERE event_type IN ('view', 'purchase')
      UNION ALL SELECT user_id, event_type, 'r2', isodow(l) <= 5 AND hour(l) >= 8 AND hour(l) < 18, value, NULL, 90.0 FROM (SELECT *, timezone('America/Chicago', timezone('UTC', ts)) AS l FROM events) WHERE event_type = 'view'),
    p AS (SELECT equip, criterion, event_type, CASE WHEN count(*) FILTER (inside) = 0 THEN 'inconclusive' WHEN bool_or(inside AND (value < lo OR value > hi)) THEN 'fail' WHEN event_type = 'view' AND equip % 3 = 0 THEN 'inconclusive' ELSE 'pass' END AS st FROM t GROUP BY 1, 2, 3),
    u AS (SELECT DISTINCT user_id AS equip FROM events), c AS (SELECT equip, unnest(['r1', 'r2', 'r3', 'r4']) AS criterion FROM u),
    f AS (SELECT criterion, equip, {TOTALS}, {WORST} WHEN criterion = 'r3' THEN 'inconclusive' ELSE 'not_applicable' END AS status FROM c LEFT JOIN p USING (equip, criterion) GROUP BY 1, 2)"""


def ranges(spark, sf_dir):
    equips, points, samples, family = users_as_equipment(spark, sf_dir)
    hours = ("America/Chicago", [0, 1, 2, 3, 4], 8, 18)
    free = (None, None, None, None)
    rows = [("r1", "Temp", None, False, 0.5, 300.0, "F", *free), ("r2", "supply_temp", None, False, None, 90.0, None, *hours), ("r3", "Pump", None, True, 0.0, 1.0, None, *free), ("r4", "Pump", None, False, 0.0, 1.0, None, *free)]
    criteria = spark.createDataFrame(rows, f"{CRITERIA}, lo double, hi double, unit string, zone string, days array<int>, from_hour int, to_hour int")
    applies = applied(equips, criteria)
    aims = procedures.targets(applies, criteria, points, family)
    truncated = points.where("class = 'Supply_Temp' and equip % 3 = 0").select("point_uri")
    return procedures.fold(applies, criteria, procedures.judge_range(aims, criteria, samples, truncated))


@register("procedure_ranges", f"WITH {RANGES_SQL} SELECT * FROM f")
def procedure_ranges(spark, sf_dir):
    """Ranges by class with units turned, in working hours, on truncated reads, and on classes that aren't there."""
    return ranges(spark, sf_dir)


@register(
    "procedure_results",
    f"""WITH {RANGES_SQL}, s AS (SELECT equip, CASE WHEN criterion IN ('r1', 'r2') THEN 'a' ELSE 'b' END AS step, status AS st FROM f), g AS (SELECT equip, step, {WORST} ELSE 'not_applicable' END AS st FROM s GROUP BY 1, 2)
    SELECT equip, step, st AS status FROM g UNION ALL SELECT equip, NULL, {WORST} ELSE 'not_applicable' END FROM g GROUP BY 1""",
)
def procedure_results(spark, sf_dir):
    """Criteria folded into two steps, steps into the procedure."""
    steps = spark.createDataFrame([("r1", "a"), ("r2", "a"), ("r3", "b"), ("r4", "b")], "criterion string, step string")
    return procedures.procedure_results(ranges(spark, sf_dir), steps)


@register(
    "procedure_availability",
    """WITH a AS (SELECT * FROM (VALUES ('a1', 'view', 43200, 20.0), ('a1', 'purchase', 43200, 20.0), ('a2', 'click', 259200, 60.0)) AS t(criterion, event_type, gap, least_pct)),
    x AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('view', 'purchase', 'click')), b AS (SELECT epoch_us(TIMESTAMP '2024-01-05') AS lo, epoch_us(TIMESTAMP '2024-01-25') AS hi),
    v AS (SELECT user_id, event_type, epoch_us(ts) AS t, coalesce(lead(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts), hi) - epoch_us(ts) AS held FROM events, b WHERE epoch_us(ts) >= lo AND epoch_us(ts) < hi),
    s AS (SELECT user_id, event_type, criterion, sum(least(held, gap * 1000000::BIGINT)) + least(min(t) - any_value(lo), any_value(gap) * 1000000::BIGINT) AS cover FROM v JOIN a USING (event_type), b GROUP BY ALL)
    SELECT criterion, user_id AS equip, user_id || '/' || event_type AS point_uri, round(100 * least(coalesce(cover, 0), hi - lo) / (hi - lo), 2) AS pct, CASE WHEN round(100 * least(coalesce(cover, 0), hi - lo) / (hi - lo), 2) + 1e-9 < least_pct THEN 'fail' ELSE 'pass' END AS status
    FROM x JOIN a USING (event_type) LEFT JOIN s USING (user_id, event_type, criterion), b""",
)
def procedure_availability(spark, sf_dir):
    """Each criterion has its own gap and needed share."""
    equips, points, samples, family = users_as_equipment(spark, sf_dir)
    criteria = spark.createDataFrame([("a1", "Temp", None, False, 43200.0, 20.0), ("a2", "Run_Status", None, False, 259200.0, 60.0)], f"{CRITERIA}, max_gap_s double, min_pct double")
    aims = procedures.targets(applied(equips, criteria), criteria, points, family)
    none = points.where("false").select("point_uri")
    return procedures.judge_availability(aims, criteria, samples, ntz("2024-01-05"), ntz("2024-01-25"), none)


@register(
    "procedure_response",
    """WITH b AS (SELECT user_id AS equip, ts, value > 60 AS o FROM events WHERE event_type = 'click'), e AS (SELECT equip, ts AS edge FROM (SELECT *, lag(o) OVER (PARTITION BY equip ORDER BY ts) AS was FROM b) WHERE o AND NOT was),
    x AS (SELECT DISTINCT user_id AS equip, event_type FROM events WHERE event_type IN ('view', 'purchase')), u AS (SELECT DISTINCT user_id AS equip FROM events),
    m AS (SELECT e.equip, edge, x.event_type, count(v.value) AS n, max(v.value) - min(v.value) AS moved FROM e JOIN x USING (equip) LEFT JOIN events v ON v.user_id = e.equip AND v.event_type = x.event_type AND v.ts >= edge AND epoch_us(v.ts) <= epoch_us(edge) + 259200000000 GROUP BY ALL),
    c AS (SELECT equip, count(*) FILTER (n >= 2 AND moved + 1e-9 >= 5) AS ok, count(*) AS n FROM m GROUP BY 1)
    SELECT 's1' AS criterion, equip, coalesce(ok, 0) AS n_pass, coalesce(n - ok, 0) AS n_fail, CASE WHEN n IS NULL AND equip IN (SELECT equip FROM b) AND equip IN (SELECT equip FROM x) THEN 1 ELSE 0 END AS n_inconclusive,
    CASE WHEN equip NOT IN (SELECT equip FROM b) OR equip NOT IN (SELECT equip FROM x) THEN 'not_applicable' WHEN n IS NULL THEN 'inconclusive' WHEN ok < n THEN 'fail' ELSE 'pass' END AS status FROM u LEFT JOIN c USING (equip)""",
)
def procedure_response(spark, sf_dir):
    """When a user's status turns on, both temperatures must move within three days."""
    equips, points, samples, family = users_as_equipment(spark, sf_dir)
    rule = "equals double, changes_by double, within_s long"
    whens, thens = (spark.createDataFrame([("s1", kind, None, False, 1.0, 5.0, 259200)], f"{CRITERIA}, {rule}") for kind in ("Run_Status", "Temp"))
    states = samples.withColumn("value", F.when(F.col("event_type") == "click", (F.col("value") > 60).cast("double")).otherwise(F.col("value")))
    applies = applied(equips, whens)
    sides = [procedures.targets(applies, side, points, family) for side in (whens, thens)]
    return procedures.fold(applies, whens, procedures.judge_response(*sides, whens, states))


@register(
    "procedure_checks",
    f"""WITH r AS (SELECT l_suppkey AS equip, CASE l_returnflag WHEN 'A' THEN 'rule:range' WHEN 'R' THEN 'rule:stuck' ELSE 'rules' END AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'high' ELSE 'low' END AS grade,
      CASE WHEN l_quantity > 49 AND l_discount > 0.08 THEN 'fail' WHEN l_quantity > 49 THEN 'inconclusive' ELSE 'pass' END AS st FROM lineitem),
    p AS (SELECT equip, 'k1' AS criterion, st FROM r WHERE id LIKE 'rule:%' UNION ALL SELECT equip, 'k2', CASE st WHEN 'inconclusive' THEN 'fail' ELSE st END FROM r WHERE id = 'rule:stuck' AND grade = 'high'),
    c AS (SELECT s_suppkey AS equip, unnest(['k1', 'k2']) AS criterion FROM supplier) SELECT criterion, equip, {TOTALS}, {WORST} WHEN criterion = 'k2' THEN 'inconclusive' ELSE 'not_applicable' END AS status FROM c LEFT JOIN p USING (equip, criterion) GROUP BY 1, 2""",
)
def procedure_checks(spark, sf_dir):
    """Results of checks by id, those below it, severity and strictness."""
    li = table(spark, sf_dir, "lineitem")
    flag, many = F.col("l_returnflag"), F.col("l_quantity") > 49
    check = F.when(flag == "A", "rule:range").when(flag == "R", "rule:stuck").otherwise("rules")
    status = F.when(many & (F.col("l_discount") > 0.08), "fail").when(many, "inconclusive").otherwise("pass")
    results = li.select(F.col("l_suppkey").alias("equip"), check.alias("check"), F.when(F.col("l_linenumber") % 2 == 0, "high").otherwise("low").alias("severity"), status.alias("status"))
    criteria = spark.createDataFrame([("k1", None, None, False, "rule", None, False), ("k2", None, None, True, "rule:stuck", "high", True)], f"{CRITERIA}, check string, severity string, strict boolean")
    applies = applied(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("equip")), criteria)
    return procedures.fold(applies, criteria, procedures.judge_checks(criteria, results))


GUESS_SQL = f"""{UP_SQL}, r AS (SELECT 'urn:nation:' || c_nationkey AS truth, CASE c_custkey % 4 WHEN 0 THEN 'urn:region:' || n_regionkey WHEN 1 THEN 'urn:nation:' || ((c_nationkey + 1) % 25) WHEN 2 THEN NULL ELSE 'urn:nation:' || c_nationkey END AS predicted FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


@register(
    "class_report",
    f"""WITH RECURSIVE {GUESS_SQL}, s AS (SELECT truth AS class, count(*) AS support, count(*) FILTER (predicted = truth) AS hit FROM r GROUP BY 1), p AS (SELECT predicted AS class, count(*) AS predicted, count(*) FILTER (predicted = truth) AS hit FROM r WHERE predicted IS NOT NULL GROUP BY 1)
    SELECT class, coalesce(support, 0) AS support, coalesce(p.predicted, 0) AS predicted, round(p.hit / p.predicted, 3) AS precision, round(s.hit / support, 3) AS recall FROM s FULL JOIN p USING (class)""",
)
def class_report(spark, sf_dir):
    """Support, precision and recall by class; points without a prediction count for recall alone."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    c = table(spark, sf_dir, "customer").join(nations, "c_nationkey").withColumn("other", (F.col("c_nationkey") + 1) % 25)
    truth, turn = named("urn:nation:", "c_nationkey"), F.col("c_custkey") % 4
    guess = F.when(turn == 0, named("urn:region:", "n_regionkey")).when(turn == 1, named("urn:nation:", "other")).when(turn == 3, truth)
    judged = mapping.verdicts(c.select(truth.alias("truth"), guess.alias("predicted")), graph.closure(containment(spark, sf_dir), reflexive=False))
    return mapping.class_report(judged)


@register(
    "review_top",
    """WITH r AS (SELECT c_custkey AS id, c_nationkey AS t, [(c_nationkey + c_custkey % 5) % 25, (c_nationkey + 3) % 25, c_nationkey, (c_nationkey + 1) % 25] AS k FROM customer)
    SELECT count(*) AS reviewed, round(count(*) FILTER (k[1] = t) / count(*), 3) AS top1, round(count(*) FILTER (list_contains(k[1:3], t)) / count(*), 3) AS top3 FROM r""",
)
def review_top(spark, sf_dir):
    """How often the true class is among the first one and three that a reviewer is shown."""
    key, at = F.col("c_custkey"), F.col("c_nationkey")
    name = lambda n: F.concat(F.lit("urn:nation:"), (n % 25).cast("string"))
    rows = table(spark, sf_dir, "customer").select(key.alias("id"), name(at).alias("truth"), F.array(name(at + key % 5), name(at + 3), name(at), name(at + 1)).alias("candidates"))
    return mapping.review_top(rows, graph.closure(containment(spark, sf_dir), reflexive=False))


@register(
    "manifest_check",
    """SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'not listed' ELSE 'sha256 differs' END AS error FROM documents
    WHERE (doc_id % 13 = 0 OR doc_id % 11 = 0 OR doc_id % 7 = 0) AND NOT (doc_id % 13 = 0 AND doc_id % 11 = 0) AND text IS NOT NULL""",
)
def manifest_check(spark, sf_dir):
    """Texts as files against a list of their sums: some are gone, some not listed, some changed."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    listed = d.where("doc_id % 11 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 7 == 0, F.lit("0")).otherwise(F.col("sha256")))
    return hs.check_manifest(listed, d.where("doc_id % 13 <> 0"))


@register(
    "search_snippets",
    r"""WITH d AS (SELECT doc_id, text, lower(text) AS low FROM documents), h AS (SELECT doc_id, text, (length(low) - length(replace(low, 'the', ''))) // 3 + (length(low) - length(replace(low, 'of', ''))) // 2 AS score,
      greatest(0, least(instr(low, 'the'), instr(low, 'of')) - 1 - 80) AS start FROM d WHERE contains(low, 'the') AND contains(low, 'of'))
    SELECT doc_id, CAST(score AS BIGINT) AS score, CASE WHEN start > 0 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, start + 1, 240), '\s+', ' ', 'g')) || CASE WHEN start + 240 < length(text) THEN '…' ELSE '' END AS snippet FROM h ORDER BY score DESC, doc_id LIMIT 200""",
)
def search_snippets(spark, sf_dir):
    """Documents that hold all terms, by occurrences, each with the text around the first of them."""
    hits = mapping.search(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["the", "of"])
    return hits.select("doc_id", "score", mapping.snippet(F.col("text"), ["the", "of"], 240).alias("snippet"))


@register(
    "watch_poll",
    """WITH w AS (SELECT s_suppkey AS watch, TIMESTAMP '2024-01-20' - to_hours(CAST(s_suppkey % 5 AS INTEGER)) AS polled FROM supplier), l AS (SELECT watch FROM w WHERE polled + INTERVAL 150 MINUTE > TIMESTAMP '2024-01-20')
    SELECT l_suppkey AS watch, CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS record FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) JOIN l ON l_suppkey = watch JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 3 <> 0 OR o_orderstatus <> 'O'""",
)
def watch_poll(spark, sf_dir):
    """Suppliers watch the orders of their lines: polls return what changed, expired watches nothing."""
    watches = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("watch"), (ntz("2024-01-20") - F.make_dt_interval(hours=F.col("s_suppkey").cast("int") % 5)).alias("polled"), F.lit(9000.0).alias("lease_s"))
    ids = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("watch"), F.col("l_orderkey").cast("string").alias("id")).distinct()
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("record"), "o_orderkey")
    sent = ids.join(records.where("o_orderkey % 3 = 0"), "id").select("watch", "id", F.lit("O").alias("record"))
    return faults.poll(watches, ids, records.select("id", "record"), sent, ntz("2024-01-20"))
