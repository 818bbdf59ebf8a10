"""Registered queries: list envelopes, binary states, overlays, evidence features, ranked groups, nested inventory, traces, acceptance."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantflow.functions import mapping
from plantflow.operators import derive, graph, verify, windows
from plantflow.plans.asset_queries import _drain, _events_stream
from plantflow.plans.history_queries import H, ntz, r6
from plantflow.plans.stream_queries import HISTORY, _scratch
from plantflow.registry import register
from plantflow.session import table
from plantflow.sources import history as hs
from plantflow.sources import pull as pulls
from plantflow.sources import upsert
from plantflow.sources.adapter import history
from plantflow.streaming import faults


@register(
    "expand_list",
    """SELECT 'urn:point:u' || user_id || '/' || k AS point_uri, CASE k WHEN 'a' THEN ts - INTERVAL 1 MINUTE ELSE ts END AS ts, CASE k WHEN 'a' THEN value ELSE CAST(event_id AS DOUBLE) END AS value, CASE k WHEN 'b' THEN 'fault' END AS quality
    FROM events, (SELECT unnest(['a', 'b']) AS k)""",
)
def expand_list(spark, sf_dir):
    """Envelopes with a list of points, some with a time of their own; a bad label is dropped."""
    item = lambda name, value, ts, quality: F.struct(F.lit(name).alias("point"), value.cast("double").alias("value"), ts.alias("ts"), F.lit(quality).cast("string").alias("quality"))
    none = F.lit(None).cast("timestamp_ntz")
    points = F.array(item("a", F.col("value"), F.col("ts") - F.expr("interval 1 minute"), None), item("b", F.col("event_id"), none, "fault"), item("bad label", F.col("value"), none, None), item("x/tags", F.col("value"), none, None))
    e = table(spark, sf_dir, "events")
    return hs.expand_list(e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("prefix"), "ts", points.alias("points")))


@register("binary_states", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS state FROM events")
def binary_states(spark, sf_dir):
    word = F.get(F.array(*map(F.lit, ("Active", "inactive", "unknown"))), (F.col("event_id") % 3).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", hs.binary_state(word).alias("state"))


@register(
    "label_overlay",
    f"""WITH {H}, l AS (SELECT point_uri, arg_max(unit, ts) AS unit, arg_max(label, ts) AS label FROM (SELECT * FROM h WHERE unit IS NOT NULL OR label IS NOT NULL) GROUP BY 1),
    l2 AS (SELECT DISTINCT ON (point_uri) point_uri, unit, label FROM h WHERE unit IS NOT NULL OR label IS NOT NULL ORDER BY point_uri, ts DESC),
    d AS (SELECT DISTINCT point_uri, CASE WHEN length(point_uri) % 2 = 0 THEN 'from tag' ELSE regexp_extract(point_uri, '[^/]*$') END AS dis, length(point_uri) % 2 = 0 AS tagged, CASE WHEN point_uri LIKE '%view' THEN 'kW' END AS unit FROM h)
    SELECT point_uri, CASE WHEN tagged OR coalesce(label, '') = '' THEN dis ELSE label END AS dis, coalesce(d.unit, l2.unit) AS unit FROM d LEFT JOIN l2 USING (point_uri)""",
)
def label_overlay(spark, sf_dir):
    """The history's unit and label only where the graph has none."""
    h = history(spark, sf_dir)
    even = F.length("point_uri") % 2 == 0
    dis = F.when(even, "from tag").otherwise(F.regexp_extract("point_uri", "([^/]*)$", 1))
    known = h.select("point_uri").distinct().select("point_uri", dis.alias("dis"), even.alias("dis_from_tag"), F.when(F.col("point_uri").endswith("view"), "kW").alias("unit"))
    return hs.overlay(known, hs.point_labels(h))


@register(
    "evidence_features",
    """WITH c AS (SELECT c_custkey AS k, 'AHU12' AS equip, 'SupTempSP' || (c_custkey % 3) AS leaf FROM customer),
    t AS (SELECT k, unnest(['w:sup', 'w:temp', 'w:sp', 'p:sup', 'p:tem', 'p:sp', 'e:ahu', 'm:' || 'zone', 'v:' || CASE WHEN k % 2 = 0 THEN 'bool' ELSE 'analog' END]) AS feature FROM c UNION ALL SELECT k, 'u:°C' FROM c WHERE k % 5 = 0)
    SELECT feature, count(*) AS n FROM t GROUP BY 1""",
)
def evidence_features(spark, sf_dir):
    """Words of labels such as AHU12/SupTempSP2 with their first letters, markers, unit and kind."""
    k = F.col("c_custkey")
    label = F.concat(F.lit("AHU12/SupTempSP"), (k % 3).cast("string"))
    found = mapping.evidence_tokens(label, F.array(F.lit("zone")), F.when(k % 5 == 0, "°C"), k % 2 == 0)
    return table(spark, sf_dir, "customer").select(F.explode(found).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))


@register(
    "review_tiers",
    """SELECT p_brand || '|' || p_type AS pattern, min(CASE WHEN p_partkey % 50 = 0 THEN 1 WHEN p_size = 7 THEN 2 ELSE 3 END) AS tier, count(*) AS count, count(*) FILTER (p_size % 4 = 0) AS escalated FROM part GROUP BY 1""",
)
def review_tiers(spark, sf_dir):
    """Held proposals by pattern: what a check needs first, then what is under commissioning."""
    p = table(spark, sf_dir, "part").withColumn("entity", F.col("p_partkey"))
    rows = p.select(F.concat_ws("|", "p_brand", "p_type").alias("pattern"), "entity", F.when(F.col("p_size") % 4 == 0, "escalated").otherwise("held").alias("status"))
    return mapping.ranked_groups(rows, p.where("p_partkey % 50 = 0").select("entity"), p.where("p_size = 7").select("entity"))


@register(
    "nested_inventory",
    """WITH q AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), x AS (SELECT l_suppkey, count(*) AS n, string_agg('urn:point:' || l_partkey || '=' || CASE WHEN l_partkey % 3 = 0 THEN '' ELSE p_brand END || '[' || CASE WHEN l_partkey % 2 = 0 THEN 'cmd,his' ELSE 'his' END || ']', ';' ORDER BY 'urn:point:' || l_partkey) AS points FROM q JOIN part ON p_partkey = l_partkey GROUP BY 1)
    SELECT 'urn:equip:' || s_suppkey AS equip, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE CAST(s_suppkey AS VARCHAR) END AS dis, 'AHU,Equip' AS classes, CASE WHEN s_suppkey % 3 = 0 THEN 'hot' ELSE '' END AS tags, coalesce(n, 0) AS n_points, coalesce(points, '') AS points FROM supplier LEFT JOIN x ON l_suppkey = s_suppkey""",
)
def nested_inventory(spark, sf_dir):
    """Suppliers as equipment with their parts as nested points, written out to compare."""
    s, li, p = (table(spark, sf_dir, t) for t in ("supplier", "lineitem", "part"))
    named = lambda kind, key: F.concat(F.lit(f"urn:{kind}:"), F.col(key).cast("string"))
    fact = lambda rows, field, value: rows.select(named("equip", "s_suppkey").alias("equip"), F.lit(field).alias("field"), value.alias("value"))
    equips = fact(s, "class", F.lit("Equip")).unionByName(fact(s, "class", F.lit("AHU"))).unionByName(fact(s.where("s_suppkey % 2 = 0"), "dis", F.col("s_name"))).unionByName(fact(s.where("s_suppkey % 3 = 0"), "tag", F.lit("hot")))
    pairs = li.select("l_suppkey", "l_partkey").distinct().join(p, F.col("l_partkey") == F.col("p_partkey"))
    tags = F.when(F.col("l_partkey") % 2 == 0, F.array(F.lit("his"), F.lit("cmd"))).otherwise(F.array(F.lit("his")))
    points = pairs.select(named("equip", "l_suppkey").alias("equip"), named("point", "l_partkey").alias("point"), F.when(F.col("l_partkey") % 3 != 0, F.col("p_brand")).alias("class"), tags.alias("tags"))
    written = F.transform("points", lambda x: F.concat(x["point"], F.lit("="), F.coalesce(x["class"], F.lit("")), F.lit("["), F.array_join(x["tags"], ","), F.lit("]")))
    found = graph.nested_inventory(equips, points)
    return found.select("equip", "dis", F.array_join("classes", ",").alias("classes"), F.array_join("tags", ",").alias("tags"), F.size("points").cast("long").alias("n_points"), F.array_join(written, ";").alias("points"))


@register(
    "derivation_trace",
    """WITH l AS (SELECT user_id, arg_max(value, ts) FILTER (event_type = 'view') AS a, arg_max(value, ts) FILTER (event_type = 'click') AS b, coalesce(bool_or(event_type = 'view' AND value > 95), false) AS bad FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-25' - INTERVAL 20 DAY AND '2024-01-25' GROUP BY 1)
    SELECT 't' || u.user_id AS target, round(a - b, 6) AS value, CASE WHEN coalesce(bad, false) THEN '' ELSE u.user_id || '/view' END || CASE WHEN coalesce(bad, false) THEN '' ELSE ',' END AS x, coalesce(bad, false) AS masked, a - b IS NOT NULL AND NOT coalesce(bad, false) AS would_write
    FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN l USING (user_id)""".replace("CASE WHEN coalesce(bad, false) THEN '' ELSE u.user_id || '/view' END || CASE WHEN coalesce(bad, false) THEN '' ELSE ',' END AS x", "u.user_id || '/click' || CASE WHEN coalesce(bad, false) THEN '' ELSE ',' || u.user_id || '/view' END AS would_derive_from"),
)
def derivation_trace(spark, sf_dir):
    """Dry run: what each target would be derived from, which input a fault masks, and whether it would be written."""
    e = table(spark, sf_dir, "events")
    point = F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type")
    ends = F.explode(F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("view"), F.lit("click")))).alias("name", "event_type")
    targets = e.select("user_id").distinct().select("user_id", ends).select(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("target"), "name", point.alias("point_uri"))
    now, window = ntz("2024-01-25"), 20 * 86400
    results = derive.evaluate(e.select(point.alias("point_uri"), "ts", "value"), targets, derive.last_difference, now, window, keep=1)
    inside = e.where((F.col("ts") <= now) & (F.col("ts") >= ntz("2024-01-05")) & (F.col("event_type") == "view") & (F.col("value") > 95))
    traced = derive.trace(results, targets, inside.select(point.alias("point_uri")).distinct())
    return traced.select("target", r6("value"), F.array_join("would_derive_from", ",").alias("would_derive_from"), (F.size("masked_inputs") > 0).alias("masked"), "would_write")


@register("dedup_stream", "SELECT DISTINCT event_type AS point_uri, date_trunc('day', ts) AS ts FROM events")
def dedup_stream(spark, sf_dir):
    """Structured Streaming: one reading of each point and time."""
    e = _events_stream(spark, sf_dir).select(F.col("event_type").alias("point_uri"), F.date_trunc("day", "ts").cast("timestamp").alias("ts"), "value")
    return _drain(faults.dedup_stream(e), spark).select("point_uri", F.col("ts").cast("timestamp_ntz").alias("ts"))


@register(
    "acceptance_run",
    """WITH r AS (SELECT user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'view' AND ts >= '2024-01-10 12:00:00' AND ts < '2024-01-25'), c AS (SELECT *, least(coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t), epoch_us(TIMESTAMP '2024-01-25')) - t, 21600000000) AS c FROM r),
    a AS (SELECT user_id, count(*) AS samples, round(100 * least(sum(c) + least(min(t) - epoch_us(TIMESTAMP '2024-01-10 12:00:00'), 21600000000), 1252800000000) / 1252800000000.0, 2) AS pct FROM c GROUP BY 1)
    SELECT u.user_id, coalesce(samples, 0) AS samples, CAST(58 AS BIGINT) AS expected, coalesce(pct, 0)::DOUBLE AS pct, coalesce(pct, 0) >= 20 AS passed FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN a USING (user_id)""",
)
def acceptance_run(spark, sf_dir):
    """Availability of every point over an acceptance run, judged twelve hours after its start."""
    e = table(spark, sf_dir, "events")
    return windows.acceptance(e.where("event_type = 'view'"), e, "user_id", "2024-01-10 00:00:00", "2024-01-25 00:00:00", 12 * 3600, 21600, 20.0)


@register(
    "error_samples",
    """WITH e AS (SELECT page_id, regexp_replace(url, '[0-9]+', ':id', 'g') AS route, 500 + page_id % 3 AS status, url FROM pages), c AS (SELECT route, status, url, count(*) AS n FROM e GROUP BY 1, 2, 3)
    SELECT e.route, e.status, count(*) AS n, min(page_id) AS first, max(page_id) AS last, (SELECT c.url FROM c WHERE c.route = e.route AND c.status = e.status ORDER BY n DESC, c.url LIMIT 1) AS top FROM e GROUP BY 1, 2""",
)
def error_samples(spark, sf_dir):
    """Errors by route and status with the first, the last and the most frequent address."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[0-9]+", ":id").alias("route"), (500 + F.col("page_id") % 3).alias("status"), "url")
    each = p.groupBy("route", "status", "url").agg(F.count("*").alias("n"), F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    top = F.min_by("url", F.struct(-F.col("n"), F.col("url")))
    return each.groupBy("route", "status").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), top.alias("top"))


@register("pull_resumed", "SELECT 'urn:point:sql/events/' || user_id || '-' || event_type AS point_uri, ts, max(value) AS value FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-25' GROUP BY 1, 2")
def pull_resumed(spark, sf_dir):
    """Two pulls of an external table, the second from where the first one's last commit ended."""
    from datetime import datetime

    e = table(spark, sf_dir, "events").select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("point"), "ts", "value")
    read = lambda since, until: e.where((F.col("ts") >= F.lit(since)) & (F.col("ts") < F.lit(until)))
    target = upsert.UpsertTable(spark, f"{_scratch(spark)}/pulled", HISTORY, ts_col=None, buckets=4)
    pulls.pull(target, "events", read, datetime(2024, 1, 12), backfill_s=7 * 86_400, window_s=5 * 86_400)
    pulls.pull(target, "events", read, datetime(2024, 1, 25), window_s=14 * 86_400)
    return target.snapshot().select("point_uri", "ts", "value")


@register(
    "live_tags",
    f"""WITH {H}, v AS (SELECT DISTINCT ON (point_uri) point_uri, value FROM h WHERE value IS NOT NULL OR value_text IS NOT NULL OR value_bool IS NOT NULL ORDER BY point_uri, ts DESC),
    l AS (SELECT DISTINCT ON (point_uri) point_uri, unit FROM h WHERE unit IS NOT NULL OR label IS NOT NULL ORDER BY point_uri, ts DESC)
    SELECT point_uri AS s FROM v LEFT JOIN l USING (point_uri) WHERE (point_uri LIKE '%view' AND value > 50 AND unit = '°F') OR (point_uri LIKE '%signup' AND NOT coalesce(value > 20 AND unit IS NULL, false))""",
)
def live_tags(spark, sf_dir):
    """(view and curVal > 50°F and curStatus == "ok") or (signup and his and not curVal > 20): live and graph tags in one filter."""
    h = history(spark, sf_dir)
    kind = F.regexp_extract("point_uri", "([^/]*)$", 1)
    none = F.lit(None)
    graph_tags = h.select("point_uri").distinct().select(F.col("point_uri").alias("s"), kind.alias("p"), F.lit("marker").alias("o_kind"), none.cast("string").alias("o"), none.cast("double").alias("num"), none.cast("string").alias("unit"))
    tag = graph.Tag
    wanted = (tag.has("view") & tag.number("curVal", ">", 50, "°F") & tag.text("curStatus", "ok")) | (tag.has("signup") & tag.has("his") & ~tag.number("curVal", ">", 20))
    return wanted.match(graph_tags.unionByName(hs.live_facts(h)))


@register(
    "export_check",
    """WITH c AS (SELECT event_type AS p, strftime(ts, '%Y-%m') AS m, count(*) AS n FROM (SELECT DISTINCT ON (event_type, ts) event_type, ts FROM events) GROUP BY 1, 2)
    SELECT p AS point_uri, m AS month, CASE p WHEN 'click' THEN 'rows differ' WHEN 'error' THEN 'not listed' END AS error FROM c WHERE p IN ('click', 'error')
    UNION ALL SELECT 'gone', '2024-01', 'missing' UNION ALL SELECT DISTINCT p, NULL, 'totals differ' FROM c WHERE p IN ('click', 'error') UNION ALL SELECT 'gone', NULL, 'totals differ'""",
)
def export_check(spark, sf_dir):
    """An export against lists that were tampered with: rows of one point, one left out, one that isn't there."""
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("point_uri"), "ts").agg(F.max("value").alias("value"))
    path = f"{_scratch(spark)}/export"
    hs.export_history(e, path)
    counts = e.groupBy("point_uri", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("rows"))
    wrong = F.when(F.col("point_uri") == "click", F.col("rows") + 1).otherwise(F.col("rows"))
    gone = spark.createDataFrame([("gone", "2024-01", 1)], "point_uri string, month string, rows long")
    listed = counts.where("point_uri <> 'error'").withColumn("rows", wrong).unionByName(gone)
    totals = counts.groupBy("point_uri").agg(F.sum("rows").alias("rows"), F.count("*").alias("files"))
    return hs.check_export(hs.export_files(spark, path), listed, totals, "point_uri string,ts timestamp[us],value double")


def spaces(spark, sf_dir):
    """Users as spaces of two types with their event types as points, and five requirement rows."""
    e = table(spark, sf_dir, "events")
    point = F.concat_ws("/", F.col("user_id").cast("string"), "event_type")
    rooms = e.select(F.col("user_id").alias("space"), F.when(F.col("user_id") % 2 == 0, "lab").otherwise("ward").alias("space_type")).distinct()
    points = e.select(F.col("user_id").alias("space"), point.alias("point"), F.col("event_type").alias("class")).distinct()
    rows = [("r1", "lab", "view", "between", 1.0, 200.0, 480.0, 0.1), ("r2", "lab", "reading", "<=", 250.0, None, 240.0, 0.05), ("r3", "ward", "click", ">", 0.5, None, 480.0, 0.9),
            ("r4", "ward", "reading", "<", 150.0, None, 100.0, 0.0), ("r5", "ward", None, ">", 1.0, None, 100.0, 0.0), ("r6", "lab", "nothing", ">", 1.0, None, 100.0, 0.0)]
    wanted = spark.createDataFrame(rows, "row string, space_type string, point_class string, op string, lo double, hi double, hours double, coverage double")
    family = spark.createDataFrame([("view", "reading"), ("click", "reading"), ("signup", "reading")], "class string, ancestor string")
    return wanted, rooms, points, family, e.select(point.alias("point"), "ts", "value"), ntz("2024-01-28")


SPACES = """q(r, space_type, cls, op, lo, hi, hours, cov) AS (VALUES ('r1', 'lab', 'view', 'between', 1, 200, 480, 10), ('r2', 'lab', 'reading', '<=', 250, NULL, 240, 5), ('r3', 'ward', 'click', '>', 0.5, NULL, 480, 90), ('r4', 'ward', 'reading', '<', 150, NULL, 100, 0), ('r5', 'ward', NULL, '>', 1, NULL, 100, 0), ('r6', 'lab', 'nothing', '>', 1, NULL, 100, 0)),
    w AS (SELECT user_id AS space, q.* FROM (SELECT DISTINCT user_id FROM events) JOIN q ON space_type = CASE WHEN user_id % 2 = 0 THEN 'lab' ELSE 'ward' END),
    p AS (SELECT DISTINCT user_id AS space, event_type AS k, event_type AS cls FROM events UNION SELECT DISTINCT user_id, event_type, 'reading' FROM events WHERE event_type IN ('view', 'click', 'signup')),
    j AS (SELECT w.*, p.k FROM w JOIN p ON p.space = w.space AND p.cls = w.cls),
    s AS (SELECT j.space, j.r, j.k, op, lo, hi, value, ts, epoch_us(ts) AS t, epoch_us(TIMESTAMP '2024-01-28') - hours * 3600000000 AS st, least(coalesce(lead(epoch_us(ts)) OVER (PARTITION BY j.space, r, k ORDER BY ts), epoch_us(TIMESTAMP '2024-01-28')) - epoch_us(ts), 21600000000) AS c,
      NOT CASE op WHEN 'between' THEN value BETWEEN lo AND hi WHEN '<=' THEN value <= lo WHEN '>' THEN value > lo WHEN '<' THEN value < lo END AS bad, abs(value - CASE op WHEN 'between' THEN (lo + hi) / 2 ELSE lo END::DOUBLE) AS far
      FROM j JOIN events e ON e.user_id = j.space AND e.event_type = j.k AND ts <= '2024-01-28' AND epoch_us(ts) >= epoch_us(TIMESTAMP '2024-01-28') - hours * 3600000000),
    a AS (SELECT space, r, k, count(*) AS samples, count(*) FILTER (bad) AS exceedances, min(value) AS low, max(value) AS high, min(ts) FILTER (bad) AS first, max(ts) FILTER (bad) AS last, arg_min(value, (-far, ts)) FILTER (bad) AS worst, sum(c) + least(min(t) - min(st), 21600000000) AS covered FROM s GROUP BY 1, 2, 3),
    e AS (SELECT j.space, j.r AS row, j.space || '/' || j.k AS point, coalesce(samples, 0) AS samples, coalesce(exceedances, 0) AS exceedances, round(100 * least(coalesce(covered, 0), hours * 3600000000) / (hours * 3600000000.0), 2)::DOUBLE AS coverage_pct, low, high, first, last, worst, cov FROM j LEFT JOIN a ON a.space = j.space AND a.r = j.r AND a.k = j.k),
    g AS (SELECT *, CASE WHEN exceedances > 0 THEN 'fail' WHEN coverage_pct < cov THEN 'inconclusive' ELSE 'pass' END AS status FROM e)"""


@register("space_compliance", f"WITH {SPACES} SELECT w.space, w.r AS row, CASE WHEN bool_or(g.status = 'fail') THEN 'fail' WHEN coalesce(bool_or(g.status = 'inconclusive'), true) THEN 'inconclusive' ELSE 'pass' END AS status, count(g.point) AS points FROM w LEFT JOIN g ON g.space = w.space AND g.row = w.r GROUP BY 1, 2")
def space_compliance(spark, sf_dir):
    """Each requirement that applies to each space, by all of the space's points of its class."""
    return verify.space_compliance(*spaces(spark, sf_dir), gap_s=21600)[0]


@register("compliance_points", f"WITH {SPACES} SELECT space, row, point, samples, exceedances, coverage_pct, low, high, first, last, worst, status FROM g")
def compliance_points(spark, sf_dir):
    """Evidence of each judged point: samples, exceedances with first, last and worst, coverage."""
    return verify.space_compliance(*spaces(spark, sf_dir), gap_s=21600)[1]
