"""Registered queries: scalar functions, scopes, set operations, folds and reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantflow.functions import mapping, scalars
from plantflow.operators import rollup
from plantflow.plans.history_queries import FOLD, H, folds, ntz, r6, rollup_sql
from plantflow.registry import register
from plantflow.session import table
from plantflow.sources import history as hs
from plantflow.sources.adapter import history, tags


@register("numeric_coercion", f"WITH {H} SELECT point_uri, ts, coalesce(CAST(CAST(value_bool AS INTEGER) AS DOUBLE), value) AS v FROM h")
def numeric_coercion(spark, sf_dir):
    h = history(spark, sf_dir)
    return h.select("point_uri", "ts", scalars.numeric(F.col("value"), F.col("value_text"), F.col("value_bool")).alias("v"))


@register("unit_conversion", f"WITH {H} SELECT point_uri, ts, round(CASE WHEN unit = '°F' THEN (value - 32) / 1.8::DOUBLE ELSE value END, 6) AS celsius FROM h WHERE value IS NOT NULL")
def unit_conversion(spark, sf_dir):
    h = history(spark, sf_dir).where("value is not null")
    return h.select("point_uri", "ts", F.round(scalars.celsius(F.col("value"), F.coalesce("unit", F.lit(""))), 6).alias("celsius"))


@register("load_tons", "SELECT l_orderkey, l_linenumber, l_quantity * (l_extendedprice / 1000 - l_tax) / 24 AS tons FROM lineitem")
def load_tons(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    tons = scalars.load_tons(F.col("l_quantity"), F.col("l_tax"), F.col("l_extendedprice") / 1000)
    return li.select("l_orderkey", "l_linenumber", tons.alias("tons"))


@register(
    "local_hours",
    "SELECT event_id FROM (SELECT event_id, timezone('America/Chicago', timezone('UTC', ts)) AS t FROM events) WHERE isodow(t) <= 5 AND hour(t) >= 8 AND hour(t) < 18",
)
def local_hours(spark, sf_dir):
    return table(spark, sf_dir, "events").where(scalars.in_hours(F.col("ts"), "America/Chicago", (0, 1, 2, 3, 4), 8, 18)).select("event_id")


@register("criterion_between", "SELECT event_id, value BETWEEN 20 AND 40 AS ok, value >= 30 AS high FROM events")
def criterion_between(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", scalars.meets(v, "between", 20, 40).alias("ok"), scalars.meets(v, ">=", 30).alias("high"))


@register("scope_prefix", f"WITH {H} SELECT point_uri, count(*) AS n FROM h WHERE (starts_with(point_uri, 'urn:point:u1') OR starts_with(point_uri, 'urn:point:u2')) AND NOT starts_with(point_uri, 'urn:point:u14') GROUP BY 1")
def scope_prefix(spark, sf_dir):
    keep = scalars.in_scope("point_uri", ("urn:point:u1", "urn:point:u2"), ("urn:point:u14",))
    return history(spark, sf_dir).where(keep).groupBy("point_uri").agg(F.count("*").alias("n"))


@register("span_last_week", rollup_sql(3600, "2024-01-08 00:00:00", "2024-01-15 00:00:00"))
def span_last_week(spark, sf_dir):
    lo, hi = scalars.span("lastWeek", date(2024, 1, 17))
    return folds(rollup.his_rollup(history(spark, sf_dir), str(lo), str(hi), 3600))


@register("span_past_week_zone", f"WITH {H} SELECT point_uri, count({FOLD}) AS n FROM h WHERE ts >= '2024-01-10 05:00:00' AND ts < '2024-01-18 05:00:00' GROUP BY 1")
def span_past_week_zone(spark, sf_dir):
    """pastWeek in New York: eight local days, today included."""
    lo, hi = scalars.span("pastWeek", date(2024, 1, 17), "America/New_York")
    h = history(spark, sf_dir).where((F.col("ts") >= F.lit(str(lo)).cast("timestamp_ntz")) & (F.col("ts") < F.lit(str(hi)).cast("timestamp_ntz")))
    return h.groupBy("point_uri").agg(F.count(hs.fold_value()).alias("n"))


@register(
    "live_filter",
    f"""WITH {H}, l AS (SELECT point_uri, value FROM h WHERE (value IS NOT NULL OR value_text IS NOT NULL OR value_bool IS NOT NULL) AND point_uri LIKE '%/view'
    QUALIFY row_number() OVER (PARTITION BY point_uri ORDER BY ts DESC) = 1) SELECT point_uri, value AS cur FROM l WHERE value > 50""",
)
def live_filter(spark, sf_dir):
    """Graph condition and current value in one plan."""
    newest = hs.latest(history(spark, sf_dir).where(F.col("point_uri").endswith("/view")), with_value=True)
    return newest.where("value > 50").select("point_uri", F.col("value").alias("cur"))


@register(
    "describe_points",
    f"""WITH {H}, l AS (SELECT point_uri, arg_max(unit, ts) FILTER (unit IS NOT NULL OR label IS NOT NULL) AS unit, max(label) AS dis FROM h GROUP BY 1)
    SELECT point_uri, max(dis) AS dis, regexp_extract(point_uri, '[^/]*$') AS tail FROM l GROUP BY 1, 3""",
)
def describe_points(spark, sf_dir):
    h = history(spark, sf_dir)
    return h.groupBy("point_uri").agg(F.max("label").alias("dis")).select("point_uri", "dis", F.regexp_extract("point_uri", "([^/]*)$", 1).alias("tail"))


@register("unpivot_wide", "SELECT event_id, name, v FROM (SELECT event_id, value AS value, CAST(user_id AS DOUBLE) AS load FROM events) UNPIVOT (v FOR name IN (value, load))")
def unpivot_wide(spark, sf_dir):
    """Wide meter rows to long samples."""
    e = table(spark, sf_dir, "events").select("event_id", "value", F.col("user_id").cast("double").alias("load"))
    return e.unpivot("event_id", ["value", "load"], "name", "v")


@register("json_access", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_type(props) = 'OBJECT' AS is_object FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def json_access(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.variant_get(F.parse_json("props"), "$.k", "bigint")
    return e.select("event_id", k.alias("k"), F.schema_of_variant(F.parse_json("props")).startswith("OBJECT").alias("is_object")).where("k > 50")


@register("prefix_counts", f"WITH {H} SELECT split_part(point_uri, '/', 1) AS prefix, max(ts) AS newest, count(*) AS n FROM h GROUP BY 1")
def prefix_counts(spark, sf_dir):
    return history(spark, sf_dir).groupBy(F.substring_index("point_uri", "/", 1).alias("prefix")).agg(F.max("ts").alias("newest"), F.count("*").alias("n"))


@register("status_histogram", "SELECT l_linestatus AS family, count(*) FILTER (l_returnflag = 'A') AS fail, count(*) FILTER (l_returnflag = 'N') AS pass, count(*) FILTER (l_returnflag = 'R') AS other FROM lineitem GROUP BY 1")
def status_histogram(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_linestatus").alias("family")).agg(*(F.count_if(F.col("l_returnflag") == f).alias(n) for f, n in (("A", "fail"), ("N", "pass"), ("R", "other"))))


@register(
    "coverage_by_class",
    """SELECT p_type AS class, count(DISTINCT p_partkey) AS in_class, count(DISTINCT l_partkey) AS sampled, count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_partkey END) AS failed
    FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem WHERE l_quantity > 45) ON l_partkey = p_partkey GROUP BY 1""",
)
def coverage_by_class(spark, sf_dir):
    tested = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_partkey", "l_returnflag").distinct()
    flags = tested.groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("bad"))
    p = table(spark, sf_dir, "part").join(flags, F.col("p_partkey") == F.col("l_partkey"), "left")
    return p.groupBy(F.col("p_type").alias("class")).agg(F.count("*").alias("in_class"), F.count("l_partkey").alias("sampled"), F.count_if("bad").alias("failed"))


@register("duplicate_claims", "SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_claims(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderdate").agg(F.count("*").alias("n")).where("n > 1")


@register(
    "cell_scores",
    """WITH a AS (SELECT l_orderkey AS k, l_linenumber AS c, l_returnflag AS v FROM lineitem WHERE l_quantity > 10), b AS (SELECT l_orderkey AS k, l_linenumber AS c, l_returnflag AS v FROM lineitem WHERE l_quantity < 40),
    t AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT * FROM a)) AS np, (SELECT count(*) FROM (SELECT DISTINCT * FROM b)) AS nt, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS tp)
    SELECT tp, round(tp / np, 6) AS precision, round(tp / nt, 6) AS recall, round(2 * tp / (np + nt), 6) AS f1 FROM t""",
)
def cell_scores(spark, sf_dir):
    """Cells of two grids that agree."""
    li = table(spark, sf_dir, "lineitem")
    cells = lambda rows: rows.select("l_orderkey", "l_linenumber", "l_returnflag").distinct()
    a, b = cells(li.where("l_quantity > 10")).withColumn("p", F.lit(1)), cells(li.where("l_quantity < 40")).withColumn("t", F.lit(1))
    both = a.join(b, ["l_orderkey", "l_linenumber", "l_returnflag"], "full_outer")
    sums = both.agg(F.count("p").alias("np"), F.count("t").alias("nt"), F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"))
    return sums.select("tp", F.round(F.col("tp") / F.col("np"), 6).alias("precision"), F.round(F.col("tp") / F.col("nt"), 6).alias("recall"), F.round(2 * F.col("tp") / (F.col("np") + F.col("nt")), 6).alias("f1"))


@register("error_routes", "SELECT regexp_replace(url, '[0-9]+', '{id}', 'g') AS route, count(*) AS n, min(page_id) AS first_page, max(page_id) AS last_page FROM pages GROUP BY 1")
def error_routes(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.groupBy(F.regexp_replace("url", "[0-9]+", "{id}").alias("route")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page"))


@register("first_last_test", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_test, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_test FROM orders GROUP BY 1")
def first_last_test(spark, sf_dir):
    at = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", at).alias("first_test"), F.max_by("o_orderkey", at).alias("last_test"))


@register(
    "onset_day",
    """WITH d AS (SELECT event_type, ts::DATE AS day, avg(value) AS m FROM events GROUP BY ALL), l AS (SELECT event_type, max(day) FILTER (m <= 45) AS last_ok FROM d GROUP BY 1)
    SELECT event_type, min(day) AS onset FROM d JOIN l USING (event_type) WHERE last_ok IS NULL OR day > last_ok GROUP BY 1""",
)
def onset_day(spark, sf_dir):
    """First day of the run above the threshold that reaches to the end."""
    d = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("m"))
    ok = d.groupBy("event_type").agg(F.max(F.when(F.col("m") <= 45, F.col("day"))).alias("last_ok"))
    return d.join(ok, "event_type").where("last_ok is null or day > last_ok").groupBy("event_type").agg(F.min("day").alias("onset"))


@register(
    "trailing_window",
    "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW), 6) AS v FROM events",
)
def trailing_window(spark, sf_dir):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id", "event_type").orderBy(us).rangeBetween(-2 * 86400 * 1_000_000, 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("v"))


@register("worst_exceedance", "SELECT event_type, arg_max(value, (abs(value - 30), event_id)) AS worst FROM events GROUP BY 1")
def worst_exceedance(spark, sf_dir):
    far = F.struct(F.abs(F.col("value") - 30), "event_id")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max_by("value", far).alias("worst"))


@register("review_ranking", "SELECT pattern, n, row_number() OVER (ORDER BY n DESC, pattern) AS place FROM (SELECT p_brand || '/' || p_type AS pattern, count(*) AS n FROM part GROUP BY 1) QUALIFY place <= 40")
def review_ranking(spark, sf_dir):
    groups = table(spark, sf_dir, "part").groupBy(F.concat_ws("/", "p_brand", "p_type").alias("pattern")).agg(F.count("*").alias("n"))
    top = groups.orderBy(F.desc("n"), "pattern").limit(40)
    return top.select("pattern", "n", F.row_number().over(Window.orderBy(F.desc("n"), "pattern")).cast("long").alias("place"))


@register("tag_subset", "SELECT p_partkey, len(list_intersect(string_split(p_name, ' '), ['red', 'small', 'widget'])) AS overlap, len(list_intersect(string_split(p_name, ' '), ['red', 'widget'])) = 2 AS subset FROM part")
def tag_subset(spark, sf_dir):
    words = F.split("p_name", " ")
    lit = lambda *xs: F.array(*map(F.lit, xs))
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.size(F.array_intersect(words, lit("red", "small", "widget"))).cast("long").alias("overlap"), (F.size(F.array_except(lit("red", "widget"), words)) == 0).alias("subset"))


@register("missed_batches", "WITH b AS (SELECT o_orderkey, count(*) OVER (ORDER BY o_orderkey DESC) AS after FROM orders WHERE o_orderstatus <> 'O') SELECT c_custkey AS consumer, max(after) AS missed FROM customer JOIN b ON o_orderkey > c_custkey * 10 GROUP BY 1")
def missed_batches(spark, sf_dir):
    """Pruned batches beyond each consumer's offset, from one order of batches and offsets together."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("consumer"), (F.col("c_custkey") * 10).alias("at"))
    return hs.missed(c, table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("at")))


@register("dict_to_triples", "SELECT 'urn:event:' || event_id AS s, k AS p, CASE k WHEN 'k' THEN json_extract_string(props, '$.k') ELSE event_type END AS o FROM events, (SELECT unnest(['k', 'kind']) AS k)")
def dict_to_triples(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    pairs = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("kind"), F.col("event_type"))
    return e.select(F.concat(F.lit("urn:event:"), F.col("event_id").cast("string")).alias("s"), F.explode(pairs).alias("p", "o"))


@register("inventory", "SELECT p_brand AS equip, count(*) AS n_points, count(DISTINCT p_type) AS n_classes, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS classes FROM part GROUP BY 1")
def inventory(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.col("p_brand").alias("equip")).agg(F.count("*").alias("n_points"), F.count_distinct("p_type").alias("n_classes"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("classes"))


@register("evidence_words", "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(c_name || ' ' || c_mktsegment), '[a-z]+')) AS word FROM customer) GROUP BY 1")
def evidence_words(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.explode(mapping.tokens(F.concat_ws(" ", "c_name", "c_mktsegment"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@register("naming_convention", "SELECT c_custkey, regexp_extract(c_name, '^([A-Za-z]+)#0*([0-9]+)$', 1) AS kind, CAST(regexp_extract(c_name, '^([A-Za-z]+)#0*([0-9]+)$', 2) AS BIGINT) AS number FROM customer")
def naming_convention(spark, sf_dir):
    pattern = "^([A-Za-z]+)#0*([0-9]+)$"
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.regexp_extract("c_name", pattern, 1).alias("kind"), F.regexp_extract("c_name", pattern, 2).cast("bigint").alias("number"))


@register("priority_changes", "SELECT user_id, ts, event_type AS state FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM events) WHERE was IS DISTINCT FROM event_type")
def priority_changes(spark, sf_dir):
    """Only changes are kept."""
    was = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts"))
    e = table(spark, sf_dir, "events").withColumn("was", was)
    return e.where(~F.col("was").eqNullSafe(F.col("event_type"))).select("user_id", "ts", F.col("event_type").alias("state"))


@register("ops_counters", f"WITH {H} SELECT count(DISTINCT point_uri) FILTER (ts > '2024-01-30 12:00:00') AS points_seen, count(DISTINCT point_uri) AS points, count(*) FILTER (quality IS NOT NULL) AS flagged FROM h")
def ops_counters(spark, sf_dir):
    """From one registry row per point, not from the samples of each."""
    per = history(spark, sf_dir).groupBy("point_uri").agg(F.max("ts").alias("newest"), F.count("quality").alias("flagged"))
    return per.agg(F.count_if(F.col("newest") > ntz("2024-01-30 12:00:00")).alias("points_seen"), F.count("*").alias("points"), F.sum("flagged").alias("flagged"))


@register("session_gaps", "SELECT user_id, count(*) FILTER (g) AS sessions FROM (SELECT user_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true) AS g FROM events) GROUP BY 1")
def session_gaps(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes")).agg(F.count("*").alias("n"))
    return e.groupBy("user_id").agg(F.count("*").alias("sessions"))


@register("changed_records", "SELECT 'urn:equip:p' || p_partkey AS s, 'size' AS p FROM part WHERE p_size > 40 EXCEPT SELECT 'urn:equip:p' || p_partkey, 'size' FROM part WHERE p_partkey % 2 = 0")
def changed_records(spark, sf_dir):
    """What a watch's second poll has that the first had not."""
    now = tags(spark, sf_dir).where("p = 'size' and num > 40").select("s", "p")
    before = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("urn:equip:p"), F.col("p_partkey").cast("string")).alias("s"), F.lit("size").alias("p"))
    return now.exceptAll(before)


@register("acceptance_expected", "SELECT event_type, count(*) AS n, CAST(ceil(2592000 / 900.0) AS BIGINT) AS expected, round(100.0 * least(count(*), ceil(2592000 / 900.0)) / ceil(2592000 / 900.0), 4) AS pct FROM events WHERE ts >= '2024-01-01' AND ts < '2024-01-31' GROUP BY 1")
def acceptance_expected(spark, sf_dir):
    e = table(spark, sf_dir, "events").where((F.col("ts") >= ntz("2024-01-01")) & (F.col("ts") < ntz("2024-01-31")))
    expected = F.ceil(F.lit(2592000 / 900.0))
    return e.groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", "n", expected.cast("long").alias("expected"), F.round(100.0 * F.least(F.col("n"), expected) / expected, 4).alias("pct"))
