"""Registered queries: history scans, writes and rollups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantflow.operators import rollup
from plantflow.registry import register
from plantflow.session import table
from plantflow.sources import history as hs
from plantflow.sources.adapter import HISTORY_SQL as H
from plantflow.sources.adapter import history

GOOD = "(quality IS NULL OR quality = 'ok')"
FOLD = "coalesce(value, CAST(CAST(value_bool AS INTEGER) AS DOUBLE))"
COLS = "point_uri, ts, value, value_text, value_bool, unit, label, quality"


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


@register("scan_range", f"WITH {H} SELECT {COLS} FROM h WHERE point_uri = 'urn:point:u7/view' AND ts BETWEEN '2024-01-02' AND '2024-01-20' AND {GOOD}")
def scan_range(spark, sf_dir):
    return hs.read_range(history(spark, sf_dir), "urn:point:u7/view", ntz("2024-01-02"), ntz("2024-01-20"), good_only=True)


@register(
    "scan_range_bulk",
    f"""WITH {H}, p AS (SELECT DISTINCT point_uri FROM h UNION SELECT 'urn:point:never')
    SELECT p.point_uri, r.ts, r.value FROM p LEFT JOIN (SELECT * FROM h WHERE ts BETWEEN '2024-01-02' AND '2024-01-09') r USING (point_uri)""",
)
def scan_range_bulk(spark, sf_dir):
    h = history(spark, sf_dir)
    never = spark.createDataFrame([("urn:point:never",)], "point_uri string")
    points = hs.list_points(h).unionByName(never)
    return hs.read_range_bulk(h, points, ntz("2024-01-02"), ntz("2024-01-09")).select("point_uri", "ts", "value")


@register(
    "scan_range_many",
    f"""WITH {H}, r AS (SELECT *, row_number() OVER (PARTITION BY point_uri ORDER BY ts) AS rn, count(*) OVER (PARTITION BY point_uri) > 5 AS truncated
      FROM h WHERE ts >= '2024-01-03' AND ts < '2024-01-10') SELECT {COLS}, truncated FROM r WHERE rn <= 5""",
)
def scan_range_many(spark, sf_dir):
    h = history(spark, sf_dir)
    return hs.read_range_many(h, hs.list_points(h), ntz("2024-01-03"), ntz("2024-01-10"), 5)


@register("latest_value", f"WITH {H} SELECT {COLS} FROM h QUALIFY row_number() OVER (PARTITION BY point_uri ORDER BY ts DESC) = 1")
def latest_value(spark, sf_dir):
    return hs.latest(history(spark, sf_dir))


@register(
    "latest_where",
    f"""WITH {H} SELECT {COLS} FROM h WHERE ts <= '2024-01-20' AND ts >= '2024-01-05' AND {GOOD}
    AND (value IS NOT NULL OR value_text IS NOT NULL OR value_bool IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY point_uri ORDER BY ts DESC) = 1""",
)
def latest_where(spark, sf_dir):
    return hs.latest(history(spark, sf_dir), before=ntz("2024-01-20"), since=ntz("2024-01-05"), with_value=True, good_only=True)


@register("oldest_probe", f"WITH {H} SELECT {COLS} FROM h WHERE ts >= '2024-01-10' QUALIFY row_number() OVER (PARTITION BY point_uri ORDER BY ts) = 1")
def oldest_probe(spark, sf_dir):
    return hs.latest(history(spark, sf_dir), since=ntz("2024-01-10"), newest=False)


@register("first_sample", f"WITH {H} SELECT point_uri, min(ts) AS first_ts FROM h GROUP BY 1")
def first_sample(spark, sf_dir):
    return hs.first_seen(history(spark, sf_dir))


@register(
    "point_labels",
    f"WITH {H} SELECT point_uri, unit, label FROM h WHERE unit IS NOT NULL OR label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY point_uri ORDER BY ts DESC) = 1",
)
def point_labels(spark, sf_dir):
    return hs.point_labels(history(spark, sf_dir))


@register("list_points", f"WITH {H} SELECT DISTINCT point_uri FROM h")
def list_points(spark, sf_dir):
    return hs.list_points(history(spark, sf_dir))


@register(
    "upsert_last_wins",
    f"""WITH {H} SELECT point_uri, ts, CASE WHEN hour(ts) % 2 = 0 THEN value * 2 ELSE value END AS value, CASE WHEN hour(ts) % 2 = 0 THEN 'rewritten' ELSE label END AS label FROM h""",
)
def upsert_last_wins(spark, sf_dir):
    h = history(spark, sf_dir)
    even = h.where(F.hour("ts") % 2 == 0)
    once = even.withColumn("value", F.col("value") * 3).withColumn("label", F.lit("lost")).withColumn("seq", F.lit(1))
    again = even.withColumn("value", F.col("value") * 2).withColumn("label", F.lit("rewritten")).withColumn("seq", F.lit(2))
    return hs.upsert(h, once.unionByName(again)).select("point_uri", "ts", "value", "label")


@register("point_registry", f"WITH {H} SELECT point_uri, max(ts) AS newest_ts FROM h GROUP BY 1")
def point_registry(spark, sf_dir):
    h = history(spark, sf_dir)
    return hs.advance_registry(hs.registry(h.where(F.col("ts") < ntz("2024-01-15"))), h.where(F.col("ts") >= ntz("2024-01-10")))


@register("delete_samples", f"WITH {H} SELECT point_uri, ts FROM h WHERE NOT (day(ts) = 5)")
def delete_samples(spark, sf_dir):
    h = history(spark, sf_dir)
    return hs.delete(h, h.where(F.dayofmonth("ts") == 5)).select("point_uri", "ts")


@register("import_insert_only", f"WITH {H} SELECT point_uri, ts, CASE WHEN day(ts) < 20 THEN value ELSE value + 1 END AS value FROM h")
def import_insert_only(spark, sf_dir):
    h = history(spark, sf_dir)
    return hs.import_new(h.where(F.dayofmonth("ts") < 20), h.withColumn("value", F.col("value") + 1)).select("point_uri", "ts", "value")


@register(
    "new_points",
    f"WITH {H} SELECT DISTINCT point_uri FROM h WHERE ts >= '2024-01-03' AND point_uri NOT IN (SELECT point_uri FROM h WHERE ts < '2024-01-03')",
)
def new_points(spark, sf_dir):
    h = history(spark, sf_dir)
    return hs.new_points(h.where(F.col("ts") >= ntz("2024-01-03")), hs.registry(h.where(F.col("ts") < ntz("2024-01-03"))))


@register(
    "expand_batch",
    """SELECT 'urn:point:u' || user_id || '/' || k AS point_uri, ts, CASE k WHEN 'k' THEN CAST(json_extract(props, '$.k') AS DOUBLE) ELSE value END AS value
    FROM events, (SELECT unnest(['k', 'value']) AS k)""",
)
def expand_batch(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    points = F.map_from_arrays(
        F.array(F.lit("k"), F.lit("value"), F.lit("bad label")), F.array(F.get_json_object("props", "$.k").cast("double"), F.col("value"), F.lit(0.0))
    )
    prefix = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return hs.expand_batch(e.select(prefix.alias("prefix"), "ts", points.alias("points")))


@register("month_counts", f"WITH {H} SELECT point_uri, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM h GROUP BY ALL")
def month_counts(spark, sf_dir):
    return hs.month_counts(history(spark, sf_dir))


@register(
    "reconcile_export",
    f"""WITH {H}, a AS (SELECT point_uri, strftime(ts, '%Y-%m') AS month, count(*) AS n_export FROM h WHERE day(ts) <> 3 GROUP BY ALL),
    b AS (SELECT point_uri, strftime(ts, '%Y-%m') AS month, count(*) AS n_source FROM h GROUP BY ALL)
    SELECT point_uri, month, n_export, n_source FROM a FULL JOIN b USING (point_uri, month) WHERE n_export IS DISTINCT FROM n_source""",
)
def reconcile_export(spark, sf_dir):
    h = history(spark, sf_dir)
    return hs.reconcile(hs.month_counts(h.where(F.dayofmonth("ts") != 3)), hs.month_counts(h))


def rollup_sql(seconds: int, start: str, end: str) -> str:
    return f"""WITH {H} SELECT point_uri, time_bucket(INTERVAL {seconds} SECOND, ts, TIMESTAMP '{start}') AS bucket, round(avg({FOLD}), 6) AS avg,
    round(min({FOLD}), 6) AS min, round(max({FOLD}), 6) AS max, round(sum({FOLD}), 6) AS sum, count({FOLD}) AS count
    FROM h WHERE ts >= '{start}' AND ts < '{end}' GROUP BY 1, 2 HAVING count({FOLD}) > 0"""


def folds(df):
    return df.select("point_uri", "bucket", r6("avg"), r6("min"), r6("max"), r6("sum"), "count")


@register("rollup_fixed", rollup_sql(3600, "2024-01-02 00:00:00", "2024-01-09 00:00:00"))
def rollup_fixed(spark, sf_dir):
    return folds(rollup.his_rollup(history(spark, sf_dir), "2024-01-02 00:00:00", "2024-01-09 00:00:00", 3600))


@register("rollup_origin", rollup_sql(2520, "2024-01-02 00:07:00", "2024-01-05 00:00:00"))
def rollup_origin(spark, sf_dir):
    """Buckets that start at the span, not at the epoch."""
    return folds(rollup.his_rollup(history(spark, sf_dir), "2024-01-02 00:07:00", "2024-01-05 00:00:00", 2520))


@register(
    "rollup_calendar",
    f"""WITH {H} SELECT point_uri, timezone('UTC', timezone('America/New_York', date_trunc('month', timezone('America/New_York', timezone('UTC', ts))))) AS bucket,
    round(avg({FOLD}), 6) AS avg, round(min({FOLD}), 6) AS min, round(max({FOLD}), 6) AS max, round(sum({FOLD}), 6) AS sum, count({FOLD}) AS count
    FROM h GROUP BY 1, 2 HAVING count({FOLD}) > 0""",
)
def rollup_calendar(spark, sf_dir):
    return folds(rollup.his_rollup_calendar(history(spark, sf_dir), 1, "America/New_York"))


@register(
    "rollup_materialised",
    f"""WITH {H} SELECT point_uri, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS bucket, round(sum({FOLD}), 6) AS vsum, count({FOLD}) AS vcount,
    round(min({FOLD}), 6) AS vmin, round(max({FOLD}), 6) AS vmax FROM h GROUP BY 1, 2 HAVING count({FOLD}) > 0""",
)
def rollup_materialised(spark, sf_dir):
    hourly = rollup.coarse_rollup(rollup.fine_rollup(history(spark, sf_dir)))
    return hourly.select("point_uri", "bucket", r6("vsum"), "vcount", r6("vmin"), r6("vmax"))


@register("rollup_planned", rollup_sql(7200, "2024-01-02 00:00:00", "2024-01-20 00:00:00"))
def rollup_planned(spark, sf_dir):
    h = history(spark, sf_dir)
    hourly = rollup.coarse_rollup(rollup.fine_rollup(h))
    return folds(rollup.planned_rollup(h, hourly, "2024-01-02 00:00:00", "2024-01-20 00:00:00", 7200, "2024-01-11 05:00:00"))


@register(
    "auto_downsample",
    rollup_sql(43200, "2024-01-01 00:00:00", "2024-01-31 00:00:00"),
)
def auto_downsample(spark, sf_dir):
    h = history(spark, sf_dir)
    step = rollup.auto_interval(30 * 86400, 750, 20_000)
    return folds(rollup.his_rollup(h, "2024-01-01 00:00:00", "2024-01-31 00:00:00", step))


@register(
    "series_page",
    f"WITH {H}, p AS (SELECT DISTINCT point_uri FROM h WHERE point_uri > 'urn:point:u120/' ORDER BY 1 LIMIT 20) SELECT point_uri, count(*) AS n FROM h SEMI JOIN p USING (point_uri) GROUP BY 1",
)
def series_page(spark, sf_dir):
    """Keyset paging: the first 20 series after a cursor."""
    h = history(spark, sf_dir)
    page = hs.list_points(h).where(F.col("point_uri") > "urn:point:u120/").orderBy("point_uri").limit(20)
    return h.join(page, "point_uri", "left_semi").groupBy("point_uri").agg(F.count("*").alias("n"))


@register(
    "kind_of_series",
    f"""WITH {H} SELECT point_uri, CASE arg_min(k, ts) WHEN 1 THEN 'Bool' WHEN 2 THEN 'Str' ELSE 'Number' END AS kind FROM (
      SELECT point_uri, ts, CASE WHEN value_bool IS NOT NULL THEN 1 WHEN value_text IS NOT NULL THEN 2 WHEN value IS NOT NULL THEN 3 END AS k FROM h) WHERE k IS NOT NULL GROUP BY 1""",
)
def kind_of_series(spark, sf_dir):
    kind = F.when(F.col("value_bool").isNotNull(), "Bool").when(F.col("value_text").isNotNull(), "Str").when(F.col("value").isNotNull(), "Number")
    rows = history(spark, sf_dir).withColumn("kind", kind).where("kind is not null")
    return rows.groupBy("point_uri").agg(F.min_by("kind", "ts").alias("kind"))


@register(
    "interpolate",
    f"""WITH {H}, s AS (SELECT point_uri AS series, ts, value FROM h WHERE value IS NOT NULL AND point_uri LIKE '%/view' AND ts < '2024-01-02'),
    g AS (SELECT t.ts, e.series FROM (SELECT DISTINCT ts FROM s) t JOIN (SELECT series, min(ts) lo, max(ts) hi FROM s GROUP BY 1) e ON t.ts BETWEEN lo AND hi),
    a AS (SELECT g.series, g.ts, s.ts AS ta, s.value AS av FROM g ASOF JOIN s ON g.series = s.series AND g.ts >= s.ts),
    b AS (SELECT g.series, g.ts, s.ts AS bt, s.value AS bv FROM g ASOF JOIN s ON g.series = s.series AND g.ts <= s.ts)
    SELECT a.series, a.ts, round(CASE WHEN ta = a.ts THEN av ELSE av + (bv - av) * (epoch_us(a.ts) - epoch_us(ta)) / (epoch_us(bt) - epoch_us(ta)) END, 6) AS value
    FROM a JOIN b USING (series, ts)""",
)
def interpolate(spark, sf_dir):
    h = history(spark, sf_dir).where("value is not null").where(F.col("point_uri").endswith("/view") & (F.col("ts") < ntz("2024-01-02")))
    return rollup.interpolate(h.select(F.col("point_uri").alias("series"), "ts", "value")).select("series", "ts", r6("value"))


@register(
    "compact_arrays",
    f"WITH {H} SELECT point_uri, len(list(value ORDER BY ts)) AS n, md5(array_to_string(list(CAST(epoch_us(ts) AS VARCHAR) ORDER BY ts), ',')) AS ts_md5 FROM h GROUP BY 1",
)
def compact_arrays(spark, sf_dir):
    """Parallel arrays of times and values per series."""
    packed = F.array_sort(F.collect_list(F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")))
    rows = history(spark, sf_dir).groupBy("point_uri").agg(packed.alias("s"))
    joined = F.array_join(F.transform("s", lambda x: x["t"].cast("string")), ",")
    return rows.select("point_uri", F.size("s").cast("long").alias("n"), F.md5(joined).alias("ts_md5"))


@register(
    "freshness",
    f"""WITH {H} SELECT split_part(substr(point_uri, 11), '/', 1) AS prefix, max(ts) AS newest, count(*) AS n,
    round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / nullif(count(*) - 1, 0), 6) AS spacing_s, count(*) FILTER (ts > TIMESTAMP '2024-01-29') AS recent FROM h GROUP BY 1""",
)
def freshness(spark, sf_dir):
    h = history(spark, sf_dir).withColumn("prefix", F.split_part(F.substring("point_uri", 11, 100), F.lit("/"), F.lit(1)))
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    span = (us(F.max("ts")) - us(F.min("ts"))) / F.lit(1e6)
    return h.groupBy("prefix").agg(
        F.max("ts").alias("newest"),
        F.count("*").alias("n"),
        F.round(span / F.nullif(F.count("*") - 1, F.lit(0)), 6).alias("spacing_s"),
        F.count_if(F.col("ts") > ntz("2024-01-29")).alias("recent"),
    )


@register(
    "percentile_delay",
    "SELECT event_type, round(quantile_cont(value, 0.9), 6) AS p90, round(median(value), 6) AS med FROM events GROUP BY 1",
)
def percentile_delay(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.9)), 6).alias("p90"), F.round(F.median("value"), 6).alias("med"))


@register(
    "point_stats",
    f"""WITH {H} SELECT point_uri, count(*) AS n, round(min({FOLD}), 6) AS lo, round(max({FOLD}), 6) AS hi, round(avg({FOLD}), 6) AS mean,
    count(DISTINCT coalesce(CAST(value AS VARCHAR), value_text, CAST(value_bool AS VARCHAR))) AS kinds, bool_and(value_bool IS NOT NULL) AS only_bool,
    bool_or(value_text IS NOT NULL) AS any_text FROM h GROUP BY 1""",
)
def point_stats(spark, sf_dir):
    v = hs.fold_value()
    key = F.coalesce(F.col("value").cast("string"), "value_text", F.col("value_bool").cast("string"))
    return history(spark, sf_dir).groupBy("point_uri").agg(
        F.count("*").alias("n"),
        F.round(F.min(v), 6).alias("lo"),
        F.round(F.max(v), 6).alias("hi"),
        F.round(F.avg(v), 6).alias("mean"),
        F.count_distinct(key).alias("kinds"),
        F.bool_and(F.col("value_bool").isNotNull()).alias("only_bool"),
        F.bool_or(F.col("value_text").isNotNull()).alias("any_text"),
    )


@register(
    "batch_arrays",
    """WITH n AS (SELECT event_id, date_trunc('day', ts) AS day, ts, (row_number() OVER (PARTITION BY date_trunc('day', ts), date_trunc('hour', ts) ORDER BY ts, event_id) - 1) // 5000 AS part FROM events)
    SELECT day, date_trunc('hour', ts) AS hour, CAST(part AS BIGINT) AS part, count(*) AS n, md5(array_to_string(list(CAST(event_id AS VARCHAR) ORDER BY ts, event_id), ',')) AS ids_md5 FROM n GROUP BY 1, 2, 3""",
)
def batch_arrays(spark, sf_dir):
    """Feed batches of at most 5,000 readings as arrays ordered by (time, key)."""
    trunc = lambda unit: F.date_trunc(unit, "ts").cast("timestamp_ntz").alias(unit)
    e = table(spark, sf_dir, "events").select("ts", "event_id", trunc("day"), trunc("hour"))
    place = F.row_number().over(Window.partitionBy("day", "hour").orderBy("ts", "event_id")) - 1
    e = e.withColumn("part", F.floor(place / 5000))
    rows = e.groupBy("day", "hour", "part").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("s"))
    return rows.select("day", "hour", "part", F.size("s").cast("long").alias("n"), F.md5(F.array_join(F.transform("s", lambda x: x["event_id"].cast("string")), ",")).alias("ids_md5"))


@register(
    "keep_newest_runs",
    "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3",
)
def keep_newest_runs(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("o_custkey", "o_orderkey", "o_orderdate")


@register(
    "fault_page",
    """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND (o_orderdate < '2000-01-01' OR (o_orderdate = '2000-01-01' AND o_orderkey < 500))
    ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""",
)
def fault_page(spark, sf_dir):
    """A page below a (time, id) cursor, newest first."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    below = (F.col("o_orderdate") < ntz("2000-01-01")) | ((F.col("o_orderdate") == ntz("2000-01-01")) & (F.col("o_orderkey") < 500))
    return o.where(below).select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50)
