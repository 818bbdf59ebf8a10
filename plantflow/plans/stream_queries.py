"""Registered queries: streams with timers, incremental derivations, transactional writes."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from plantflow.operators import derive
from plantflow.plans.asset_queries import _drain, _events_stream
from plantflow.plans.history_queries import r6
from plantflow.registry import register
from plantflow.session import table
from plantflow.sources import upsert
from plantflow.streaming import alerts, incremental


@contextmanager
def state_store(spark):
    """The state store that timers need, for the streams started meanwhile."""
    before = {k: spark.conf.get(k, None) for k in alerts.STORE}
    for k, v in alerts.STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


HOURS = 3_600_000_000


@register(
    "alert_timers",
    f"""WITH RECURSIVE h AS (SELECT (epoch_ms(max(ts)) - 30000) * 1000 AS horizon FROM events WHERE user_id IS NOT NULL),
    t AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS ts, max(CASE WHEN event_type IN ('view', 'click') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END) AS p FROM events GROUP BY 1, 2),
    o AS (SELECT key, ts, p, row_number() OVER w AS i, coalesce(lead(ts) OVER w, horizon) AS nxt FROM t, h WHERE ts < horizon WINDOW w AS (PARTITION BY key ORDER BY ts)),
    z AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, 0 AS ph, CAST(NULL AS BIGINT) AS fs, CAST(NULL AS BIGINT) AS ls, CAST(NULL AS BIGINT) AS ab, CAST([] AS STRUCT(e VARCHAR, t BIGINT)[]) AS ev FROM o
    UNION ALL SELECT key, i, ph2, fs1, ls2 + n * {12 * HOURS}, CASE WHEN gone IS NULL THEN ab1 END,
      list_filter([{{'e': 'firing', 't': fire}}, {{'e': 'reminder', 't': again}}, {{'e': 'resolved', 't': gone}}], lambda x: x.t IS NOT NULL) || list_transform(range(1, n + 1), lambda k: {{'e': 'reminder', 't': ls2 + k * {12 * HOURS}}})
      FROM (SELECT *, CASE WHEN p = 1 AND ph2 = 2 THEN greatest(0, (nxt - 1 - ls2) // {12 * HOURS}) ELSE 0 END AS n
      FROM (SELECT *, CASE WHEN fire IS NOT NULL THEN 2 WHEN gone IS NOT NULL THEN 0 ELSE ph1 END AS ph2, coalesce(again, fire, ls) AS ls2
      FROM (SELECT *, CASE WHEN p = 1 AND ph1 = 1 AND greatest(fs1 + {6 * HOURS}, ts) < nxt THEN greatest(fs1 + {6 * HOURS}, ts) END AS fire,
        CASE WHEN p = 0 AND ph1 = 2 AND greatest(ab1 + {8 * HOURS}, ts) < nxt THEN greatest(ab1 + {8 * HOURS}, ts) END AS gone, CASE WHEN p = 1 AND ph1 = 2 AND ls + {12 * HOURS} <= ts THEN ts END AS again
      FROM (SELECT o.key, o.i, o.p, o.ts, o.nxt, z.ls, CASE WHEN p = 1 AND ph = 0 THEN 1 WHEN p = 0 AND ph = 1 THEN 0 ELSE ph END AS ph1, CASE WHEN p = 1 AND ph = 0 THEN o.ts ELSE fs END AS fs1,
        CASE WHEN p = 1 THEN NULL WHEN p = 0 AND ph = 2 THEN coalesce(ab, o.ts) ELSE ab END AS ab1 FROM z JOIN o ON o.key = z.key AND o.i = z.i + 1)))))
    SELECT key, x.e AS event, make_timestamp(x.t) AS "at" FROM (SELECT key, unnest(ev) AS x FROM z)""",
)
def alert_timers(spark, sf_dir):
    """Structured Streaming: alerts that fire after 6 hours of views or clicks, repeat every 12 and clear after 8 of others; errors are a stale source."""
    e = _events_stream(spark, sf_dir)
    present = F.when(F.col("event_type").isin("view", "click"), True).when(F.col("event_type") != "error", False)
    observed = e.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), present.alias("present"))
    with state_store(spark):
        out = _drain(alerts.alert_stream(observed, alerts.Limits(6 * 3600, 8 * 3600, 12 * 3600)), spark)
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))


def _scratch(spark):
    """A new folder below the checkpoint folder that the cluster names."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-plantflow-")
    return f"{base}/tables-{uuid.uuid4().hex}"


def _in_batches(spark, rows, base, files=4):
    """`rows` dealt to files, as a stream that takes one file a batch."""
    rows.repartition(files).write.parquet(f"{base}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")


HISTORY = "point_uri string, ts timestamp_ntz, seq long, value double"


@register("upsert_stream", "SELECT event_type AS point_uri, date_trunc('hour', ts) AS ts, max(event_id) AS seq, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1, 2")
def upsert_stream(spark, sf_dir):
    """Structured Streaming into a transactional table: of the readings of a point and hour the one of largest id stays."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("point_uri"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("seq"), "value")
    base = _scratch(spark)
    target = upsert.UpsertTable(spark, f"{base}/history", HISTORY, buckets=4)
    run = upsert.upsert_stream(_in_batches(spark, rows, base), target, "readings").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return target.snapshot().select("point_uri", "ts", "seq", r6("value"))


@register(
    "derivation_stream",
    """WITH l AS (SELECT user_id, arg_max(value, (ts, event_id)) FILTER (event_type = 'view') AS a, arg_max(value, (ts, event_id)) FILTER (event_type = 'click') AS b FROM events GROUP BY 1)
    SELECT 't' || user_id AS target, round(a - b, 6) AS value, CAST(NULL AS VARCHAR) AS error FROM l WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def derivation_stream(spark, sf_dir):
    """Structured Streaming: each batch of readings re-runs the targets that it feeds, last of a minus last of b."""
    e = table(spark, sf_dir, "events")
    point = F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type")
    rows = e.select(point.alias("point_uri"), "ts", F.col("event_id").alias("seq"), "value")
    ends = F.explode(F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("view"), F.lit("click")))).alias("name", "event_type")
    targets = e.select("user_id").distinct().select("user_id", ends).select(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("target"), "name", point.alias("point_uri"))
    base = _scratch(spark)
    history = upsert.UpsertTable(spark, f"{base}/history", HISTORY, buckets=4, ts_col=None)
    results = upsert.UpsertTable(spark, f"{base}/results", incremental.RESULTS, keys=("target",), ts_col=None, buckets=4)
    kept = incremental.Incremental(history, results, targets, derive.last_difference, 3650 * 86400, keep=1)
    run = kept.stream(_in_batches(spark, rows, base), "readings").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return results.snapshot().select("target", r6("value"), "error")
