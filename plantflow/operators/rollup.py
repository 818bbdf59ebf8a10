"""Span-aligned time-bucket rollups, pre-folded rollups and plans that mix them with raw samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantflow.sources.history import fold_value

FOLDS = ("avg", "min", "max", "sum", "count")
# Seconds of the downsampling ladder.
LADDER = (10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 21600, 43200, 86400)


def bucket_start(ts: Column, start: str, seconds: int) -> Column:
    """Start of the bucket of `ts`, counted from the span's start."""
    micros = F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.lit(start).cast("timestamp"))
    floor = micros - F.pmod(micros, F.lit(seconds * 1_000_000))
    return F.timestamp_micros(floor + F.unix_micros(F.lit(start).cast("timestamp"))).cast("timestamp_ntz")


def partials(rows: DataFrame, *keys) -> DataFrame:
    """(vsum, vcount, vmin, vmax) of the fold value by `keys`."""
    v = fold_value()
    out = rows.groupBy(*keys).agg(F.sum(v).alias("vsum"), F.count(v).alias("vcount"), F.min(v).alias("vmin"), F.max(v).alias("vmax"))
    return out.where("vcount > 0")


def finish(parts: DataFrame, *keys) -> DataFrame:
    """All folds from partial rows."""
    out = parts.groupBy(*keys).agg(
        F.sum("vsum").alias("sum"), F.sum("vcount").alias("count"), F.min("vmin").alias("min"), F.max("vmax").alias("max")
    )
    return out.where("`count` > 0").withColumn("avg", F.col("sum") / F.col("count"))


def his_rollup(history: DataFrame, start: str, end: str, seconds: int) -> DataFrame:
    """Folds per point and bucket over [start, end); buckets without numbers are absent."""
    rows = history.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
    return finish(partials(rows, "point_uri", bucket_start(F.col("ts"), start, seconds).alias("bucket")), "point_uri", "bucket")


def his_rollup_calendar(history: DataFrame, months: int, zone: str) -> DataFrame:
    """Folds per point and local month, quarter or year, stamped at the local start in UTC."""
    unit = {1: "month", 3: "quarter", 12: "year"}[months]
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone)
    bucket = F.to_utc_timestamp(F.date_trunc(unit, local), zone).cast("timestamp_ntz")
    return finish(partials(history, "point_uri", bucket.alias("bucket")), "point_uri", "bucket")


def fine_rollup(history: DataFrame) -> DataFrame:
    """Materialised 5-minute partials."""
    return partials(history, "point_uri", bucket_start(F.col("ts"), "1970-01-01 00:00:00", 300).alias("bucket"))


def coarse_rollup(fine: DataFrame) -> DataFrame:
    """Hourly partials built on the 5-minute ones."""
    hour = bucket_start(F.col("bucket"), "1970-01-01 00:00:00", 3600)
    return fine.groupBy("point_uri", hour.alias("bucket")).agg(
        F.sum("vsum").alias("vsum"), F.sum("vcount").alias("vcount"), F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax")
    )


def planned_rollup(history: DataFrame, hourly: DataFrame, start: str, end: str, seconds: int, dirty_from: str) -> DataFrame:
    """The fold of `his_rollup` with hourly partials before `dirty_from` and raw samples elsewhere, each instant once.

    Hourly rows serve only where whole hours fit the output buckets; `start` and `dirty_from`
    must be whole hours and `seconds` a multiple of 3600 for that.
    """
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    old = hourly.where((F.col("bucket") >= at(start)) & (F.col("bucket") < F.least(at(dirty_from), at(end))))
    old = old.select("point_uri", bucket_start(F.col("bucket"), start, seconds).alias("bucket"), "vsum", "vcount", "vmin", "vmax")
    raw = history.where((F.col("ts") >= F.greatest(at(start), at(dirty_from))) & (F.col("ts") < at(end)))
    new = partials(raw, "point_uri", bucket_start(F.col("ts"), start, seconds).alias("bucket"))
    return finish(old.unionByName(new), "point_uri", "bucket")


def auto_interval(span_seconds: float, n_series: int, max_samples: int = 200_000) -> int | None:
    """Bucket seconds that fit the sample budget, or None where raw samples fit."""
    want = span_seconds / max(100, max_samples // max(1, n_series))
    if want < LADDER[0]:
        return None
    return next((step for step in LADDER if step >= want), LADDER[-1])


def raw_budget(rows: DataFrame, n_points: int, limit: int, max_samples: int, least: int = 100) -> DataFrame:
    """The first samples of each point, as many as its share of the budget for the whole read allows."""
    from pyspark.sql.window import Window

    each = min(limit, max(least, max_samples // max(1, n_points)))
    place = F.row_number().over(Window.partitionBy("point_uri").orderBy("ts"))
    return rows.withColumn("place", place).where(F.col("place") <= each).drop("place")


def interpolate(samples: DataFrame, times: DataFrame | None = None, block_s: float = 600, spread: int = 8) -> DataFrame:
    """Each series at every time any series has, inside its own first and last sample.

    Linear between two numbers, else the previous value. `samples` is (series, ts, value).

    What a time needs is settled at the sample before it, so windows see samples only. These spans then meet
    the times of each short block, an array; spans of a block are dealt to `spread` keys, so no
    task gathers a block's series and the grid is never sorted.
    """
    from pyspark.sql.window import Window

    times = samples.select("ts").distinct() if times is None else times.select("ts").distinct()
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    block = lambda t: F.floor(t / F.lit(int(block_s * 1_000_000)))
    one = samples.where("ts is not null").groupBy("series", "ts").agg(F.max("value").alias("value")).withColumn("t", us(F.col("ts")))
    have = F.when(F.col("value").isNotNull(), F.struct("t", F.col("value").alias("v")))
    ahead = Window.partitionBy("series").orderBy("t")
    back = Window.partitionBy("series").orderBy(F.desc("t"))
    spans = one.withColumns({"a": F.last(have, ignorenulls=True).over(ahead.rowsBetween(Window.unboundedPreceding, 0)), "end": F.coalesce(F.lead("t").over(ahead) - 1, "t")})
    # The next sample is the last one seen from the end: a frame that grows, unlike one that shrinks, is linear.
    spans = spans.withColumn("b", F.last(have, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumns({"block": F.explode(F.sequence(block(F.col("t")), block(F.col("end")))), "part": F.pmod(F.xxhash64("series"), F.lit(spread))})
    listed = times.where("ts is not null").groupBy(block(us(F.col("ts"))).alias("block")).agg(F.collect_list("ts").alias("times"))
    listed = listed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))
    met = spans.join(listed, ["block", "part"]).withColumn("at", F.explode("times"))
    at = us(F.col("at"))
    share = (at - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
    value = F.when(F.col("a.t") == at, F.col("a.v")).otherwise(F.col("a.v") + (F.col("b.v") - F.col("a.v")) * share)
    return met.where(at.between(F.col("t"), F.col("end"))).select("series", F.col("at").alias("ts"), value.alias("value"))
