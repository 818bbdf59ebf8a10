"""Sequence operators over one series: gaps, holds, spikes, edges, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantflow.operators.timejoin import micros
from plantflow.session import cut
from plantflow.sources.history import good

# Words that count as running.
RUN_WORDS = ("on", "true", "run", "running", "active", "start")


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """`rows` with their place (from 1) in a total order, without one task that holds them all.

    Rows are dealt by ranges of the order and numbered inside each; a range starts after the
    rows of those before it, of which there are as many as partitions.
    """
    part = "range_part"
    dealt = cut(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sizes = dealt.groupBy(part).agg(F.count("*").alias("n"))
    before = sizes.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return dealt.withColumn(name, inside).join(F.broadcast(before), part).withColumn(name, F.col(name) + F.col("before")).drop(part, "before")


def carry_in(history: DataFrame, starts: DataFrame, n: int = 10, within_s: float = 3600) -> DataFrame:
    """Samples from each point's start (point_uri, start) on, with up to `n` good ones of the time before it."""
    rows = history.join(starts, "point_uri")
    t, start = micros(F.col("ts")), micros(F.col("start"))
    older = rows.where((t < start) & (t >= start - int(within_s * 1e6)) & good())
    place = F.row_number().over(Window.partitionBy("point_uri").orderBy(F.desc("ts")))
    older = older.withColumn("place", place).where(F.col("place") <= n).drop("place")
    return rows.where(t >= start).withColumn("carried", F.lit(False)).unionByName(older.withColumn("carried", F.lit(True))).drop("start")


def availability(samples: DataFrame, key: str, start: str, end: str, gap_s: float) -> DataFrame:
    """Percent of [start, end) covered, a sample covering until the next one but `gap_s` at most."""
    lo, hi = micros(F.lit(start).cast("timestamp_ntz")), micros(F.lit(end).cast("timestamp_ntz"))
    t, gap = micros(F.col("ts")), F.lit(int(gap_s * 1e6))
    w = Window.partitionBy(key).orderBy("ts")
    rows = samples.where((t >= lo) & (t < hi)).withColumn("cover", F.least(F.coalesce(F.lead(t).over(w), hi) - t, gap))
    sums = rows.groupBy(key).agg((F.sum("cover") + F.least(F.min(t) - lo, gap)).alias("c"))
    total = hi - lo
    return sums.select(key, F.round(100 * F.least("c", total) / total, 2).alias("pct"))


def acceptance(samples: DataFrame, points: DataFrame, key: str, start: str, end: str, settle_s: int, gap_s: float, least_pct: float) -> DataFrame:
    """(key, samples, expected, pct, passed) of every point over an acceptance run, judged from `settle_s` after its start.

    Expected is what a point reporting every `gap_s` sends in that time; a point without samples has none and 0 %.
    """
    from datetime import datetime, timedelta

    first = datetime.fromisoformat(start) + timedelta(seconds=settle_s)
    span = max((datetime.fromisoformat(end) - first).total_seconds(), 0.0)
    inside = samples.where((F.col("ts") >= F.lit(first)) & (F.col("ts") < F.lit(datetime.fromisoformat(end))))
    counts = inside.groupBy(key).agg(F.count("*").alias("samples"))
    rows = points.select(key).distinct().join(counts, key, "left")
    rows = rows.join(availability(samples, key, first.isoformat(" "), end, gap_s), key, "left") if span else rows.withColumn("pct", F.lit(0.0))
    pct = F.coalesce("pct", F.lit(0.0))
    expected = -(-span // gap_s) if gap_s > 0 else 0
    return rows.select(key, F.coalesce("samples", F.lit(0)).alias("samples"), F.lit(int(expected)).cast("long").alias("expected"), pct.alias("pct"), (pct + 1e-9 >= least_pct).alias("passed"))


def is_running(number: str = "value", text: str = "value_text", boolean: str = "value_bool") -> Column:
    return F.coalesce(F.col(boolean), F.col(number) > 0.5, F.lower(F.col(text)).isin(*RUN_WORDS), F.lit(False))


def run_hours(samples: DataFrame, key: str, start: str, end: str, gap_s: float = 900) -> DataFrame:
    """Hours on in [start, end): each sample holds until the next, `gap_s` at most; the last one before start carries in."""
    lo, hi = micros(F.lit(start).cast("timestamp_ntz")), micros(F.lit(end).cast("timestamp_ntz"))
    t, gap = micros(F.col("ts")), F.lit(int(gap_s * 1e6))
    prior = samples.where((t < lo) & (t >= lo - gap)).groupBy(key).agg(F.max_by(is_running(), "ts").alias("on"))
    inside = samples.where((t >= lo) & (t < hi)).select(key, t.alias("t"), is_running().alias("on"))
    rows = inside.unionByName(prior.select(key, lo.alias("t"), "on"))
    held = F.least(F.coalesce(F.lead("t").over(Window.partitionBy(key).orderBy("t", "on")), hi) - F.col("t"), gap)
    return rows.withColumn("held", held).groupBy(key).agg((F.sum(F.when(F.col("on"), F.col("held")).otherwise(0)) / F.lit(3.6e9)).alias("hours"))


def spikes(samples: DataFrame, key: str, half: int = 5, k: float = 6.0) -> DataFrame:
    """Samples far from the median of their `half` neighbours on each side, in units of their MAD; full windows only."""
    w = Window.partitionBy(key).orderBy("ts")
    around = F.concat(F.collect_list("value").over(w.rowsBetween(-half, -1)), F.collect_list("value").over(w.rowsBetween(1, half)))
    median = lambda xs: (F.get(F.array_sort(xs), F.lit(half - 1)) + F.get(F.array_sort(xs), F.lit(half))) / 2
    rows = samples.withColumn("near", around).where(F.size("near") == 2 * half).withColumn("m", median(F.col("near")))
    floor = F.greatest(F.abs("m") * 0.001, F.lit(1e-6))
    # The MAD is at least the floor, so most samples drop out before it is worked out.
    rows = rows.where(F.abs(F.col("value") - F.col("m")) > k * 1.4826 * floor)
    rows = rows.withColumn("mad", median(F.transform("near", lambda x: F.abs(x - F.col("m")))))
    return rows.where(F.abs(F.col("value") - F.col("m")) > k * 1.4826 * F.greatest(F.col("mad"), floor)).drop("near", "m", "mad")


def edges(samples: DataFrame, key: str, target) -> DataFrame:
    """Samples equal to `target` whose predecessor existed and was not."""
    was = F.lag("value").over(Window.partitionBy(key).orderBy("ts"))
    return samples.withColumn("was", was).where((F.col("value") == target) & F.col("was").isNotNull() & (F.col("was") != target)).drop("was")


def edits(samples: DataFrame, key: str, start=None, end=None) -> DataFrame:
    """Samples that differ from their predecessor, within [start, end)."""
    rows = samples.withColumn("was", F.lag("value").over(Window.partitionBy(key).orderBy("ts"))).where("was is not null and was <> value")
    if start is not None:
        rows = rows.where((F.col("ts") >= start) & (F.col("ts") < end))
    return rows


def crossings(errors: DataFrame, key: str, deadband: float) -> DataFrame:
    """Sign changes between consecutive errors outside the dead band."""
    out = errors.where(F.abs("error") > deadband).withColumn("side", F.signum("error"))
    out = out.withColumn("was", F.lag("side").over(Window.partitionBy(key).orderBy("ts")))
    return out.groupBy(key).agg(F.count_if(F.col("was").isNotNull() & (F.col("was") != F.col("side"))).alias("crossings"))


def holds(samples: DataFrame, key: str, min_step: float, min_hold_s: float) -> DataFrame:
    """Steps of at least `min_step` with the time until the next step, kept when held long enough."""
    w = Window.partitionBy(key).orderBy("ts")
    step = samples.withColumn("was", F.lag("value").over(w)).where(F.abs(F.col("value") - F.col("was")) >= min_step)
    held = (micros(F.lead("ts").over(w)) - micros(F.col("ts"))) / F.lit(1e6)
    return step.withColumn("held_s", held).where(F.col("held_s") >= min_hold_s)


def install_intervals(events: DataFrame) -> DataFrame:
    """(asset_id, position, lo, hi) from install and remove events; at one time removal comes first."""
    w = Window.partitionBy("asset_id").orderBy("at", (F.col("kind") != "remove").cast("int"), "id")
    return events.withColumn("hi", F.lead("at").over(w)).where("kind = 'install'").select("asset_id", "position", F.col("at").alias("lo"), "hi")


def replacements(intervals: DataFrame) -> DataFrame:
    """Consecutive assets at a position."""
    w = Window.partitionBy("position").orderBy("lo", "asset_id")
    return intervals.withColumn("previous", F.lag("asset_id").over(w)).where("previous is not null").select("position", "previous", "asset_id", F.col("lo").alias("at"))


def merge_ranges(ranges: DataFrame, key: str) -> DataFrame:
    """Union of overlapping or touching [lo, hi) ranges per key."""
    w = Window.partitionBy(key).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = ranges.withColumn("fresh", F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0)).withColumn("island", F.sum("fresh").over(w))
    return rows.groupBy(key, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def gaps_in(ranges: DataFrame, key: str, lo, hi) -> DataFrame:
    """What [lo, hi) has besides the merged ranges of each key."""
    merged = merge_ranges(ranges, key)
    w = Window.partitionBy(key).orderBy("lo")
    after = merged.select(key, F.col("hi").alias("a"), F.coalesce(F.lead("lo").over(w), hi).alias("b"))
    before = merged.groupBy(key).agg(lo.alias("a"), F.min("lo").alias("b"))
    return after.unionByName(before).where("a < b").select(key, F.col("a").alias("lo"), F.col("b").alias("hi"))
