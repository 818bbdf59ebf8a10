"""Control loops that hunt: rates now, at the baseline and by day, since when, and what changed around that time.

A loop has a sensor and its setpoint, and any number of commands. Its rate is the largest of its commands'
reversals an hour, else the zero crossings an hour of sensor minus setpoint. Every sample is
put into the windows that it belongs to (now, baseline, each of the last days), and all windows of all
loops are measured at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantflow.operators import rules, windows
from plantflow.operators.blocks import median, with_previous
from plantflow.operators.timejoin import asof, micros

DAY_US = 86_400_000_000


@dataclass(frozen=True)
class Limits:
    ratio: float = 3.0
    least_rate: float = 12.0  # the limit of loops without a baseline
    floor: float = 1.0  # no limit is below it
    command_deadband: float = 2.0
    error_deadband: float = 0.5
    min_samples: int = 10
    max_interval_s: float = 60.0
    hours: float = 24.0
    days: int = 7


def placed(samples: DataFrame, members: DataFrame, baselines: DataFrame, now: Column, limits: Limits) -> DataFrame:
    """(loop, role, point, window, ts, value): samples (point, ts, value) in the windows of their loops.

    `members` is (loop, role, point) with roles sensor, setpoint and command, `baselines` (loop, lo, hi). Windows are
    'now', 'base' and the days '0' (the last), '1' and so on; all without their ends but 'now'.
    """
    rows = samples.where("value is not null").join(members, "point").join(baselines, "loop", "left")
    age = micros(now) - micros(F.col("ts"))
    day = F.ceil(age / F.lit(DAY_US)).cast("int") - 1  # a day ends where the next begins, and holds its beginning
    fits = F.array_compact(F.array(
        F.when((age >= 0) & (age <= int(limits.hours * 3.6e9)), "now"),
        F.when((F.col("ts") >= F.col("lo")) & (F.col("ts") < F.col("hi")), "base"),
        F.when((age > 0) & (day < limits.days), day.cast("string")),
    ))
    return rows.select("loop", "role", "point", F.explode(fits).alias("window"), "ts", "value")


def sampling(rows: DataFrame, key: str, limits: Limits) -> DataFrame:
    """(key, hours) of the series that are sampled densely enough to be judged."""
    gap = (micros(F.col("ts")) - micros(F.col("previous.ts"))) / F.lit(1e6)
    moves = with_previous(rows.select(key, "ts", "value"), key).withColumn("gap", gap)
    span = (F.max(micros(F.col("ts"))) - F.min(micros(F.col("ts")))) / F.lit(3.6e9)
    sums = moves.groupBy(key).agg(F.count("*").alias("n"), span.alias("hours")).join(median(moves, key, "gap"), key)
    return sums.where((F.col("n") >= limits.min_samples) & (F.col("hours") > 0) & (F.col("gap") <= limits.max_interval_s)).select(key, "hours")


def rates(inside: DataFrame, limits: Limits) -> DataFrame:
    """(loop, window, rate) of the windows that can be judged; `inside` comes from `placed`."""
    series = inside.where("role = 'command'").withColumn("series", F.struct("loop", "window", "point"))
    commands = rules.hunting(series.select("series", "ts", "value"), "series", limits.command_deadband, 0.0, limits.min_samples, limits.max_interval_s)
    worst = commands.where("judged").groupBy("series.loop", "series.window").agg(F.max(F.round("rate", 2)).alias("worst"))
    pair = inside.withColumn("series", F.struct("loop", "window"))
    side = lambda role: pair.where(F.col("role") == role).select("series", "ts", "value")
    error = asof(side("sensor"), side("setpoint"), "series").where("match is not null")
    error = error.select("series", "ts", (F.col("value") - F.col("match")).alias("error"))
    judged = sampling(error.withColumnRenamed("error", "value"), "series", limits)
    crossed = judged.join(windows.crossings(error, "series", limits.error_deadband), "series", "left")
    rate = F.round(F.coalesce("crossings", F.lit(0)) / F.col("hours"), 2)
    errors = crossed.select("series.loop", "series.window", rate.alias("error_rate"))
    return worst.join(errors, ["loop", "window"], "full_outer").select("loop", "window", F.coalesce("worst", "error_rate").alias("rate"))


def report(samples: DataFrame, members: DataFrame, baselines: DataFrame, now: Column, limits: Limits = Limits()) -> DataFrame:
    """(loop, rate, base, ratio, threshold, verdict, onset) of every loop.

    The verdict is hunting above the threshold, `ratio` times the baseline and `floor` at least, steady, or inconclusive without a
    rate. Onset is the first day of the run of days above it that reaches to now; a day that can't be judged ends the run.
    """
    found = rates(placed(samples, members, baselines, now, limits), limits)
    by_window = found.groupBy("loop").agg(F.map_from_entries(F.collect_list(F.struct("window", "rate"))).alias("rates"))
    rows = members.select("loop").distinct().join(by_window, "loop", "left")
    at = lambda window: F.try_element_at("rates", window)
    rows = rows.withColumns({"rate": at(F.lit("now")), "base": at(F.lit("base"))})
    threshold = F.greatest(F.coalesce(F.col("base") * limits.ratio, F.lit(limits.least_rate)), F.lit(limits.floor))
    rows = rows.withColumn("threshold", F.round(threshold, 2)).withColumn("limit", threshold)
    verdict = F.when(F.col("rate").isNull(), "inconclusive").when(F.col("rate") > F.col("limit"), "hunting").otherwise("steady")
    quiet = F.filter(F.sequence(F.lit(0), F.lit(limits.days - 1)), lambda d: ~F.coalesce(at(d.cast("string")) > F.col("limit"), F.lit(False)))
    run = F.coalesce(F.array_min(quiet), F.lit(limits.days))
    onset = F.when((F.col("verdict") == "hunting") & (run > 0), F.timestamp_micros(micros(now) - run * F.lit(DAY_US)).cast("timestamp_ntz"))
    ratio = F.round(F.col("rate") / F.greatest("base", F.lit(1.0)), 2)
    return rows.withColumn("verdict", verdict).select("loop", "rate", "base", F.when(F.col("base").isNotNull(), ratio).alias("ratio"), "threshold", "verdict", onset.alias("onset"))


def causes(found: DataFrame, samples: DataFrame, members: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """(loop, at, kind, was, value, detail): what changed within a day either side of the onset of each hunting loop.

    Edits of the setpoint, told from its sample before (of two days before the onset at most), and `events` (loop, at, kind, detail) of any tables.
    """
    near = found.where("onset is not null").select("loop", (F.col("onset") - F.expr("interval 1 day")).alias("lo"), F.least(now, F.col("onset") + F.expr("interval 1 day")).alias("hi"))
    points = members.where("role = 'setpoint'").join(near, "loop").select("loop", "point", "lo", "hi")
    read = samples.where("value is not null").join(points, "point").where((F.col("ts") >= F.col("lo") - F.expr("interval 1 day")) & (F.col("ts") < F.col("hi")))
    edits = with_previous(read.select("loop", "ts", "value"), "loop").join(near, "loop")
    edits = edits.where((F.col("ts") >= F.col("lo")) & (F.col("previous.value") != F.col("value")))
    edits = edits.select("loop", F.col("ts").alias("at"), F.lit("setpoint_edit").alias("kind"), F.col("previous.value").alias("was"), "value", F.lit(None).cast("string").alias("detail"))
    none = F.lit(None).cast("double")
    others = events.join(near, "loop").where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    return edits.unionByName(others.select("loop", "at", F.concat(F.lit("asset_"), "kind").alias("kind"), none.alias("was"), none.alias("value"), "detail"))
