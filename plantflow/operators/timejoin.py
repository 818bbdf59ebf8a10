"""Joins in time: as-of, nearest, held grids, intervals. All partition by series and sort once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def asof(left: DataFrame, right: DataFrame, key: str, value: str = "value", direction: str = "backward") -> DataFrame:
    """`left` (key, ts, ...) with the value and time of the nearest `right` row at or before (after) it.

    A union and one window: no range join, so a series costs its length, not a product. Of right
    rows at one time the largest value counts. Rows without a match get nulls.
    """
    extra = [c for c in left.columns if c not in (key, "ts")]
    a = left.select(key, "ts", F.lit(1).alias("__side"), F.struct(*extra).alias("__left") if extra else F.struct(F.lit(0).alias("__none")).alias("__left"))
    a = a.withColumn("__right", F.lit(None).cast(f"struct<t:timestamp_ntz,v:{dict(right.dtypes)[value]}>"))
    b = right.select(key, "ts", F.lit(0).alias("__side"), F.struct(F.col("ts").alias("t"), F.col(value).alias("v")).alias("__right"))
    both = a.unionByName(b, allowMissingColumns=True)
    if direction == "backward":
        w = Window.partitionBy(key).orderBy("ts", "__side", "__right").rowsBetween(Window.unboundedPreceding, 0)
        found = F.last("__right", ignorenulls=True).over(w)
    else:
        w = Window.partitionBy(key).orderBy(F.desc("ts"), "__side", "__right").rowsBetween(Window.unboundedPreceding, 0)
        found = F.last("__right", ignorenulls=True).over(w)
    out = both.withColumn("__found", found).where("__side = 1")
    return out.select(key, "ts", *(F.col(f"__left.{c}").alias(c) for c in extra), F.col("__found.t").alias("match_ts"), F.col("__found.v").alias("match"))


def nearest(left: DataFrame, right: DataFrame, key: str, tolerance_s: float) -> DataFrame:
    """Each left row with the closest right value within the tolerance; of two equally near the later."""
    back = asof(left, right, key).withColumnRenamed("match_ts", "bt").withColumnRenamed("match", "bv")
    both = asof(back, right, key, direction="forward").withColumnRenamed("match_ts", "ft").withColumnRenamed("match", "fv")
    before, after = micros(F.col("ts")) - micros(F.col("bt")), micros(F.col("ft")) - micros(F.col("ts"))
    later = before.isNull() | (after <= before)
    gap = F.when(later, after).otherwise(before)
    picked = both.withColumn("match_ts", F.when(later, F.col("ft")).otherwise(F.col("bt"))).withColumn("match", F.when(later, F.col("fv")).otherwise(F.col("bv")))
    return picked.where(gap <= tolerance_s * 1e6).drop("bt", "bv", "ft", "fv")


def grid(spans: DataFrame, seconds: int) -> DataFrame:
    """(key, ts) every `seconds` from each row's `lo` to its `hi`."""
    steps = F.sequence(micros(F.col("lo")), micros(F.col("hi")), F.lit(seconds * 1_000_000))
    return spans.select(*[c for c in spans.columns if c not in ("lo", "hi")], F.explode(steps).alias("us")).withColumn(
        "ts", F.timestamp_micros("us").cast("timestamp_ntz")
    ).drop("us")


def held_grid(samples: DataFrame, spans: DataFrame, key: str, seconds: int, hold_steps: int) -> DataFrame:
    """As-of values on a regular grid; a value older than `hold_steps` steps is null."""
    on = asof(grid(spans, seconds), samples, key)
    fresh = micros(F.col("ts")) - micros(F.col("match_ts")) <= hold_steps * seconds * 1_000_000
    return on.select(key, "ts", F.when(fresh, F.col("match")).alias("value"))


def aligned(samples: DataFrame, key: str, role: str, seconds: int, limit: int = 3) -> DataFrame:
    """One row per key and step, one column per role: last value of the step, carried `limit` steps, complete rows only."""
    step = seconds * 1_000_000
    bucket = F.floor(micros(F.col("ts")) / F.lit(step))
    last = samples.groupBy(key, role, bucket.alias("b")).agg(F.max_by("value", "ts").alias("v"))
    ends = last.groupBy(key).agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
    roles = samples.select(key, role).distinct()
    full = ends.join(roles, key).select(key, role, F.explode(F.sequence("lo", "hi")).alias("b")).join(last, [key, role, "b"], "left")
    w = Window.partitionBy(key, role).orderBy("b").rowsBetween(-limit, 0)
    filled = full.withColumn("v", F.last("v", ignorenulls=True).over(w))
    return filled.where("v is not null").withColumn("ts", F.timestamp_micros(F.col("b") * F.lit(step)).cast("timestamp_ntz")).select(key, role, "ts", "v")


def in_interval(points: DataFrame, intervals: DataFrame, key: str, inclusive_end: bool = False) -> DataFrame:
    """Rows of `points` (key, at) with the interval [lo, hi) of the same key that holds them; open ends are null."""
    end = F.col("at") <= F.col("hi") if inclusive_end else F.col("at") < F.col("hi")
    return points.join(intervals, key).where((F.col("at") >= F.col("lo")) & (F.col("hi").isNull() | end))


def state_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Change of status per key between two runs (columns key, status)."""
    a, b = before.select(key, F.col("status").alias("was")), after.select(key, F.col("status").alias("now"))
    change = (
        F.when(F.col("was").isNull(), "new")
        .when(F.col("now").isNull(), "gone")
        .when((F.col("was") == F.col("now")) & (F.col("now") == "fail"), "still_failing")
        .when((F.col("was") == F.col("now")) & (F.col("now") == "pass"), "still_passing")
        .when(F.col("was") == F.col("now"), "unchanged")
        .when((F.col("now") == "pass") & F.col("was").isin("fail", "inconclusive"), "resolved")
        .when(F.col("now") == "fail", "regressed")
        .otherwise("changed")
    )
    return a.join(b, key, "full_outer").select(key, "was", "now", change.alias("change"))


def edge_response(triggers: DataFrame, responses: DataFrame, key: str, target: float, within_s: float) -> DataFrame:
    """Swing of the response in [edge, edge + within] after every edge of the trigger to `target`.

    Edges and responses meet by key and coarse time slot, so pairs stay local in time.
    """
    w = Window.partitionBy(key).orderBy("ts")
    edges = triggers.withColumn("was", F.lag("value").over(w)).where((F.col("value") == target) & F.col("was").isNotNull() & (F.col("was") != target))
    slot = lambda c: F.floor(micros(c) / F.lit(within_s * 1e6))
    edges = edges.select(key, F.col("ts").alias("edge"), F.explode(F.array(slot(F.col("ts")), slot(F.col("ts")) + 1)).alias("slot"))
    near = edges.join(responses.withColumn("slot", slot(F.col("ts"))), [key, "slot"])
    near = near.where((F.col("ts") >= F.col("edge")) & (micros(F.col("ts")) - micros(F.col("edge")) <= within_s * 1e6))
    return near.groupBy(key, "edge").agg((F.max("value") - F.min("value")).alias("swing"), F.count("*").alias("n")).where("n >= 2")
