"""Series cut into blocks of time, so that one long series is many tasks.

What a row needs from the row before it is a lag inside its block and, for the first row of a
block, the last row of the block before, which a window over one row per block finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantflow.operators.timejoin import micros

DAY_S = 86_400


def block_of(ts: Column, seconds: float = DAY_S) -> Column:
    return F.floor(micros(ts) / F.lit(int(seconds * 1_000_000)))


def with_previous(rows: DataFrame, key: str, column: str = "previous", seconds: float = DAY_S) -> DataFrame:
    """`rows` (key, ts, value) with a struct (ts, value) of the row before in the series, by time and value."""
    seen = F.struct("ts", "value")
    blocked = rows.withColumn("__block", block_of(F.col("ts"), seconds)).where(F.col(key).isNotNull() & F.col("__block").isNotNull()).repartition(key, "__block")
    ends = blocked.groupBy(key, "__block").agg(F.max(seen).alias("__last"))
    ends = ends.select(key, "__block", F.lag("__last").over(Window.partitionBy(key).orderBy("__block")).alias("__carried"))
    inside = F.lag(seen).over(Window.partitionBy(key, "__block").orderBy("ts", "value"))
    out = blocked.withColumn("__inside", inside).join(ends, [key, "__block"], "left")  # all have ends; a left join never builds on the samples, so equal rows stay in order
    return out.withColumn(column, F.coalesce("__inside", "__carried")).drop("__block", "__inside", "__carried")


def median(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, column): exact medians by selection in two steps.

    Equal values are counted first. Counts of coarse steps of the value, a few thousand for a
    key at most, show which steps hold the middle; only their values are ranked.
    """
    value, w = F.col(column), Window.partitionBy(key)
    counts = rows.where(value.isNotNull()).groupBy(key, column).agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__step", (F.signum(value) * F.floor(F.log1p(F.abs(value) * 1e6) * 128)).cast("long"))
    steps = counts.groupBy(key, "__step").agg(F.sum("__n").alias("__in"))
    upto = F.sum("__in").over(w.orderBy("__step"))
    steps = steps.withColumns({"__before": upto - F.col("__in"), "__all": F.sum("__in").over(w)})
    # The middle places, from 1: both the same where the count is odd.
    low, high = F.floor((F.col("__all") + 1) / 2), F.floor(F.col("__all") / 2) + 1
    steps = steps.where((F.col("__before") < high) & (F.col("__before") + F.col("__in") >= low))
    ranked = counts.join(steps.drop("__in"), [key, "__step"])
    upto = F.col("__before") + F.sum("__n").over(Window.partitionBy(key, "__step").orderBy(column))
    ranked = ranked.withColumn("__upto", upto)
    place = lambda at: (F.col("__upto") >= at) & (F.col("__upto") - F.col("__n") < at)
    lower, upper = F.max(F.when(place(low), value)), F.max(F.when(place(high), value))
    return ranked.groupBy(key).agg(((lower + upper) / 2).alias(column))
