"""Sample quality: plausible ranges, unit suspicion, spikes, and the order in which they judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantflow.operators.windows import spikes

# Words of the class, unit, low, high; the first row that fits counts.
PLAUSIBLE = [
    ("zone air temperature", "°F", 32, 120),
    ("zone air temperature", "°C", 0, 50),
    ("outside air temperature", "°F", -60, 140),
    ("outside air temperature", "°C", -50, 60),
    ("air temperature", "°F", -40, 200),
    ("air temperature", "°C", -40, 95),
    ("water temperature", "°F", 32, 260),
    ("water temperature", "°C", 0, 127),
    ("temperature", "°F", -60, 300),
    ("temperature", "°C", -50, 150),
    ("humidity", "%RH", 0, 100),
    ("humidity", "%", 0, 100),
    ("position", "%", 0, 100),
    ("damper", "%", 0, 100),
    ("valve", "%", 0, 100),
    ("speed", "%", 0, 100),
    ("co2", "ppm", 0, 10000),
]


def plausible(points: DataFrame) -> DataFrame:
    """(point_uri, lo, hi) for points (point_uri, brick_class, unit) that some row fits; the table is 17 rows."""
    spark = points.sparkSession
    rows = spark.createDataFrame([(i, w.split(), u, float(a), float(b)) for i, (w, u, a, b) in enumerate(PLAUSIBLE)], "ord int, words array<string>, unit string, lo double, hi double")
    words = F.split(F.lower("brick_class"), "_")
    fits = points.withColumn("class_words", words).join(F.broadcast(rows), "unit").where(F.size(F.array_except("words", "class_words")) == 0)
    return fits.groupBy("point_uri").agg(F.min_by(F.struct("lo", "hi"), "ord").alias("r")).select("point_uri", "r.*")


def to_celsius(value: Column) -> Column:
    return (value - 32) / 1.8


def to_fahrenheit(value: Column) -> Column:
    return value * 1.8 + 32


def unit_suspects(samples: DataFrame, lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> DataFrame:
    """Points of 10 samples or more whose median is outside the own range, 90 % at most inside it, and all inside the other unit's."""
    inside = F.col("value").between(lo, hi)
    stats = samples.groupBy("point_uri").agg(
        F.count("value").alias("n"),
        F.median("value").alias("m"),
        F.avg(inside.cast("int")).alias("own"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
        F.first(lo).alias("lo"),
        F.first(hi).alias("hi"),
        F.first(other_lo).alias("olo"),
        F.first(other_hi).alias("ohi"),
    )
    return stats.where("n >= 10 and (m < lo or m > hi) and own <= 0.9 and least >= olo and most <= ohi").select("point_uri", "n", "m")


def judge(samples: DataFrame, suspects: DataFrame, lo: float, hi: float) -> DataFrame:
    """Quality filled where it was null: unit_suspect, then out_of_range, then spike among what is still good."""
    rows = samples.join(suspects.select("point_uri", F.lit(True).alias("suspect")), "point_uri", "left")
    numeric = F.col("value").isNotNull() & F.col("quality").isNull()
    first = F.when(numeric & F.col("suspect"), "unit_suspect").when(numeric & ~F.col("value").between(lo, hi), "out_of_range")
    staged = rows.withColumn("quality", F.coalesce("quality", first)).drop("suspect")
    still = staged.where("quality is null and value is not null")
    jumps = spikes(still.select("point_uri", "ts", "value"), "point_uri").select("point_uri", "ts", F.lit("spike").alias("jump"))
    return staged.join(jumps, ["point_uri", "ts"], "left").withColumn("quality", F.coalesce("quality", "jump")).drop("jump")


def from_envelope(flags: Column, reliability: Column) -> Column:
    """Device flags to one quality: out of service, then fault, then overridden."""
    return (
        F.when(F.array_contains(flags, "out-of-service"), "out_of_service")
        .when(F.array_contains(flags, "fault") | (reliability.isNotNull() & (reliability != "no-fault-detected")), "fault")
        .when(F.array_contains(flags, "overridden"), "overridden")
    )
