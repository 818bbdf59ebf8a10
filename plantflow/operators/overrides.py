"""Passive override tests: steps that someone held on a point, why a step is no override, and whether the equipment followed.

A plan of sweeps in time. Holds are found on the changes of a series; joins as of a time and nearest in
time bring in writes of our own, schedule changes, levels held in a priority array and
occupancy; samples of the response meet the holds by coarse slots of time. Nothing is gathered
by point.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantflow.operators.blocks import with_previous
from plantflow.operators.timejoin import asof, micros, nearest

KINDS = ("state", "relative", "absolute")


def _moved(kind: str, step: float):
    """Whether two values differ by a step: of an on/off state, by a share of the first, or absolutely."""
    return {
        "state": lambda a, b: (a > 0.5) != (b > 0.5),
        "relative": lambda a, b: abs(b - a) / max(abs(a), 1e-9) >= step,
        "absolute": lambda a, b: abs(b - a) >= step,
    }[kind]


def steps(samples: DataFrame, key: str, step: float, kind: str = "absolute") -> DataFrame:
    """(key, at, value, previous, held_until, released) of every step of a series (key, ts, value).

    A step is a change from one sample to the next; it holds until a value that is a step away
    from it, null where that never came. A step that ends a hold and returns to the value before it is its release.

    Only samples that differ from the one before can matter; they are found by blocks of time, and one
    ordered pass over these changes keeps a state of fixed size.
    """
    rows = samples.where(F.col(key).isNotNull() & F.col("value").isNotNull()).select(key, "ts", F.col("value").cast("double").alias("value"))
    changes = with_previous(rows, key).where(F.col("previous").isNull() | (F.col("previous.value") != F.col("value")))
    changes = changes.select(key, "ts", "value", F.col("previous.value").alias("previous"))
    far = _moved(kind, step)
    names = [key, "at", "value", "previous", "held_until", "released"]

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, hold = None, None
        for frame in frames:
            out = []
            for name, at, value, before in zip(frame[key], frame["ts"], frame["value"], frame["previous"]):
                if name != series:
                    if hold is not None:
                        out.append((series, *hold[:3], None, hold[3]))
                    series, hold = name, None
                ended = None
                if hold is not None:
                    if not far(hold[1], value):
                        continue
                    out.append((name, *hold[:3], at, hold[3]))
                    ended, hold = hold, None
                if not pd.isna(before) and far(before, value):
                    back = ended is not None and not ended[3] and not far(ended[2], value)
                    hold = (at, value, before, back)
            yield _frame(out)
        if hold is not None:
            yield _frame([(series, *hold[:3], None, hold[3])])

    def _frame(found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=names).astype({"at": "datetime64[us]", "held_until": "datetime64[us]", "released": bool, "value": float, "previous": float})

    stamp = dict(rows.dtypes)["ts"]
    schema = f"`{key}` {dict(rows.dtypes)[key]}, at {stamp}, value double, previous double, held_until {stamp}, released boolean"
    return changes.repartition(key).sortWithinPartitions(key, "ts", "value").mapInPandas(walk, schema)


def _close(rows: DataFrame, others: DataFrame, key: str, slack_s: float) -> DataFrame:
    """(key, at, True) of rows with one of `others` (key, ts) within `slack_s`."""
    marks = others.select(key, "ts", F.lit(1.0).alias("value"))
    return nearest(rows.select(key, F.col("at").alias("ts")), marks, key, slack_s).select(key, F.col("ts").alias("at"), F.lit(True).alias("hit"))


def _level(rows: DataFrame, held: DataFrame, key: str, now: Column) -> DataFrame:
    """`rows` with `level`: the one in force at the step, else the first seen while it stood. `held` is (key, ts, level), level null where nobody holds one."""
    at = rows.withColumn("ts", F.col("at"))
    level = held.select(key, "ts", F.col("level").cast("double").alias("value"))
    before = asof(at, level, key).withColumnRenamed("match", "before").drop("match_ts")
    after = asof(before, level.where("value is not null"), key, direction="forward")
    inside = F.col("match_ts") <= F.coalesce("held_until", now)
    return after.withColumn("level", F.coalesce("before", F.when(inside, F.col("match"))).cast("int")).drop("ts", "before", "match", "match_ts")


def detect(samples: DataFrame, key: str, step: float, now: Column, kind: str = "absolute", min_hold_s: float = 600, own: DataFrame | None = None, own_slack_s: float = 120,
           schedule: DataFrame | None = None, schedule_slack_s: float = 300, held: DataFrame | None = None, need_level: bool = False) -> DataFrame:
    """All steps (key, at, value, previous, held_until, level, verdict).

    verdict is 'override', or why it is none, by the first that holds: release, not_held, standing (too short so far), own (near a write of ours),
    schedule (near a transition of a schedule), no_level (where a level of the priority array is asked for).
    """
    rows = steps(samples, key, step, kind)
    for name, table, slack in (("own", own, own_slack_s), ("schedule", schedule, schedule_slack_s)):
        if table is None:
            rows = rows.withColumn(name, F.lit(False))
        else:
            rows = rows.join(_close(rows, table, key, slack), [key, "at"], "left").withColumn(name, F.col("hit").isNotNull()).drop("hit")
    rows = _level(rows, held, key, now) if held is not None else rows.withColumn("level", F.lit(None).cast("int"))
    short = micros(F.coalesce("held_until", now)) - micros(F.col("at")) < int(min_hold_s * 1e6)
    verdict = (
        F.when(F.col("released"), "release")
        .when(short & F.col("held_until").isNotNull(), "not_held")
        .when(short, "standing")
        .when(F.col("own"), "own")
        .when(F.col("schedule"), "schedule")
        .when(F.lit(need_level) & F.col("level").isNull(), "no_level")
        .otherwise("override")
    )
    return rows.select(key, "at", "value", "previous", "held_until", "level", verdict.alias("verdict"))


def reached(kind: str, target: Column, value: Column, tolerance: float) -> Column:
    if kind == "state":
        return (value > 0.5) == (target > 0.5)
    gap = F.abs(value - target)
    return (target > 0) & (gap <= tolerance * target) if kind == "relative" else gap <= tolerance


def judge(overrides: DataFrame, responses: DataFrame, key: str, tolerance: float, now: Column, kind: str = "absolute", within_s: float = 1800, unoccupied: DataFrame | None = None) -> DataFrame:
    """(key, at, value, status, reached_at, closest) of each override by its response (key, ts, value).

    pass once the response reaches the value while the override stands, in time; pending while there is time left. Else not_applicable
    where the equipment was unoccupied at some moment (`unoccupied`: key, ts, value 1 or 0 from then on), inconclusive without
    samples or where it was released too early, and fail.
    """
    wide = int(within_s * 1e6)
    slot = lambda c: F.floor(micros(c) / F.lit(wide))
    deadline = micros(F.col("at")) + wide
    end = F.least(deadline, F.coalesce(micros(F.col("held_until")), deadline), micros(now))
    asked = overrides.select(key, "at", "value", "held_until").withColumns({"deadline": deadline, "end": end})
    slots = asked.withColumn("slot", F.explode(F.array(slot(F.col("at")), slot(F.col("at")) + 1)))
    seen = slots.join(responses.where("value is not null").select(key, F.col("ts").alias("rt"), F.col("value").alias("rv"), slot(F.col("ts")).alias("slot")), [key, "slot"])
    seen = seen.where((F.col("rt") >= F.col("at")) & (micros(F.col("rt")) <= F.col("end")))
    hit = reached(kind, F.col("value"), F.col("rv"), tolerance)
    stats = seen.groupBy(key, "at").agg(
        F.count("*").alias("n"), F.min(F.when(hit, F.col("rt"))).alias("reached_at"), F.min_by("rv", F.struct(F.abs(F.col("rv") - F.col("value")), "rt")).alias("closest")
    )
    rows = asked.join(stats, [key, "at"], "left")
    if unoccupied is None or kind == "state":
        rows = rows.withColumn("empty", F.lit(False))
    else:
        state = asof(rows.withColumn("ts", F.col("at")), unoccupied, key).withColumnRenamed("match", "then").drop("match_ts")
        state = asof(state, unoccupied.where("value = 1"), key, direction="forward")
        during = F.coalesce(micros(F.col("match_ts")) <= F.col("end"), F.lit(False))
        rows = state.withColumn("empty", (F.coalesce("then", F.lit(0)) == 1) | during).drop("ts", "then", "match", "match_ts")
    out_of_time = (F.col("deadline") <= micros(now)) | F.coalesce(F.col("held_until") <= now, F.lit(False))
    status = (
        F.when(F.col("reached_at").isNotNull(), "pass")
        .when(~out_of_time, "pending")
        .when(F.col("empty"), "not_applicable")
        .when(F.col("n").isNull(), "inconclusive")
        .when(F.coalesce(micros(F.col("held_until")) < F.col("deadline"), F.lit(False)), "inconclusive")
        .otherwise("fail")
    )
    return rows.select(key, "at", "value", status.alias("status"), "reached_at", "closest")


def summary(found: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """(key, status, judged, pending, excluded): a point's result is that of its latest judged override; points without one have none."""
    done = judged.where("status <> 'pending'").groupBy(key).agg(F.max_by("status", "at").alias("status"), F.count("*").alias("judged"))
    pending = judged.where("status = 'pending'").groupBy(key).agg(F.count("*").alias("pending"))
    out = found.where("verdict not in ('override', 'standing')").groupBy(key).agg(F.count("*").alias("excluded"))
    full = done.join(pending, key, "left").join(out, key, "left")
    return full.select(key, "status", "judged", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("pending", "excluded")))
