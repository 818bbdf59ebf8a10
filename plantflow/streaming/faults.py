"""Streams: stateful fault intervals, late samples, windowed rollups, alert timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FAULT_SCHEMA = "point_uri string, action string, at timestamp"


def fault_stream(readings: DataFrame, lo: float, hi: float) -> DataFrame:
    """Open and resolve events of a range rule, one open fault per point.

    Readings (point_uri, ts, value, quality) are judged in time order inside a batch; flagged
    ones neither open nor resolve. State is one boolean per point.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        is_open = state.get[0] if state.exists else False
        rows = pd.concat(list(frames)).sort_values("ts")
        rows = rows[rows["value"].notna() & (rows["quality"].isna() | (rows["quality"] == "ok"))]
        out = []
        for at, value in zip(rows["ts"], rows["value"]):
            bad = value < lo or value > hi
            if bad != is_open:
                out.append((key[0], "open" if bad else "resolve", at))
                is_open = bad
        state.update((bool(is_open),))
        yield pd.DataFrame(out, columns=["point_uri", "action", "at"])

    keyed = readings.select("point_uri", "ts", "value", "quality").groupBy("point_uri")
    return keyed.applyInPandasWithState(step, FAULT_SCHEMA, "open boolean", "append", GroupStateTimeout.NoTimeout)


def rollup_stream(readings: DataFrame, width: str = "5 minutes", delay: str = "30 seconds") -> DataFrame:
    """Tumbling partials that a watermark closes."""
    windowed = readings.withWatermark("ts", delay).groupBy("point_uri", F.window("ts", width).alias("w"))
    folds = windowed.agg(F.sum("value").alias("vsum"), F.count("value").alias("vcount"), F.min("value").alias("vmin"), F.max("value").alias("vmax"))
    return folds.select("point_uri", F.col("w.start").alias("bucket"), "vsum", "vcount", "vmin", "vmax")


def dedup_stream(readings: DataFrame, delay: str = "30 seconds") -> DataFrame:
    return readings.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["point_uri", "ts"])


def split_late(batch: DataFrame, judged_to: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(in time, late) rows of a micro-batch against each point's judged time; late rows are kept for judging again."""
    known = batch.join(judged_to, "point_uri", "left")
    late = F.coalesce(F.col("ts") <= F.col("judged_to"), F.lit(False))
    return known.where(~late).drop("judged_to"), known.where(late).drop("judged_to")


def alert_states(observed: DataFrame, for_s: float = 120, clear_s: float = 120) -> DataFrame:
    """Firing and resolved events from observations (key, ts, present) in time order.

    Pending fires after `for_s` of presence and is dropped if it vanishes before; firing
    resolves after `clear_s` of absence.
    """

    from pyspark.sql.window import Window

    w = Window.partitionBy("key").orderBy("ts")
    edge = F.coalesce((F.lag("present").over(w) != F.col("present")).cast("int"), F.lit(1))
    runs = observed.withColumn("run", F.sum(edge).over(w))
    start = F.min("ts").over(Window.partitionBy("key", "run"))
    held = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    wait = F.when(F.col("present"), int(for_s * 1e6)).otherwise(int(clear_s * 1e6))
    # The first sample of a run that has lasted long enough may fire or resolve, whatever the state was.
    ready = runs.withColumn("held", held).where(F.col("held") >= wait).groupBy("key", "run", "present").agg(F.min("ts").alias("at"))
    was = F.coalesce(F.lag("present").over(Window.partitionBy("key").orderBy("at")), F.lit(False))
    event = F.when(F.col("present"), "firing").otherwise("resolved")
    return ready.withColumn("was", was).where("present <> was").select("key", event.alias("event"), "at")


def alarm_events(states: DataFrame) -> DataFrame:
    """Open, update and resolve events of device alarms (key, ts, active, severity): only changes speak."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("key").orderBy("ts")
    rows = states.withColumn("was", F.coalesce(F.lag("active").over(w), F.lit(False))).withColumn("before", F.lag("severity").over(w))
    event = (
        F.when(F.col("active") & ~F.col("was"), "open")
        .when(F.col("active") & F.col("was") & (F.col("severity") != F.col("before")), "update")
        .when(~F.col("active") & F.col("was"), "resolve")
    )
    return rows.withColumn("event", event).where("event is not null").select("key", "ts", "event", "severity")


def judge_late(history: DataFrame, late: DataFrame, judge, half: int = 5) -> DataFrame:
    """Late samples (point_uri, ts) that `judge` marks among their neighbours.

    Each late sample is judged with the `half` stored samples before and after it, so only the
    neighbourhoods of late samples are read again. `judge` takes and returns samples.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy("point_uri").orderBy("ts")
    marked = history.join(late.select("point_uri", "ts", F.lit(True).alias("late")), ["point_uri", "ts"], "left")
    near = F.max(F.coalesce("late", F.lit(False)).cast("int")).over(w.rowsBetween(-2 * half, 2 * half)) == 1
    found = judge(marked.withColumn("near", near).where("near").drop("near"))
    return found.where("late").drop("late")


def to_judge(history: DataFrame, judged: DataFrame, overlap_s: float, now) -> DataFrame:
    """Samples in (judged_to - overlap, now] of each point; a point never judged is judged whole."""
    from plantflow.operators.timejoin import micros

    rows = history.join(judged, "point_uri", "left")
    after = F.col("judged_to").isNull() | (micros(F.col("ts")) > micros(F.col("judged_to")) - int(overlap_s * 1e6))
    return rows.where(after & (F.col("ts") <= now)).drop("judged_to")


def overlap_for(delay_s: float, interval_s: float, least_s: float = 30.0) -> float:
    """Overlap widened to a quarter more than the usual delay, an interval at most."""
    return max(least_s, min(1.25 * delay_s, interval_s))


def poll(watches: DataFrame, ids: DataFrame, records: DataFrame, sent: DataFrame, now) -> DataFrame:
    """(watch, id, record) that polls return: records of a watch's ids that differ from what it was sent last.

    Watches are (watch, polled, lease_s): one not polled within its lease has expired. `ids` is (watch, id),
    records (id, record), sent (watch, id, record).
    """
    from plantflow.operators.timejoin import micros

    live = watches.where(micros(F.col("polled")) + F.col("lease_s") * 1_000_000 > micros(now))
    last = sent.select("watch", "id", F.col("record").alias("last"), F.lit(True).alias("known"))
    rows = ids.join(live, "watch", "left_semi").join(records, "id").join(last, ["watch", "id"], "left")
    return rows.where(F.col("known").isNull() | ~F.col("record").eqNullSafe(F.col("last"))).select("watch", "id", "record")
