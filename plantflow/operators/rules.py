"""Rules over histories: stale, stuck, range and hunting, with resolve and masking logic."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantflow.operators.blocks import DAY_S, block_of, median, with_previous
from plantflow.operators.timejoin import micros
from plantflow.session import cut
from plantflow.sources.history import good


def glob_filter(column: str, glob: str) -> Column:
    """Glob match whose literal head also reaches the file scan."""
    import fnmatch

    head = glob[: min([len(glob), *(glob.find(c) for c in "*?[" if c in glob)])]
    return F.col(column).startswith(head) & F.col(column).rlike(fnmatch.translate(glob).replace(r"\Z", "$").replace(r"\z", "$").replace("(?>", "(?:"))


def stale(history: DataFrame, now, max_age_s: float) -> DataFrame:
    """Points whose newest sample is too old; a point never heard of is not stale."""
    newest = history.groupBy("point_uri").agg(F.max("ts").alias("newest"))
    return newest.where(micros(now) - micros(F.col("newest")) >= max_age_s * 1e6)


def value_key() -> Column:
    return F.coalesce(F.concat(F.lit("b"), F.col("value_bool").cast("string")), F.concat(F.lit("t"), F.col("value_text")), F.concat(F.lit("n"), F.col("value").cast("string")))


def stuck(history: DataFrame, since) -> DataFrame:
    """Points whose good samples since `since` have exactly one value: smallest and largest key agree."""
    rows = history.where(good() & (F.col("ts") >= since))
    keys = rows.groupBy("point_uri").agg(F.min(value_key()).alias("lo"), F.max(value_key()).alias("hi"), F.count("*").alias("n"))
    return keys.where("lo = hi").select("point_uri", "n")


def out_of_range(history: DataFrame, lo: float | None, hi: float | None) -> DataFrame:
    """Numeric samples outside the limits; other kinds never fault."""
    low = F.col("value") < lo if lo is not None else F.lit(False)
    high = F.col("value") > hi if hi is not None else F.lit(False)
    return history.where(F.col("value").isNotNull() & (low | high))


class Zigzag:
    """Follows one series and tells each extreme once a reversal beyond the dead band confirms it; its state has a fixed size."""

    def __init__(self, at, value: float, deadband: float):
        self.deadband, self.direction = deadband, 0
        self.anchor, self.best = value, (at, value)

    def step(self, at, value: float) -> tuple | None:
        """The extreme (at, value) that this sample confirms, if any."""
        ahead = self.direction * (value - self.best[1])
        if self.direction == 0:
            if abs(value - self.anchor) > self.deadband:
                self.direction, self.best = (1 if value > self.anchor else -1), (at, value)
        elif ahead >= 0:
            self.best = (at, value)
        elif -ahead > self.deadband:
            turn, self.best, self.direction = self.best, (at, value), -self.direction
            return turn
        return None


class BlockWalk:
    """The walk through one block of a series without what came before it.

    While the block's values span no more than the dead band, the state depends on the state at
    entry; its lowest and highest sample tell all that matters. The first move beyond the dead band, down from
    the block's highest value so far or up from its lowest, leads to one state whatever the entry
    was, (down or up, that sample): from there the walk and its turns are the block's own.
    """

    def __init__(self, deadband: float, anchor: float | None):
        self.deadband, self.anchor = deadband, anchor
        self.low = self.high = self.first = None
        self.walk: Zigzag | None = None

    def step(self, at, value: float) -> tuple | None:
        if self.walk is not None:
            return self.walk.step(at, value)
        if self.anchor is not None:  # the block where the series first leaves its start
            moved = abs(value - self.anchor) > self.deadband
            up = value > self.anchor
        else:
            if self.low is None:
                self.low = self.high = (at, value)
            up = value - self.low[1] > self.deadband
            moved = up or self.high[1] - value > self.deadband
        if moved:
            self.walk = Zigzag(at, value, self.deadband)
            self.first = self.walk.direction = 1 if up else -1
        elif self.anchor is None:
            self.low = (at, value) if value <= self.low[1] else self.low
            self.high = (at, value) if value >= self.high[1] else self.high
        return None

    def summary(self) -> tuple:
        """(first direction, low, high, direction and extreme at the end)."""
        ends = (self.walk.direction, *self.walk.best) if self.walk else (None, None, None)
        return (self.first, *(self.low or (None, None)), *(self.high or (None, None)), *ends)


def through(state: tuple | None, summary: tuple) -> tuple[tuple, list[tuple]]:
    """State (direction, at, value) behind a block and the turns (at, value) that only the state at its entry settles."""
    first, low_at, low, high_at, high, direction, at, value, deadband = summary
    found = []
    if state is not None and low is not None:
        way, best_at, best = state
        near_at, near, far_at, far = (high_at, high, low_at, low) if way > 0 else (low_at, low, high_at, high)
        if way * (near - best) >= 0:
            state = (way, near_at, near)
        elif way * (best - far) > deadband:
            found.append((best_at, best))
            state = (-way, far_at, far)
    if first is None:
        return state, found
    if state is not None and state[0] != first:
        found.append(state[1:])
    return (direction, at, value), found


SUMMARY = ["first", "low_at", "low", "high_at", "high", "direction", "end_at", "end"]


def turns(samples: DataFrame, key: str, deadband: float, block_s: float = DAY_S) -> DataFrame:
    """(key, ts, value) of the confirmed extremes of each series, which is walked in blocks of time.

    Blocks are walked apart (`BlockWalk`) and leave their own turns and one summary row. A pass
    over the summaries of a series adds the turns at the blocks' borders. Blocks before the series
    first leaves the dead band around its first value have no turns and aren't walked.
    """
    rows = samples.where(F.col(key).isNotNull() & F.col("value").isNotNull()).select(key, "ts", F.col("value").cast("double").alias("value"))
    rows = rows.withColumn("block", block_of(F.col("ts"), block_s))
    spans = rows.groupBy(key, "block").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.min_by("value", F.struct("ts", "value")).alias("start"))
    w = Window.partitionBy(key).orderBy("block")
    spans = spans.withColumn("anchor", F.first("start").over(w))
    spans = spans.withColumn("left", (F.abs(F.col("lo") - F.col("anchor")) > deadband) | (F.abs(F.col("hi") - F.col("anchor")) > deadband))
    before = F.coalesce(F.max("left").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    spans = spans.withColumn("begun", before).where(F.col("begun") | F.col("left"))
    spans = spans.select(key, "block", F.when(~F.col("begun"), F.col("anchor")).alias("anchor"))
    kind, stamp = dict(rows.dtypes)[key], dict(rows.dtypes)["ts"]
    kinds = {"first": "int", "direction": "int", "low_at": stamp, "high_at": stamp, "end_at": stamp}
    schema = f"`{key}` {kind}, block bigint, ts {stamp}, value double, " + ", ".join(f"{c} {kinds.get(c, 'double')}" for c in SUMMARY)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_block, state, out = None, None, []

        def close() -> None:
            out.append((*at_block, None, None, *state.summary()))

        for frame in frames:
            for name, block, at, value, anchor, place in zip(frame[key], frame["block"], frame["ts"], frame["value"], frame["anchor"], frame["place"]):
                if place == 1:
                    if state is not None:
                        close()
                    at_block, state = (name, block), BlockWalk(deadband, None if pd.isna(anchor) else anchor)
                if turn := state.step(at, value):
                    out.append((name, block, *turn, *[None] * len(SUMMARY)))
            yield _typed(out)
            out.clear()
        if state is not None:
            close()
            yield _typed(out)

    def _typed(found: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(found, columns=[key, "block", "ts", "value", *SUMMARY])
        return frame.astype({c: "Int32" for c in ("first", "direction")} | {c: "datetime64[us]" for c in ("ts", "low_at", "high_at", "end_at")} | {c: "float64" for c in ("value", "low", "high", "end")})

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, state = None, None
        for frame in frames:
            out = []
            clean = frame[SUMMARY].astype(object).where(frame[SUMMARY].notna(), None)
            for name, summary in zip(frame[key], clean.itertuples(index=False)):
                if name != series:
                    series, state = name, None
                state, found = through(state, (*summary, deadband))
                out += [(name, *turn) for turn in found]
            yield pd.DataFrame(out, columns=[key, "ts", "value"])

    # Places by a window keep each block in one task: a repartition by the join's own keys is dropped, and a join that becomes a broadcast reads its shuffle in parts.
    place = F.row_number().over(Window.partitionBy(key, "block").orderBy("ts", "value"))
    dealt = rows.join(spans, [key, "block"]).withColumn("place", place).sortWithinPartitions(key, "block", "ts", "value")
    walked = cut(dealt.mapInPandas(walk, schema))
    own = walked.where("ts is not null").select(key, "ts", "value")
    borders = walked.where("ts is null").drop("ts", "value").repartition(key).sortWithinPartitions(key, "block")
    return own.unionByName(borders.mapInPandas(fold, own.schema))


def hunting(samples: DataFrame, key: str, deadband: float, max_rate: float, min_samples: int = 10, max_interval_s: float = 60, block_s: float = DAY_S) -> DataFrame:
    """Reversals per hour, period, amplitude and travel of each series; not judged on sparse data.

    A series without any value is there, not judged. A long series is many tasks: turns, gaps and medians all
    work on blocks of time.
    """
    since = (micros(F.col("ts")) - micros(F.col("previous.ts"))) / F.lit(1e6)
    span = (F.max(micros(F.col("ts"))) - F.min(micros(F.col("ts")))) / F.lit(3.6e9)
    step = F.abs(F.col("value") - F.col("previous.value"))
    moves = samples.where(F.col(key).isNotNull() & F.col("value").isNotNull()).select(key, "ts", F.col("value").cast("double").alias("value"))
    moves = with_previous(moves, key, seconds=block_s).withColumns({"gap": since, "travel": step})
    sums = moves.groupBy(key).agg(F.count("*").alias("n"), span.alias("hours"), F.sum("travel").alias("travel"))
    found = turns(samples, key, deadband, block_s)
    swings = with_previous(found, key, seconds=block_s).withColumns({"between": since, "swing": step / 2})
    out = samples.where(F.col(key).isNotNull()).select(key).distinct().join(sums, key, "left").join(median(moves, key, "gap"), key, "left")
    out = out.join(found.groupBy(key).agg(F.count("*").alias("turns")), key, "left").join(median(swings, key, "between"), key, "left").join(median(swings, key, "swing"), key, "left")
    judged = F.coalesce((F.col("n") >= min_samples) & (F.col("hours") > 0) & (F.col("gap") <= max_interval_s), F.lit(False))
    rate = F.when(F.col("judged"), F.coalesce("turns", F.lit(0)) / F.col("hours"))
    out = out.withColumn("judged", judged).withColumn("rate", rate)
    shown = lambda column, name: F.when(F.col("judged"), column).alias(name)
    return out.select(
        key, "judged", "rate", shown(2 * F.col("between"), "period_s"), shown(F.col("swing"), "amplitude"),
        shown(F.col("travel") / F.col("hours"), "travel_h"), F.coalesce(F.col("rate") > max_rate, F.lit(False)).alias("fault"),
    )


def resolvable(open_faults: DataFrame, registered: DataFrame, faulted: DataFrame, unjudged: DataFrame) -> DataFrame:
    """Open faults to close: the point has history, and is neither faulted nor left unjudged."""
    known = open_faults.join(registered.select("point_uri").distinct(), "point_uri", "left_semi")
    return known.join(faulted.select("point_uri"), "point_uri", "left_anti").join(unjudged.select("point_uri"), "point_uri", "left_anti")


def masked_inputs(inputs: DataFrame, open_faults: DataFrame) -> DataFrame:
    """Inputs without those under an open stale or stuck fault; other faults don't mask."""
    bad = open_faults.where(F.col("rule").isin("stale", "stuck")).select("point_uri").distinct()
    return inputs.join(bad, "point_uri", "left_anti")


def fault_intervals(flags: DataFrame, key: str) -> DataFrame:
    """Open and resolve times from judged readings (key, ts, bad) in time order; the last may be open."""
    w = Window.partitionBy(key).orderBy("ts")
    changed = flags.withColumn("was", F.coalesce(F.lag("bad").over(w), F.lit(False))).where("bad <> was")
    return changed.withColumn("ended_at", F.lead("ts").over(w)).where("bad").select(key, F.col("ts").alias("started_at"), "ended_at")
