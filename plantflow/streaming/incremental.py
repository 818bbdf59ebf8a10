"""Derivations that follow their inputs: a batch of readings re-runs only the targets it feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantflow.operators import derive
from plantflow.sources.upsert import UpsertTable

RESULTS = "target string, seq long, at timestamp_ntz, value double, error string"


class Incremental:
    """Keeps a history and the results of one derivation up to date, a micro-batch at a time.

    `targets` is (target, name, point_uri): read by `point_uri` it is the index from an input to what it
    feeds. A batch is stored first; targets fed by one of its points run once each, over the stored
    window that ends at the newest sample of their inputs, and their results are merged under the
    batch's name. A formula that gives None writes nothing, an exception is kept with its target.

    Both tables skip a batch that they have, so a replay after a crash at any point ends in the
    same state. `keep` bounds how many of an input's newest samples a formula sees.
    """

    def __init__(self, history: UpsertTable, results: UpsertTable, targets: DataFrame, formula: derive.Formula, window_s: float, keep: int | None = None):
        self.history, self.results, self.targets = history, results, targets
        self.formula, self.window_s, self.keep = formula, window_s, keep

    def dirty(self, batch: DataFrame) -> DataFrame:
        """Targets, with all their inputs, that a point of `batch` feeds."""
        points = batch.select("point_uri").distinct()
        fed = self.targets.join(points, "point_uri", "left_semi").select("target").distinct()
        return self.targets.join(fed, "target", "left_semi")

    def apply(self, batch: DataFrame, name: str) -> int:
        """Take a batch of readings (point_uri, ts, seq, value); returns how many targets wrote a result."""
        batch.persist()
        try:
            commit = self.history.merge(batch, name)
            rerun = self.dirty(batch)
            inputs = self.history.snapshot().join(rerun.select("point_uri").distinct(), "point_uri", "left_semi")
            newest = inputs.agg(F.max("ts")).first()[0]
            if newest is None:
                return 0
            now = F.lit(newest).cast("timestamp_ntz")
            found = derive.evaluate(inputs, rerun, self.formula, now, self.window_s, self.keep)
            kept = found.where("value is not null or error is not null")
            return self.results.merge(kept.select("target", F.lit(commit.version).cast("long").alias("seq"), now.alias("at"), "value", "error"), name).written
        finally:
            batch.unpersist()

    def stream(self, readings: DataFrame, name: str):
        """A stream writer over readings."""
        return readings.writeStream.foreachBatch(lambda batch, number: self.apply(batch, f"{name}/{number}") and None)
