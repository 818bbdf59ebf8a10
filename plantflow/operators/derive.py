"""User-defined derivations: formulas per target, chains in topological order, masking, isolation of failures."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from graphlib import CycleError, TopologicalSorter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantflow.session import cut

Formula = Callable[[dict[str, list[tuple]], str], float | None]


def order(depends: dict[str, set[str]]) -> list[str]:
    """Run order; derivations with a missing dependency or in a cycle drop out with all that need them."""
    alive = dict(depends)
    while True:
        bad = {d for d, needs in alive.items() if not needs <= alive.keys()}
        if not bad:
            try:
                return list(TopologicalSorter(alive).static_order())
            except CycleError as cycle:
                bad = set(cycle.args[1])
        alive = {d: needs for d, needs in alive.items() if d not in bad}


def evaluate(samples: DataFrame, targets: DataFrame, formula: Formula, now, window_s: float, keep: int | None = None) -> DataFrame:
    """(target, value, error) of a formula over its inputs in [now - window, now].

    `targets` is (target, name, point_uri). A target without samples still runs, with empty
    lists. None writes nothing; an exception concerns its target only. `keep` bounds an input to
    its newest samples, for formulas that look at no more: a hot point then costs its tasks a
    few rows, and its series is never gathered.
    """
    from plantflow.operators.timejoin import micros

    inside = samples.where((F.col("ts") <= now) & (micros(F.col("ts")) >= micros(now) - int(window_s * 1e6))).select("point_uri", "ts", "value")
    if keep == 1:
        inside = inside.groupBy("point_uri").agg(F.max(F.struct("ts", "value")).alias("s")).select("point_uri", "s.*")
    elif keep is not None:
        newest = F.row_number().over(Window.partitionBy("point_uri").orderBy(F.desc("ts"), F.desc("value")))
        inside = inside.withColumn("newest", newest).where(F.col("newest") <= keep).drop("newest")
    rows = targets.join(inside, "point_uri", "left")
    series = F.array_sort(F.collect_list(F.when(F.col("ts").isNotNull(), F.struct("ts", "value"))))
    inputs = rows.groupBy("target", "name").agg(series.alias("series"))
    inputs = inputs.groupBy("target").agg(F.collect_list(F.struct("name", "series")).alias("inputs"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values, errors = [], []
            for target, given in zip(frame["target"], frame["inputs"]):
                value, error = None, None
                try:
                    value = formula({x["name"]: [(s["ts"], s["value"]) for s in x["series"]] for x in given}, target)
                except Exception as problem:  # a user's formula may raise anything
                    error = f"{type(problem).__name__}: {problem}"
                values.append(None if value is None else float(value))
                errors.append(error)
            yield pd.DataFrame({"target": frame["target"], "value": pd.array(values, "Float64"), "error": errors})

    return inputs.mapInPandas(run, "target string, value double, error string")


def evaluate_chain(samples: DataFrame, derivations: dict[str, tuple[DataFrame, Formula]], depends: dict[str, set[str]], now, window_s: float) -> DataFrame:
    """(derivation, target, value, error) of all derivations, each after those that it reads from.

    A derivation is (targets, formula). What an upstream one derives is a sample of the point
    named like its target, at `now`, for the ones downstream in the same pass.
    """
    out, known = None, samples.select("point_uri", "ts", "value")
    for name in order(depends):
        targets, formula = derivations[name]
        found = cut(evaluate(known, targets, formula, now, window_s).select(F.lit(name).alias("derivation"), "target", "value", "error"))
        out = found if out is None else out.unionByName(found)
        known = known.unionByName(found.where("value is not null").select(F.col("target").alias("point_uri"), now.alias("ts"), "value"))
    return out


def trace(results: DataFrame, targets: DataFrame, masked: DataFrame) -> DataFrame:
    """Dry run: per target the value, what it would be written from, its masked inputs and whether it would be written.

    `targets` is (target, name, point_uri), `masked` (point_uri) the inputs under an open fault.
    """
    flagged = targets.join(masked.select("point_uri", F.lit(True).alias("bad")), "point_uri", "left")
    inputs = flagged.groupBy("target").agg(
        F.array_sort(F.collect_set(F.when(F.col("bad").isNull(), F.col("point_uri")))).alias("would_derive_from"),
        F.array_sort(F.collect_set(F.when(F.col("bad"), F.col("point_uri")))).alias("masked_inputs"),
    )
    written = F.col("value").isNotNull() & F.col("error").isNull() & (F.size("masked_inputs") == 0)
    return results.join(inputs, "target", "left").withColumn("would_write", F.coalesce(written, F.lit(False)))


def last_difference(inputs: dict[str, list[tuple]], target: str) -> float | None:
    """Last value of a minus last value of b."""
    if not inputs.get("a") or not inputs.get("b"):
        return None
    return inputs["a"][-1][1] - inputs["b"][-1][1]


def target_health(runs: DataFrame, threshold: int = 5) -> DataFrame:
    """Targets whose newest `threshold` runs (target, at, failed) all failed are disabled."""
    w = Window.partitionBy("target").orderBy(F.desc("at"))
    newest = runs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= threshold)
    return newest.groupBy("target").agg(((F.count("*") == threshold) & F.bool_and("failed")).alias("disabled"))
