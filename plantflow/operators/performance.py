"""Performance models, degradation, correlation, savings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("one", "tons", "tons2", "ecwt")


def usable_hours(kw: DataFrame, tons: DataFrame, ecwt: DataFrame, floor: float | None = None) -> DataFrame:
    """Hours that all three hourly series (ts, v) have, above a tenth of the largest load."""
    rows = kw.withColumnRenamed("v", "kw").join(tons.withColumnRenamed("v", "tons"), "ts").join(ecwt.withColumnRenamed("v", "ecwt"), "ts")
    least = rows.agg(F.max("tons") * 0.1).alias("m").first()[0] if floor is None else floor
    return rows.where((F.col("kw") >= 0) & (F.col("tons") > max(least or 0.0, 0.0)))


def _features(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"one": F.lit(1.0), "tons2": F.col("tons") * F.col("tons"), "y": F.col("kw") / F.col("tons")})


def normal_sums(rows: DataFrame) -> DataFrame:
    """All sums of products that the normal equations need, in one aggregate."""
    x = _features(rows)
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(FEATURES) for b in FEATURES[i:]]
    return x.agg(*sums, *[F.sum(F.col(a) * F.col("y")).alias(f"{a}_y") for a in FEATURES], F.count("*").alias("n"))


def fit(rows: DataFrame, least_rows: int = 48) -> dict[str, float]:
    """Coefficients of y = b0 + b1 tons + b2 tons^2 + b3 ecwt by least squares: a 4 x 4 solve on aggregated sums."""
    sums = normal_sums(rows).first()
    if sums["n"] < least_rows:
        raise ValueError(f"{sums['n']} usable hours, {least_rows} needed")
    a = np.array([[sums[f"{p}_{q}"] if FEATURES.index(p) <= FEATURES.index(q) else sums[f"{q}_{p}"] for q in FEATURES] for p in FEATURES])
    if np.linalg.cond(a) > 1e14:
        raise ValueError("the load and temperature don't vary enough")
    return dict(zip(FEATURES, np.linalg.solve(a, np.array([sums[f"{p}_y"] for p in FEATURES])).tolist()))


def residuals(rows: DataFrame, model: dict[str, float]) -> DataFrame:
    x = _features(rows)
    fitted = sum((F.col(name) * F.lit(b) for name, b in model.items()), F.lit(0.0))
    return x.withColumn("fitted", fitted).withColumn("r", F.col("y") - fitted)


def fit_quality(rows: DataFrame, model: dict[str, float]) -> DataFrame:
    """n, CV(RMSE) and NMBE in percent."""
    dof = F.greatest(F.count("*") - len(FEATURES), F.lit(1))
    r = residuals(rows, model)
    return r.agg(
        F.count("*").alias("n"),
        (100 * F.sqrt(F.sum(F.col("r") * F.col("r")) / dof) / F.avg("y")).alias("cvrmse"),
        (100 * F.sum("r") / (dof * F.avg("y"))).alias("nmbe"),
    )


def in_range(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """Rows whose load and temperature lie within those of the rows that the model was fitted on."""
    sides = [f(c).alias(f"{f.__name__}_{c}") for c in ("tons", "ecwt") for f in (F.min, F.max)]
    limits = F.broadcast(fitted.agg(*sides))  # one row
    known = rows.crossJoin(limits).where("tons BETWEEN min_tons AND max_tons AND ecwt BETWEEN min_ecwt AND max_ecwt")
    return known.select(*rows.columns)


def degradation(rows: DataFrame, model: dict[str, float], unit: str = "month") -> DataFrame:
    """Mean measured against mean fitted by month or ISO week, in percent; the row without a bucket is over all."""
    bucket = F.date_trunc(unit, "ts").cast("timestamp_ntz")
    gap = 100 * (F.avg("y") - F.avg("fitted")) / F.avg("fitted")
    judged = residuals(rows, model).withColumn("bucket", bucket)
    return judged.rollup("bucket").agg(F.count("*").alias("n"), gap.alias("gap_pct"))


def feeds(upper: DataFrame, lower: DataFrame, least_r: float = 0.8, least_n: int = 24, margin: float = 0.1, within: str = "site") -> DataFrame:
    """Best upper series for each lower one of its site by Pearson r on common buckets (id, site, b, v), with a margin over the next.

    Only series of one `within` meet, and first their buckets are counted without values: pairs that share too few never
    bring their values together. r comes from sums, which combine in the map tasks.
    """
    from pyspark.sql.window import Window

    keys = [within, "b"]
    common = upper.select(F.col("id").alias("u"), *keys).join(lower.select(F.col("id").alias("l"), *keys), keys).groupBy("u", "l").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)
    pairs = upper.select(F.col("id").alias("u"), *keys, F.col("v").alias("uv")).join(lower.select(F.col("id").alias("l"), *keys, F.col("v").alias("lv")), keys)
    pairs = pairs.join(common.select("u", "l"), ["u", "l"], "left_semi")
    stats = pairs.groupBy("u", "l").agg(
        F.count("*").alias("n"), F.when((F.stddev_pop("uv") > 0) & (F.stddev_pop("lv") > 0), F.corr("uv", "lv")).alias("r")
    )
    stats = stats.where(F.col("r").isNotNull())
    w = Window.partitionBy("l").orderBy(F.desc(F.round("r", 9)), "u")
    ranked = stats.withColumn("rn", F.row_number().over(w)).withColumn("next", F.lead("r").over(w))
    return ranked.where((F.col("rn") == 1) & (F.col("r") >= least_r) & (F.col("r") - F.coalesce("next", F.lit(-1.0)) >= margin)).select("l", "u", "r", "n")


def savings(cases: DataFrame) -> DataFrame:
    """Energy, money and payback with a 3 x 3 sensitivity over tariff and load.

    Cases are (id, now, new, ton_hours, tariff, demand, peak, cost); the grid is nine rows.
    """
    spark = cases.sparkSession
    grid = spark.createDataFrame([(a, b) for a in (0.8, 1.0, 1.2) for b in (0.8, 1.0, 1.2)], "tariff_x double, load_x double")
    delta = F.col("now") - F.col("new")
    kwh = F.col("ton_hours") * F.col("load_x") * delta
    money = kwh * F.col("tariff") * F.col("tariff_x") + 12 * F.col("demand") * F.col("peak") * delta
    rows = cases.crossJoin(F.broadcast(grid)).withColumn("kwh", kwh).withColumn("money", money)
    return rows.select("id", "tariff_x", "load_x", "kwh", "money", F.when(F.col("money") > 0, F.col("cost") / F.col("money")).alias("payback"))
