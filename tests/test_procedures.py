"""Criteria of procedures on hand-made inputs: named points, ids by their beginnings, nothing to judge."""

from datetime import datetime

from pyspark.sql import functions as F

from plantflow.operators import procedures

CRITERIA = "criterion string, point_class string, point string, required boolean"


def test_check_ids_by_their_beginnings(spark):
    rows = [("own", None, None, False, "pair", None, False), ("below", None, None, False, "pair:", None, False), ("star", None, None, False, "pa*", None, False)]
    criteria = spark.createDataFrame(rows, f"{CRITERIA}, check string, severity string, strict boolean")
    results = spark.createDataFrame([("e", c, "high", "pass") for c in ("pair", "pair:fan", "pairs", "other")], "equip string, check string, severity string, status string")
    got = {r.criterion: r["count"] for r in procedures.judge_checks(criteria, results).groupBy("criterion").count().collect()}
    assert got == {"own": 2, "below": 1, "star": 3}


def test_named_point_counts_for_all_equipment(spark):
    criteria = spark.createDataFrame([("n", None, "p", False, 0.0, 10.0, None, None, None, None, None)], f"{CRITERIA}, lo double, hi double, unit string, zone string, days array<int>, from_hour int, to_hour int")
    points = spark.createDataFrame([("a", "p", None, None)], "equip string, point_uri string, class string, unit string")
    applies = spark.createDataFrame([("n", "a"), ("n", "b")], "criterion string, equip string")
    family = spark.createDataFrame([], "class string, ancestor string")
    samples = spark.createDataFrame([("p", datetime(2024, 1, 1), 11.0)], "point_uri string, ts timestamp_ntz, value double")
    aims = procedures.targets(applies, criteria, points, family)
    judge = lambda rows: {r.equip: r.status for r in procedures.fold(applies, criteria, procedures.judge_range(aims, criteria, rows, points.where(F.lit(False)))).collect()}
    assert judge(samples) == {"a": "fail", "b": "fail"}
    assert judge(samples.where("false")) == {"a": "inconclusive", "b": "inconclusive"}
