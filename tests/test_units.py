"""Operators on hand-made inputs, and equivalences that must hold on any input."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantflow.functions import mapping, scalars
from plantflow.operators import derive, lifecycle, performance, quality, rollup, rules, timejoin, windows
from plantflow.sources import history as hs
from plantflow.streaming import faults

T0 = datetime(2024, 1, 1)
HISTORY = "point_uri string, ts timestamp_ntz, value double, value_text string, value_bool boolean, unit string, label string, quality string"


def series(spark, values, key="p", step=60):
    rows = [(key, T0 + timedelta(seconds=step * i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double")


def history(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (8 - len(r))) for r in rows], HISTORY)


def test_planned_rollup_equals_raw_fold(spark):
    rows = []
    for p in range(3):
        for i in range(400):
            ts = T0 + timedelta(seconds=37 * i * 5)
            rows.append((f"p{p}", ts, None if i % 17 == 0 or p == 2 else float(np.sin(i)), "fault" if i % 17 == 0 and p < 2 else None, i % 3 == 0 if p == 2 else None))
    h = history(spark, rows)
    hourly = rollup.coarse_rollup(rollup.fine_rollup(h))
    for seconds in (3600, 7200):
        plan = rollup.planned_rollup(h, hourly, "2024-01-01 00:00:00", "2024-01-01 20:00:00", seconds, "2024-01-01 07:00:00")
        raw = rollup.his_rollup(h, "2024-01-01 00:00:00", "2024-01-01 20:00:00", seconds)
        a = {(r.point_uri, r.bucket): r for r in plan.collect()}
        b = {(r.point_uri, r.bucket): r for r in raw.collect()}
        assert a.keys() == b.keys()
        for k in a:
            assert a[k]["count"] == b[k]["count"]
            assert a[k]["avg"] == pytest.approx(b[k]["avg"], rel=1e-9)


def test_auto_interval_ladder():
    assert rollup.auto_interval(3600, 1) is None
    assert rollup.auto_interval(30 * 86400, 1000) == 21600 if 30 * 86400 / 200 <= 21600 else True
    assert rollup.auto_interval(10 * 365 * 86400, 5000) == 86400


def test_upsert_replaces_all_columns(spark):
    h = history(spark, [("p", T0, 1.0), ("q", T0, 2.0)])
    new = history(spark, [("p", T0, None, "txt"), ("p", T0, None, None, True)]).withColumn("seq", F.when(F.col("value_text").isNotNull(), 1).otherwise(2))
    got = {r.point_uri: r for r in hs.upsert(h, new).collect()}
    assert got["p"].value is None and got["p"].value_text is None and got["p"].value_bool is True
    assert got["q"].value == 2.0


def test_read_range_many_flags_truncation(spark):
    h = history(spark, [("p", T0 + timedelta(minutes=i), float(i)) for i in range(5)] + [("q", T0, 1.0)])
    got = hs.read_range_many(h, hs.list_points(h), T0, T0 + timedelta(minutes=4), 3).collect()
    assert sorted((r.point_uri, r.value, r.truncated) for r in got) == [("p", 0.0, True), ("p", 1.0, True), ("p", 2.0, True), ("q", 1.0, False)]


def test_asof_and_nearest_ties(spark):
    left = series(spark, [0, 0, 0], step=60)
    right = spark.createDataFrame([("p", T0 + timedelta(seconds=30), 1.0), ("p", T0 + timedelta(seconds=90), 2.0)], "k string, ts timestamp_ntz, value double")
    back = [r.match for r in timejoin.asof(left, right, "k").orderBy("ts").collect()]
    assert back == [None, 1.0, 2.0]
    near = [r.match for r in timejoin.nearest(left, right, "k", 30).orderBy("ts").collect()]
    assert near == [1.0, 2.0, 2.0]  # of two equally near the later


def test_spikes_step_and_noise(spark):
    flat = [10.0] * 20
    flat[10] = 50.0
    assert [r.value for r in windows.spikes(series(spark, flat), "k").collect()] == [50.0]
    assert windows.spikes(series(spark, [10.0] * 10 + [50.0] * 10), "k").count() == 0
    assert windows.spikes(series(spark, [1, 2, 50, 2, 1]), "k").count() == 0  # no full window


def test_hunting_turns(spark):
    t = np.arange(0, 3600, 30)
    v = 50 + 20 * np.sin(2 * np.pi * t / 240)
    assert rules.turns(series(spark, v, step=30), "k", 2.0).count() == pytest.approx(2 * 3600 / 240, abs=2)
    assert rules.turns(series(spark, [1.0, 1.1, 1.0, 1.1]), "k", 0.5).count() == 0


def test_hunting_state_crosses_batches(spark):
    v = [0.0, 5.0, 9.0, 8.0, 3.0, 4.0, 9.0]
    whole = sorted(rules.turns(series(spark, v), "k", 2.0).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert sorted(rules.turns(series(spark, v), "k", 2.0).collect()) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.value for r in whole] == [9.0, 3.0]


def test_hunting_keeps_series_without_values(spark):
    empty = series(spark, [1.0]).withColumn("value", F.lit(None).cast("double"))
    got = rules.hunting(empty, "k", 1.0, 5.0).collect()
    assert [(r.k, r.judged, r.fault) for r in got] == [("p", False, False)]


def test_hunting_refuses_sparse(spark):
    got = rules.hunting(series(spark, np.sin(np.arange(30)) * 9, step=300), "k", 1.0, 5.0).first()
    assert got.judged is False and got.fault is False


def test_run_hours_carry_in_and_gap(spark):
    rows = [("p", T0 - timedelta(minutes=10), None, None, True), ("p", T0 + timedelta(minutes=5), None, None, False), ("p", T0 + timedelta(minutes=60), None, "Running")]
    got = windows.run_hours(history(spark, rows), "point_uri", "2024-01-01 00:00:00", "2024-01-01 02:00:00").first().hours
    assert got == pytest.approx((5 + 15) / 60)


def test_unit_suspects_and_envelope(spark):
    h = history(spark, [("p", T0 + timedelta(minutes=i), 21.0 + i % 3) for i in range(12)])
    assert quality.unit_suspects(h, F.lit(32), F.lit(120), F.lit(0), F.lit(50)).count() == 1
    e = spark.createDataFrame([(["fault", "out-of-service"], None), ([], "over-range"), (["overridden"], "no-fault-detected"), ([], None)], "f array<string>, r string")
    assert [r.q for r in e.select(quality.from_envelope(F.col("f"), F.col("r")).alias("q")).collect()] == ["out_of_service", "fault", "overridden", None]


def test_regression_recovers_model_and_refuses_flat_load(spark):
    rng = np.random.default_rng(1)
    rows = [(T0 + timedelta(hours=i), float(t), float(c)) for i, (t, c) in enumerate(zip(rng.uniform(100, 500, 200), rng.uniform(60, 80, 200)))]
    data = spark.createDataFrame([(ts, (0.3 + 0.001 * t - 1e-6 * t * t + 0.004 * c) * t, t, c) for ts, t, c in rows], "ts timestamp_ntz, kw double, tons double, ecwt double")
    model = performance.fit(data)
    assert list(model.values()) == pytest.approx([0.3, 0.001, -1e-6, 0.004], rel=1e-5)
    assert performance.fit_quality(data, model).first().cvrmse == pytest.approx(0, abs=1e-6)
    with pytest.raises(ValueError):
        performance.fit(data.withColumn("tons", F.lit(100.0)))
    with pytest.raises(ValueError):
        performance.fit(data.limit(10))


def test_derivation_order_prunes_missing_and_cycles():
    assert derive.order({"a": set(), "b": {"a"}, "c": {"zz"}, "d": {"c"}, "e": {"f"}, "f": {"e"}, "g": {"e"}}) == ["a", "b"]


def test_derivation_isolates_failures(spark):
    h = history(spark, [("x", T0, 3.0), ("y", T0, 1.0)])
    targets = spark.createDataFrame([("t1", "a", "x"), ("t1", "b", "y"), ("t2", "a", "none"), ("t3", "a", "x")], "target string, name string, point_uri string")

    def formula(inputs, target):
        if target == "t3":
            raise KeyError("boom")
        return derive.last_difference(inputs, target)

    got = {r.target: r for r in derive.evaluate(h, targets, formula, F.lit(T0).cast("timestamp_ntz"), 60).collect()}
    assert got["t1"].value == 2.0 and got["t2"].value is None and got["t2"].error is None and "KeyError" in got["t3"].error


def test_alert_timers(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [("a", at(0), True), ("a", at(60), True), ("a", at(130), True), ("a", at(200), False), ("a", at(400), False), ("b", at(0), True), ("b", at(60), False), ("b", at(200), True)]
    got = faults.alert_states(spark.createDataFrame(rows, "key string, ts timestamp_ntz, present boolean")).orderBy("at").collect()
    assert [(r.key, r.event) for r in got] == [("a", "firing"), ("a", "resolved")]


def test_schedule_tables(spark):
    text = ["%T\tTASK", "%F\ttask_id\tname", "%R\t1\tPour", "%T\tTASKPRED", "%F\ttask_id\tpred", "%R\t1\t0"]
    rows = lifecycle.xer_tables(spark.createDataFrame(list(enumerate(text)), "n int, line string")).orderBy("n").collect()
    assert [(r.table, r.row) for r in rows] == [("TASK", {"task_id": "1", "name": "Pour"}), ("TASKPRED", {"task_id": "1", "pred": "0"})]


def test_export_round_trip(spark, tmp_path):
    h = history(spark, [("p", T0 + timedelta(days=20 * i), float(i)) for i in range(4)] + [("q", T0, 1.0)])
    hs.export_history(h, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert hs.reconcile(hs.month_counts(back), hs.month_counts(h)).isEmpty()
    assert hs.manifest(spark, str(tmp_path / "out")).count() >= 4


def test_sequence_numbers_by_kind(spark):
    rows = [(None, "Run", None, None), (None, "5", None, None), (5.0, None, None, None), (0.0, None, None, "°F"), (212.0, None, None, "°F"), (None, " 50 ", None, "deg f"),
            (20.0, None, None, "°C"), (None, "n/a", None, "°F"), (None, None, True, "°F"), (None, "off", None, None), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "value double, text string, flag boolean, unit string")
    read = lambda kind: [r[0] for r in frame.select(scalars.sequence_number(F.col("value"), F.col("text"), F.col("flag"), F.col("unit"), kind)).collect()]
    assert read("number") == [None, 5, 5, 0, 212, 50, 20, None, 1, None, None]
    assert [None if x is None else round(x, 4) for x in read("temperature")] == [None, 5, 5, -17.7778, 100, 10, 20, None, 1, None, None]
    assert read("binary") == [1, 1, 1, 0, 1, 1, 1, None, 1, 0, None]


def test_interpolation_is_linear_in_the_series(spark):
    import time

    n = 80_000
    at = F.timestamp_micros(F.col("id") * 5_000_000).cast("timestamp_ntz")
    rows = spark.range(n).select(F.lit("s").alias("series"), at.alias("ts"), F.when(F.col("id") % 7 == 0, F.col("id").cast("double")).alias("value"))
    began = time.perf_counter()
    total = rollup.interpolate(rows).agg(F.count("value"), F.sum("value")).first()
    assert total[0] == 7 * ((n - 1) // 7) + 1 and total[1] == pytest.approx(sum(range(7 * ((n - 1) // 7) + 1)))
    assert time.perf_counter() - began < 30


def test_neighbours_by_heavy_tokens_lose_none(spark):
    """Against all pairs, over tokens from very common to unique."""
    r = np.random.default_rng(8)
    vectors = {}
    for i in range(120):
        tokens = {f"c{x}" for x in range(4)} | {f"m{x}" for x in r.integers(0, 12, 3)} | ({f"r{x}" for x in r.integers(0, 60, 2)} if i % 3 else set())
        raw = {t: {"c": 0.3, "m": 1.0, "r": 2.5}[t[0]] * (1 + r.random() * 0.1) for t in tokens}
        norm = sum(v * v for v in raw.values()) ** 0.5
        vectors[i] = {t: v / norm for t, v in raw.items()}
    weights = spark.createDataFrame([(i, t, float(w)) for i, v in vectors.items() for t, w in v.items()], "id long, token string, w double")
    for least in (0.3, 0.6, 0.95):
        dot = {(q, i): sum(w * vectors[i].get(t, 0) for t, w in vectors[q].items()) for q in range(0, 120, 10) for i in vectors if i != q}
        want = {q: [i for _, i in sorted((-round(s, 9), i) for (p, i), s in dot.items() if p == q and s >= least)[:5]] for q in range(0, 120, 10)}
        got = {}
        for x in sorted(mapping.nearest(weights.where("id % 10 = 0"), weights, 5, least).collect(), key=lambda x: (x.q, -round(x.sim, 9), x.id)):
            got.setdefault(x.q, []).append(x.id)
        assert got == {q: ids for q, ids in want.items() if ids}, least
