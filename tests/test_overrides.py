"""Override steps against a plain walk, exclusions in their order, and each verdict of the judgement."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantflow.operators import overrides

T0 = datetime(2024, 1, 1)


def now():
    return F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def frame(spark, rows):
    return spark.createDataFrame([(k, at(m), None if v is None else float(v)) for k, m, v in rows], "k string, ts timestamp_ntz, value double")


def plain_steps(series, far):
    """Index by index over all samples, as one would by hand."""
    out, i, standing = [], 1, None
    while i < len(series):
        t, v = series[i]
        if not far(series[i - 1][1], v):
            i += 1
            continue
        j = next((j for j in range(i + 1, len(series)) if far(v, series[j][1])), len(series))
        until = series[j][0] if j < len(series) else None
        back = standing is not None and standing[1] == t and not far(standing[0], v)
        out.append((t, v, series[i - 1][1], until, back))
        standing = None if back else (series[i - 1][1], until)
        i = j
    return out


@pytest.mark.parametrize("kind,step", [("absolute", 2.0), ("relative", 0.3), ("state", 0.5)])
def test_steps_match_plain_walk(spark, kind, step):
    r = random.Random(11)
    series = {}
    for k in "abcde":
        level, rows = 10.0, []
        for m in range(0, 2000, 7):
            level += r.choice((0, 0, 0, 0, 0.9, -0.9, 3, -3)) if kind != "state" else 0
            rows.append((m, level if kind != "state" else float(r.random() < 0.5)))
        series[k] = rows
    data = frame(spark, [(k, m, v) for k, rows in series.items() for m, v in rows] + [("none", 5, None)])
    got = {}
    for x in overrides.steps(data, "k", step, kind).collect():
        got.setdefault(x.k, []).append((x.at, x.value, x.previous, x.held_until, x.released))
    far = overrides._moved(kind, step)
    assert {k: sorted(v, key=lambda x: x[0]) for k, v in got.items()} == {k: plain_steps([(at(m), v) for m, v in rows], far) for k, rows in series.items()}


def test_exclusions_in_order(spark):
    rows = [("p", 0, 20), ("p", 100, 25), ("p", 150, 20.1), ("p", 300, 30), ("p", 303, 20), ("p", 500, 26), ("p", 700, 31), ("p", 900, 36), ("p", 1100, 41), ("q", 0, 1), ("q", 2875, 9)]
    own, schedule = frame(spark, [("p", 501, 0), ("p", 700, 0)]), frame(spark, [("p", 696, 0), ("p", 904, 0), ("p", 1094, 0)])
    held = spark.createDataFrame([("p", at(50), 8), ("p", at(120), None), ("p", at(1200), 5)], "k string, ts timestamp_ntz, level int")
    found = overrides.detect(frame(spark, rows), "k", 1.0, now(), own=own, schedule=schedule, held=held)
    got = {(x.k, x.at): (x.verdict, x.level) for x in found.collect()}
    assert got == {
        ("p", at(100)): ("override", 8), ("p", at(150)): ("release", None), ("p", at(300)): ("not_held", None), ("p", at(303)): ("release", None), ("p", at(500)): ("own", None),
        ("p", at(700)): ("own", None), ("p", at(900)): ("schedule", None), ("p", at(1100)): ("override", 5), ("q", at(2875)): ("standing", None)}
    strict = overrides.detect(frame(spark, [("p", 0, 1), ("p", 200, 9)]), "k", 1.0, now(), held=held.where("level is null"), need_level=True)
    assert [x.verdict for x in strict.collect()] == ["no_level"]


def test_each_verdict(spark):
    columns = "k string, at timestamp_ntz, value double, held_until timestamp_ntz"
    made = [("pass", 0, None), ("late", 0, None), ("cut", 0, 10), ("silent", 0, None), ("empty", 0, None), ("left", 0, None), ("new", 2870, None), ("fits", 0, 10)]
    o = spark.createDataFrame([(k, at(m), 50.0, None if u is None else at(u)) for k, m, u in made], columns)
    answers = frame(spark, [("pass", 29, 49.2), ("pass", 5, 20), ("late", 31, 50), ("late", 10, 40), ("late", 20, 58), ("cut", 5, 10), ("cut", 15, 50), ("silent", -1, 50), ("empty", 5, 0), ("left", 3, 0), ("new", 2871, 1), ("fits", 10, 50)])
    unoccupied = frame(spark, [("empty", -60, 1), ("left", -90, 1), ("left", -60, 0), ("left", 25, 1), ("late", -90, 1), ("late", -60, 0), ("late", 31, 1), ("pass", -5, 1)])
    got = {x.k: (x.status, x.closest) for x in overrides.judge(o, answers, "k", 1.0, now(), unoccupied=unoccupied).collect()}
    assert got == {"pass": ("pass", 49.2), "late": ("fail", 58.0), "cut": ("inconclusive", 10.0), "silent": ("inconclusive", None), "empty": ("not_applicable", 0.0),
                   "left": ("not_applicable", 0.0), "new": ("pending", 1.0), "fits": ("pass", 50.0)}
    state = overrides.judge(o.where("k = 'late'"), frame(spark, [("late", 10, 1)]), "k", 0.0, now(), "state", unoccupied=frame(spark, [("late", 0, 1)])).first()
    assert (state.status, state.reached_at) == ("pass", at(10))


def test_summary_takes_the_latest(spark):
    judged = spark.createDataFrame([("p", at(0), "fail"), ("p", at(9), "pass"), ("p", at(20), "pending"), ("q", at(0), "pending")], "k string, at timestamp_ntz, status string")
    found = spark.createDataFrame([("p", "override"), ("p", "release"), ("p", "own"), ("p", "standing")], "k string, verdict string")
    assert [tuple(x) for x in overrides.summary(found, judged, "k").collect()] == [("p", "pass", 2, 1, 2)]
