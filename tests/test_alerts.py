"""The alert machine on literal cases, and the stream of it over batches, late rows and a restart."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantflow.plans.stream_queries import state_store
from plantflow.streaming import alerts

T0 = datetime(2024, 1, 1)
AT = lambda s: T0 + timedelta(seconds=s)


def events(observations, limits, horizon=10_000):
    return [(e, (t - T0).total_seconds()) for e, t in alerts.walk([(AT(s), p) for s, p in observations], limits, AT(horizon))]


@pytest.mark.parametrize(
    "observations,want",
    [
        ([(0, True), (200, False)], [("firing", 120), ("resolved", 290)]),
        ([(0, True), (100, False), (150, True), (260, False)], []),  # never present for long enough
        ([(0, True), (130, False), (180, True), (400, False)], [("firing", 120), ("resolved", 490)]),  # absence ended before it counted
        ([(0, True), (50, None), (500, True), (501, False)], [("firing", 500), ("resolved", 591)]),  # stale holds the first timer
        ([(0, True), (130, False), (150, None), (900, False)], [("firing", 120), ("resolved", 900)]),  # stale holds the clearing
        ([(0, True), (130, False), (150, None), (900, True), (901, False)], [("firing", 120), ("resolved", 991)]),
        ([(0, True), (120, False)], []),  # what is seen at the same time comes first
        ([(0, None), (10, False)], []),
    ],
)
def test_machine(observations, want):
    assert events(observations, alerts.Limits(120, 90)) == want


def test_reminders():
    got = events([(0, True), (700, None), (1500, True), (1600, False)], alerts.Limits(120, 90, 200), 3000)
    assert got == [("firing", 120), ("reminder", 320), ("reminder", 520), ("reminder", 1500), ("resolved", 1690)]
    assert events([(0, True)], alerts.Limits(120, 90), 3000) == [("firing", 120)]


def test_stream_over_batches_and_restart(spark, tmp_path):
    """Three runs over one checkpoint give what one walk gives; rows out of order inside the delay change nothing."""
    r = random.Random(7)
    rows = {k: [(AT(s), r.choice((True, True, True, False, None))) for s in sorted(r.sample(range(0, 6000, 3), 80))] for k in "abcdef"}
    flat = sorted(((at + timedelta(seconds=r.uniform(0, 25)), k, at, p) for k, seen in rows.items() for at, p in seen), key=lambda x: x[:2])
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    limits = alerts.Limits(90, 60, 300)
    last = max(at for seen in rows.values() for at, _ in seen)
    for lo in range(0, len(flat), 160):
        part = spark.createDataFrame([(k, at, p) for _, k, at, p in flat[lo : lo + 160]], "key string, ts timestamp_ntz, present boolean")
        part.select("key", F.col("ts").cast("timestamp").alias("ts"), "present").coalesce(1).write.mode("append").parquet(source)
        with state_store(spark):
            seen = spark.readStream.schema("key string, ts timestamp, present boolean").option("maxFilesPerTrigger", 1).parquet(source)
            run = alerts.alert_stream(seen, limits).writeStream.option("checkpointLocation", state).trigger(availableNow=True).start(out)
            run.awaitTermination()
    got = {}
    for x in spark.read.parquet(out).select("key", "event", F.col("at").cast("timestamp_ntz").alias("at")).collect():
        got.setdefault(x.key, []).append((x.at, x.event))
    want = {k: sorted((t, e) for e, t in alerts.walk(seen, limits, last - timedelta(seconds=30))) for k, seen in rows.items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert sum(map(len, want.values())) > 20
