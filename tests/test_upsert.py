"""Transactional upserts and incremental derivations: last wins, crashes, replays, only dirty targets run."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantflow.operators import derive
from plantflow.sources.upsert import UpsertTable, upsert_stream
from plantflow.streaming.incremental import RESULTS, Incremental

T0 = datetime(2024, 1, 1)
SCHEMA = "point_uri string, ts timestamp_ntz, seq long, value double"


def frame(spark, rows):
    return spark.createDataFrame([(p, T0 + timedelta(hours=h), s, v) for p, h, s, v in rows], SCHEMA)


def content(table):
    return {(r.point_uri, r.ts): (r.seq, r.value) for r in table.snapshot().collect()}


def expected(rows):
    out = {}
    for p, h, s, v in rows:
        key = (p, T0 + timedelta(hours=h))
        out[key] = max(out.get(key, (-1, 0.0)), (s, v))
    return out


def test_batches_merge_last_wins_and_count_keys(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.choice("abc"), r.randint(0, 60), s, float(s)) for s in range(300)]
    r.shuffle(rows)
    table = UpsertTable(spark, str(tmp_path / "t"), SCHEMA, buckets=3)
    assert table.snapshot().count() == 0
    for i in range(0, 300, 100):
        part = rows[i : i + 100]
        commit = table.merge(frame(spark, part), f"b{i}")
        assert commit.applied and commit.written == len({x[:2] for x in part})
    assert content(table) == expected(rows)
    before = {p.name for p in (tmp_path / "t/data").iterdir()}
    assert table.vacuum() > 0 and content(table) == expected(rows) and before


def test_commit_touches_only_its_parts(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path / "t"), SCHEMA, buckets=2)
    table.merge(frame(spark, [("a", h, 0, 1.0) for h in range(0, 96, 12)]), "first")
    table.merge(frame(spark, [("a", 1, 1, 2.0)]), "second")
    assert len(list((tmp_path / "t/data/version=2").glob("day=*"))) == 1
    assert len(content(table)) == 9


def test_replay_and_crash_before_commit(spark, tmp_path, monkeypatch):
    table = UpsertTable(spark, str(tmp_path / "t"), SCHEMA)
    first, second = [("a", 1, 0, 1.0), ("b", 1, 1, 2.0)], [("a", 1, 5, 9.0), ("c", 30, 6, 3.0)]
    table.merge(frame(spark, first), "one")
    assert table.merge(frame(spark, [("a", 1, 99, 0.0)]), "one").applied is False  # the name, not the rows, decides
    seen = []

    def die(rows, version):
        seen.append((rows.count(), version))
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        table.merge(frame(spark, second), "two", then=die)
    assert seen == [(2, 2)] and content(table) == expected(first)  # written, not visible
    assert table.merge(frame(spark, second), "two").version == 2
    assert content(table) == expected(first + second)
    table.merge(frame(spark, [("a", 1, 3, 7.0)]), "late")  # of an older order
    assert content(table) == expected(first + second)


def test_faster_writer_stands(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    table, other = UpsertTable(spark, path, SCHEMA), UpsertTable(spark, path, SCHEMA)
    with pytest.raises(Exception, match="exist"):
        table.merge(frame(spark, [("a", 1, 0, 1.0)]), "mine", then=lambda *_: other._commit(1, {"version": 1, "batch": "theirs", "written": 0, "parts": []}))
    assert content(table) == {}


def test_stream_restarts_without_loss_or_repeat(spark, tmp_path):
    rows = [("abc"[i % 3], i % 50, i, float(i)) for i in range(240)]
    table, source = UpsertTable(spark, str(tmp_path / "t"), SCHEMA), str(tmp_path / "in")
    for lo in range(0, 240, 80):
        frame(spark, rows[lo : lo + 80]).repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        upsert_stream(stream, table, "s").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert content(table) == expected(rows) and table.log().count() == 6


def incremental(spark, tmp_path, ran):
    targets = [(f"t{i}", n, f"p{(i + k) % 6}") for i in range(6) for k, n in enumerate("ab")]

    def formula(inputs, target):
        if target == "t5":
            raise ValueError("broken")
        return derive.last_difference(inputs, target)

    history = UpsertTable(spark, str(tmp_path / "h"), SCHEMA, buckets=2)
    results = UpsertTable(spark, str(tmp_path / "r"), RESULTS, keys=("target",), ts_col=None, buckets=2)
    return Incremental(history, results, spark.createDataFrame(targets, "target string, name string, point_uri string"), formula, 10 * 86400, keep=1)


def test_only_dirty_targets_run_and_replays_change_nothing(spark, tmp_path):
    run = incremental(spark, tmp_path, [])
    every = [(f"p{i}", 1, i, float(i)) for i in range(6)]
    assert run.apply(frame(spark, every), "b1") == 6  # with the one that raises
    one = frame(spark, [("p2", 5, 10, 50.0)])
    assert {r.target for r in run.dirty(one).collect()} == {"t1", "t2"}
    assert run.apply(one, "b2") == 2
    state = {r.target: (r.value, r.error) for r in run.results.snapshot().collect()}
    assert state == {"t0": (-1.0, None), "t1": (-49.0, None), "t2": (47.0, None), "t3": (-1.0, None), "t4": (-1.0, None), "t5": (None, "ValueError: broken")}
    for name in ("b1", "b2"):
        run.apply(one, name)
    assert state == {r.target: (r.value, r.error) for r in run.results.snapshot().collect()}
    assert {r.target: r.seq for r in run.results.snapshot().collect()}["t1"] == 2


def test_crash_between_history_and_results(spark, tmp_path, monkeypatch):
    run = incremental(spark, tmp_path, [])
    rows = frame(spark, [("p0", 1, 0, 4.0), ("p1", 1, 1, 1.0)])
    good = run.results.merge
    monkeypatch.setattr(run.results, "merge", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        run.apply(rows, "b1")
    monkeypatch.setattr(run.results, "merge", good)
    assert run.apply(rows, "b1") == 2
    assert {r.target: r.value for r in run.results.snapshot().where(F.col("error").isNull()).collect()} == {"t0": 3.0}


@pytest.mark.parametrize("keep", [1, 2, None])
def test_bounded_inputs(spark, keep):
    rows = frame(spark, [("p", h, h, float(h)) for h in range(5)])
    targets = spark.createDataFrame([("t", "a", "p"), ("u", "a", "none")], "target string, name string, point_uri string")
    count = lambda inputs, target: float(len(inputs["a"])) * 100 + sum(v for _, v in inputs["a"])
    now = F.lit(T0 + timedelta(hours=4)).cast("timestamp_ntz")
    got = {r.target: r.value for r in derive.evaluate(rows, targets, count, now, 86400, keep).collect()}
    assert got == {"t": {1: 104.0, 2: 207.0, None: 510.0}[keep], "u": 0.0}
