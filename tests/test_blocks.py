"""Series cut into blocks give what one walk over the whole series gives."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantflow.operators import blocks, rules

T0 = datetime(2024, 1, 1)


def single_walk(series, deadband):
    ordered = sorted(series)
    walk, out = rules.Zigzag(*ordered[0], deadband), []
    for at, value in ordered[1:]:
        if turn := walk.step(at, value):
            out.append(turn)
    return out


def random_series(seed, n):
    r = random.Random(seed)
    level, out = 0.0, []
    for i in range(n):
        level += r.choice((0, 0, 0.5, -0.5, 1, -1, 3, -3, 6, -6)) if seed % 3 else r.choice((0.25, -0.25, 0))
        out.append((T0 + timedelta(seconds=7 * i + r.choice((0, 0, 3))), level + (r.random() if seed % 2 else 0)))
    return out


@pytest.mark.parametrize("block_s", [20, 90, 1000, 86_400])
def test_turns_by_blocks_match_one_walk(spark, block_s):
    series = {f"s{k}": random_series(k, n) for k, n in enumerate((400, 700, 1, 2, 300, 500, 40, 600))}
    rows = [(k, at, v) for k, pairs in series.items() for at, v in pairs] + [("none", T0, None), (None, T0, 1.0)]
    frame = spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double")
    got = {}
    for r in rules.turns(frame, "k", 5.0, block_s).collect():
        got.setdefault(r.k, []).append((r.ts, r.value))
    want = {k: single_walk(pairs, 5.0) for k, pairs in series.items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}
    assert sum(map(len, want.values())) > 50


def test_entry_state_settles_quiet_blocks():
    """Every split of a small series into two blocks, from every state, equals the walk over it."""
    r = random.Random(5)
    for _ in range(3000):
        values = [r.randint(-8, 8) for _ in range(r.randint(2, 9))]
        whole = rules.Zigzag(-1, values[0], 4)
        states, turns = [], []
        for i, v in enumerate(values[1:]):
            turn = whole.step(i, v)
            states.append((whole.direction, *whole.best))
            turns.append(turn)
        for start in range(1, len(states)):
            if states[start - 1][0] == 0:
                continue
            block, own = rules.BlockWalk(4, None), []
            for i in range(start, len(states)):
                if turn := block.step(i, values[i + 1]):
                    own.append(turn)
            end, found = rules.through(states[start - 1], (*block.summary(), 4))
            assert end == states[-1]
            assert sorted(found + own) == sorted(t for t in turns[start:] if t)


@pytest.mark.parametrize("block_s", [30, 86_400])
def test_previous_row_crosses_blocks(spark, block_s):
    rows = [("a", T0 + timedelta(seconds=s), float(s % 7)) for s in (0, 1, 29, 31, 95, 95, 400)] + [("b", T0, 1.0)]
    frame = spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double")
    got = blocks.with_previous(frame, "k", seconds=block_s).orderBy("k", "ts", "value").collect()
    before = [None, *got[:-1]]
    for row, last in zip(got, before):
        want = (last.ts, last.value) if last is not None and last.k == row.k else None
        assert (None if row.previous is None else tuple(row.previous)) == want


def test_median_by_selection(spark):
    r = random.Random(1)
    data = {
        "same": [5.0] * 100, "two": [1.0, 2.0], "one": [3.5], "signed": [r.uniform(-3, 3) for _ in range(101)], "wide": [10 ** r.uniform(-9, 9) for _ in range(200)],
        "tied": [1.0] * 50 + [9.0] * 50, "near": [1 + i * 1e-12 for i in range(100)],
    }
    rows = [(k, v) for k, values in data.items() for v in values] + [("same", None), ("nothing", None)]
    got = {x.k: x.v for x in blocks.median(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert got == {k: statistics.median(values) for k, values in data.items()}


def test_hunting_is_the_same_for_all_block_sizes(spark):
    rows = [(f"s{k}", at, v) for k in range(1, 4) for at, v in random_series(k, 300)]
    frame = spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double")
    shown = [F.round(c, 9).alias(c) for c in ("rate", "period_s", "amplitude", "travel_h")]
    results = [sorted(map(tuple, rules.hunting(frame, "k", 2.0, 5.0, block_s=b).select("k", "judged", *shown, "fault").collect())) for b in (60, 700, 86_400)]
    assert results[0] == results[1] == results[2] and all(r[1] for r in results[0])
