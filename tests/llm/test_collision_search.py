"""Collision counting against exact distances."""

import numpy as np
import pytest
from pyspark.sql import types as T

from conftest import SF
from plantflow.llm import collision_search

ROWS = T.StructType([T.StructField(n, t) for n, t in (("vec_id", T.LongType()), ("embedding", T.ArrayType(T.FloatType())), ("score", T.StringType()), ("rank", T.StringType()), ("block", T.StringType()), ("dim", T.StringType()))])


def exact(rows, every, k=10):
    out = {}
    for q, v in rows:
        if q % every == 0:
            near = sorted((float(np.sqrt(((np.array(w, "f4").astype(float) - np.array(v, "f4")) ** 2).sum())), i) for i, w in rows if i != q and len(w) == len(v))
            out[q] = near[:k]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    hits = sum(len({i for _, i in got.get(q, [])} & {i for _, i in near}) for q, near in want.items())
    return hits / sum(map(len, want.values()))


def test_recall_on_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got, want = found(collision_search.query(spark, SF)), exact(rows, 100)
    assert recall(got, want) >= 0.95
    for q, near in got.items():
        true = dict((i, d) for d, i in exact(rows, 100, len(rows))[q])
        assert near == sorted(near) and all(abs(true[i] - d) < 1e-12 for d, i in near)


def test_recall_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(collision_search, "LEAST_BLOCK", 700)
    monkeypatch.setattr(collision_search, "block_count", lambda *_: 5)
    r = np.random.default_rng(3)
    centres = r.standard_normal((20, 24))
    rows = [(i, (centres[i % 20] + 0.4 * r.standard_normal(24)).tolist()) for i in range(3000)]
    frame = spark.createDataFrame([(i, v, "s", "r", "b", "d") for i, v in rows], ROWS)
    assert recall(found(collision_search.search(frame)), exact(rows, 100)) >= 0.95


@pytest.mark.parametrize("kind", ["float", "double", "integer"])
def test_edge_cases(spark, kind):
    good = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (200, [1.0, 0.0]), (300, [1.0, 2.0, 3.0]), (301, [1.0, 2.0, 4.0]), (400, [5.0, 5.0, 5.0, 5.0])]
    bad = [(5, None), (6, [0.0, 0.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 0.0])]
    bad += [] if kind == "integer" else [(100, [float("nan"), 1.0]), (9, [float("inf"), 1.0])]
    element = {"float": T.FloatType(), "double": T.DoubleType(), "integer": T.IntegerType()}[kind]
    cast = int if kind == "integer" else float
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(element))])
    value = lambda v: None if v is None else [None if x is None else cast(x) for x in v]
    frame = spark.createDataFrame([(i, value(v)) for i, v in good + bad], schema)
    got = found(collision_search.search(frame, k=3))
    assert {q: [i for _, i in near] for q, near in got.items()} == {0: [1, 2, 200], 200: [0, 1, 2], 300: [301]}
    assert got[0][0][0] == 0.0 and got[300] == [(1.0, 301)]


def test_repeated_ids_and_huge_components(spark):
    big = 1e200
    rows = [(0, [1.0, 1.0]), (0, [1.0, 1.0]), (0, [2.0, 1.0]), (1, [1.0, 1.5]), (2, [big, big]), (100, [big, -big])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(collision_search.search(frame, k=2))
    assert [i for _, i in got[0]] == [1, 2] and got[0][0][0] == 0.5
    assert len(got[100]) == 2


def test_empty(spark):
    assert collision_search.search(spark.createDataFrame([], ROWS)).count() == 0
