"""What large copies of the tables bring out: many equal texts, zero setpoints, reversals at one time, long series."""

import random
import time
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from conftest import rows_of
from plantflow import registry
from plantflow.functions import mapping
from plantflow.operators import paths, roles, rollup, rules, verify
from plantflow.sources import upsert

T0 = datetime(2024, 1, 1)


def copies(spark):
    """Three texts in 40 copies each; every copy has one of two sites."""
    raw = [{"a": 0.6, "b": 0.8}, {"a": 0.8, "b": 0.6}, {"c": 1.0}]
    vectors = {i: raw[i % 3] for i in range(120)}
    weights = spark.createDataFrame([(i, t, w, f"s{i % 2}") for i, v in vectors.items() for t, w in v.items()], "id long, token string, w double, site string")
    return vectors, weights


def brute(vectors, q, k, allowed):
    dot = lambda i: round(sum(w * vectors[i].get(t, 0) for t, w in vectors[q].items()), 9)
    return [i for _, i in sorted((-dot(i), i) for i in vectors if i != q and allowed(i) and dot(i) >= 0.6)[:k]]


def found(frame):
    out = {}
    for x in sorted(frame.collect(), key=lambda x: (x.q, -round(x.sim, 9), x.id)):
        out.setdefault(x.q, []).append(x.id)
    return out


def test_equal_texts_are_compared_once(spark):
    vectors, weights = copies(spark)
    near = mapping.nearest(weights.where("id % 10 = 0"), weights, 5, 0.6)
    assert found(near) == {q: brute(vectors, q, 5, lambda i: True) for q in range(0, 120, 10)}


def test_many_equal_texts_are_not_paired(spark):
    """80,000 copies of one text, of which 1,600 ask: 128 million pairs, if each met each."""
    ids = spark.range(80_000)
    weights = ids.select("id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("token"), F.lit(0.5**0.5).alias("w"))
    began = time.perf_counter()
    near = mapping.nearest(weights.where("id % 50 = 0"), weights, 5, 0.6)
    assert near.agg(F.count("*"), F.max("id")).first()[:] == (8_000, 5)
    assert time.perf_counter() - began < 60


def test_every_part_asks_its_neighbours(spark, tmp_path):
    """Parts get a vote whatever their key, from neighbours with any key."""
    names, types = ("red thing", "blue ring", "steel widget small", "odd gear", "red thing small"), ("ECONOMY", "PROMO", "SMALL")
    rows = [(i, names[i % 5], types[i % 3] if i % 7 else "LARGE") for i in range(1, 120)] + [(500, "lone word", "ONE")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = registry.queries()["vote_by_neighbours"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(registry.oracles()["vote_by_neighbours"]).fetchall())
    assert {r.q for r in got} > {100} and 500 not in {r.q for r in got} and len(got) > 60


def test_equal_texts_by_site(spark):
    vectors, weights = copies(spark)
    near = mapping.nearest(weights.where("id % 15 = 0"), weights, 5, 0.6, ("token", "site"))
    assert found(near) == {q: brute(vectors, q, 5, lambda i, q=q: i % 2 == q % 2) for q in range(0, 120, 15)}


def test_votes_by_scope_compare_texts_once(spark, monkeypatch):
    """Ids of one site differ in label, so that some votes need all sites; both votes share one comparison."""
    made, vectors_of = [], mapping._vectors
    monkeypatch.setattr(mapping, "_vectors", lambda *a: made.append(a) or vectors_of(*a))
    vectors, weights = copies(spark)
    label = lambda i: "same" if i < 15 or i % 2 == 0 else f"l{i}"
    labels = spark.createDataFrame([(i, label(i)) for i in vectors], "id long, label string")
    got = mapping.vote_by_scope(weights.where("id % 15 = 0"), weights, labels, "site")
    want = {}
    for q in range(0, 120, 15):
        for scope, allowed in (("site", lambda i, q=q: i % 2 == q % 2), ("all", lambda i: True)):
            seen = [label(i) for i in brute(vectors, q, 5, allowed)]
            if q not in want and len(seen) > 1 and len(set(seen)) == 1:
                want[q] = (seen[0], scope)
    assert {r.q: (r.label, r.scope) for r in got.collect()} == want
    assert {scope for _, scope in want.values()} == {"site", "all"}
    assert len(made) == 2


def on_events(spark, path, name, rows):
    """The query and its SQL over these events."""
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{path}/events.parquet")
    got = registry.queries()[name](spark, str(path)).toArrow()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    want = con.execute(registry.oracles()[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert rows_of(got, columns) == rows_of(want, columns)
    return got.to_pylist()


def test_zero_setpoints_do_not_count(spark, tmp_path):
    """A relative distance needs a setpoint above zero, in the query and in its SQL."""
    rows = [(10 * d + i, T0 + timedelta(days=d), 1, kind, v, "") for d in range(5) for i, (kind, v) in enumerate([("view", 10.0), ("click", 10.0 if d else 0.0)])]
    got = on_events(spark, tmp_path, "responsiveness", rows)
    assert [(r["n"], r["status"]) for r in got if r["pair"] == "air_flow"] == [(4, "pass")]


def test_reversals_at_one_time(spark, tmp_path):
    """Extremes of one time are in order of value, in the query and in its SQL."""
    rows = [(2 * i + j, T0 + timedelta(minutes=i), 1, "view", (v * (i % 7 + 1)) % 90.0, "") for i in range(400) for j, v in enumerate((20.0, 70.0))]
    got = on_events(spark, tmp_path, "rule_hunting", rows)
    assert got[0]["judged"] and got[0]["rate"] > 60
    assert "ORDER BY turn_ts, turn)" in registry.oracles()["rule_hunting"]  # a total order


def test_blocks_stay_whole_in_a_join_that_becomes_a_broadcast(spark):
    """The join of samples and spans is planned by sorting, as on large tables, and then becomes a broadcast."""
    rows = [(f"s{k}", T0 + timedelta(minutes=i), float((i * (k + 3)) % 23)) for i in range(3000) for k in range(4)]
    frame = spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double").repartition(8)
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "64k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}  # 64k: below the samples, above the spans
    for name, value in confs.items():
        spark.conf.set(name, value)
    try:
        got = {}
        for r in rules.turns(frame, "k", 5.0).collect():
            got.setdefault(r.k, []).append((r.ts, r.value))
    finally:
        for name in confs:
            spark.conf.unset(name)
    for key, found in got.items():
        own = [(at, value) for k, at, value in rows if k == key]
        walk = rules.Zigzag(*own[0], 5.0)
        assert sorted(found) == [turn for at, value in own[1:] if (turn := walk.step(at, value))]
    assert len(got) == 4


def test_interpolation_of_one_day_is_many_tasks(spark):
    """Spans with gaps of numbers; the plan keys the grid by short blocks, not by the day."""
    rows = [(s, T0 + timedelta(seconds=97 * i + s), None if i % 5 == s else float(i * s)) for s in range(4) for i in range(60) if (i + s) % 3]
    frame = spark.createDataFrame(rows, "series long, ts timestamp_ntz, value double")
    got = {(r.series, r.ts): r.value for r in rollup.interpolate(frame).collect()}
    want, seen = {}, sorted({t for _, t, _ in rows})
    for s in range(4):
        own = [t for x, t, _ in rows if x == s]
        known = sorted((t, v) for x, t, v in rows if x == s and v is not None)
        for t in (t for t in seen if min(own) <= t <= max(own)):
            a, b = max((k for k in known if k[0] <= t), default=None), min((k for k in known if k[0] >= t), default=None)
            want[s, t] = None if a is None else a[1] if a[0] == t else None if b is None else a[1] + (b[1] - a[1]) * ((t - a[0]) / (b[0] - a[0]))
    assert got.keys() == want.keys()
    assert all((v is None) == (want[k] is None) and (v is None or abs(v - want[k]) < 1e-9) for k, v in got.items())
    assert "day#" not in rollup.interpolate(frame)._jdf.queryExecution().optimizedPlan().toString()


def test_spec_match_by_the_substrings_that_count(spark):
    specs, fields = ["AHU-12-sat", "12", "VAV 7", "vav7a", "pump", "fan3x4", "zz9", "--"], ["ahu12", "xAHU-12", "vav-7", "bvav7a", "7", "pump-1", "3x4", "q9", "fan"]
    plain = lambda t: "".join(c for c in t.lower() if c.isascii() and c.isalnum())
    digits, letters = lambda t: "".join(c for c in plain(t) if c.isdigit()), lambda t: "".join(c for c in plain(t) if c.isalpha())

    def score(a, b):
        n, w = digits(a) and digits(a) == digits(b), letters(a) and letters(a) == letters(b)
        if not (n or w):
            return 0
        return 1.0 if plain(a) == plain(b) else 0.9 if plain(a) in plain(b) or plain(b) in plain(a) else 0.4 if n else 0.2

    want = {a: min((-score(a, b), b) for b in fields) for a in specs}
    tags = lambda names: spark.createDataFrame([(x,) for x in names], "tag string")
    match = verify.spec_match(tags(specs), tags(fields))
    assert {r.spec: (-r.score, r.field) for r in match.collect()} == {a: x for a, x in want.items() if x[0] < 0}
    # A name of one word and one number has few substrings with all of either.
    many = spark.range(40_000).select(F.format_string("Customer#%09d", "id").alias("tag"))
    began = time.perf_counter()
    assert verify.spec_match(many, many).where("score = 1").count() == 40_000
    assert time.perf_counter() - began < 30


def test_spec_match_finds_names_contained_with_another_number(spark):
    """A contained name needs neither the whole number nor all letters of the longer one."""
    r, plain = random.Random(3), lambda t: "".join(c for c in t.lower() if c.isascii() and c.isalnum())
    word = lambda: "".join(r.choice(("AHU", "vav", "-", "1", "2", "x", " ", "7a")) for _ in range(r.randint(1, 6)))
    specs, fields = sorted({"AHU-1", "7", "zone", *(word() for _ in range(60))}), sorted({"Bldg 3 AHU-1", "z", *(word() for _ in range(60))})

    def score(a, b):
        a, b = plain(a), plain(b)
        digits, letters = ([tuple(c for c in t if c.isdigit() == want) for t in (a, b)] for want in (True, False))
        if not a or not b:
            return 0
        return 1.0 if a == b else 0.9 if a in b or b in a else 0.4 if digits[0] and digits[0] == digits[1] else 0.2 if letters[0] and letters[0] == letters[1] else 0

    tags = lambda names: spark.createDataFrame([(x,) for x in names], "tag string")
    for spec, field in ((["AHU-1"], ["Bldg 3 AHU-1", "q1"]), (["Bldg 3 AHU-1"], ["AHU-1"]), (specs, fields)):
        want = {a: min((-score(a, b), b) for b in field) for a in spec}
        got = {x.spec: (-x.score, x.field) for x in verify.spec_match(tags(spec), tags(field)).collect()}
        assert got == {a: x for a, x in want.items() if x[0] < 0}
    assert {-x[0] for x in want.values()} >= {0.9, 1.0}


def test_observations_wait_in_one_list():
    """State of a key is read and written a call each, whatever the number of rows."""
    import pandas as pd

    from plantflow.streaming import alerts

    calls = []

    class State:
        def __getattr__(self, name):
            return lambda *a: calls.append(name) or ([] if name == "get" and self.many else None)

    one = alerts.Alerts(alerts.Limits())
    one.alert, one.waiting, one.awake, one.handle = State(), State(), State(), State()
    one.alert.many = one.awake.many = one.handle.many = False
    one.waiting.many = True
    times = type("T", (), {"getCurrentWatermarkInMs": lambda self: 0})()
    frame = pd.DataFrame({"ts": pd.to_datetime([T0 + timedelta(seconds=i) for i in range(500)]), "present": [True] * 500})
    assert sum(map(len, one.handleInputRows(("k",), iter([frame]), times))) == 0
    assert len(calls) < 12


def test_cosine_of_vectors_that_lack_something(spark):
    """Slices lose no pair; null vectors, nulls inside and other lengths have no cosine."""
    vectors = {0: [1.0, 0.0], 1: [1.0, 1.0], 2: None, 3: [1.0, None], 4: [1.0, 2.0, 3.0], 5: [-2.0, 0.0]}
    e = spark.createDataFrame([(i, i // 9, v) for i, v in vectors.items()], "id long, label int, v array<float>")
    a, b = e.where("id in (0, 2, 4)").selectExpr("id AS q", "label", "v AS x"), e.selectExpr("id", "label", "v AS y")
    got = {(r.q, r.id): None if r.sim is None else round(r.sim, 6) for r in mapping.cosine_pairs(a, b, 3).collect()}
    assert got == {(q, i): {(0, 1): 0.707107, (0, 5): -1.0}.get((q, i)) for q in (0, 2, 4) for i in vectors if i != q}


def test_cosine_of_all_vectors(spark, tmp_path):
    """Every vector asks, whatever its id; labels of several slices a side lose no pair, and no task holds a whole label."""
    vectors = [(i, [float(i % 7 + 1), float(i % 11), 1.0], i % 3 if i % 20 else None) for i in range(1, 301)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["vector_cosine"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(registry.oracles()["vector_cosine"]).fetchall())
    want = {(q, i) for q, _, a in vectors for i, _, b in vectors if q != i and a == b and a is not None}
    assert {(r.q, r.id) for r in got} == want and len(got) == len(want)
    e = spark.createDataFrame(vectors, "id long, v array<float>, label int")
    sliced = mapping.cosine_pairs(e.selectExpr("id AS q", "label", "v AS x"), e.selectExpr("id", "label", "v AS y"), block=16)
    assert sorted((r.q, r.id, round(r.sim, 5)) for r in sliced.collect()) == sorted((r.q, r.id, round(r.sim, 5)) for r in got)
    assert sliced.rdd.getNumPartitions() > 100


def test_parts_without_days_are_many_tasks(spark, tmp_path):
    table = upsert.UpsertTable(spark, str(tmp_path / "t"), "k long, seq long, v double", keys=("k",), ts_col=None, buckets=1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table.merge(spark.range(1_000).selectExpr("id AS k", "id AS seq", "1.0D AS v"), "one")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert table.snapshot().count() == 1_000 and len(table.snapshot().inputFiles()) > 1


def test_ended_paths_need_no_round(spark, monkeypatch):
    """A path of one step is one round of joins, not a second that finds nothing."""
    cuts = []
    monkeypatch.setattr(paths, "cut", lambda df: cuts.append(1) or df)
    triples = spark.createDataFrame([("a", "p", "b"), ("b", "p", "c")], "s string, p string, o string")
    got = paths.reach(triples, paths.step("p"), spark.createDataFrame([("a",), ("b",)], "start string"))
    assert sorted(map(tuple, got.collect())) == [("a", "b"), ("b", "c")]
    assert len(cuts) == 3  # edges, starts, one round


def test_applicable_rows_are_not_gathered(spark):
    """Rows and subjects that meet by several keys are one pair, without a pass over all pairs to find the repeated ones."""
    rows = [(1, "x", 0, [], ["a", "b"], ["Pump"]), (1, "x", 0, [], ["c"], []), (2, "x", 0, ["late"], ["a"], []), (3, "x", 0, ["now"], [], ["fan", "PUMP", None]), (4, None, 0, [], ["a"], []),
            (5, "x", 1, [], ["a"], []), (6, "x", 0, [], [None, "d"], None), (7, "x", 0, [], ["a", "a"], ["Fan"]), (8, "x", 0, [], ["zz"], ["none"])]
    subjects = [(10, "a", "small pump"), (10, "b", "Fan"), (11, None, "Small Pump"), (12, "d", None), (13, "c", "FAN"), (14, "q", "other"), (15, "a", None)]
    above = {"small pump": ["small pump", "pump", "fan"]}
    requirements = spark.createDataFrame(rows, "row long, verified_by string, blanks int, phases array<string>, space_types array<string>, classes array<string>")
    family = spark.createDataFrame([(c, a) for c, up in above.items() for a in up], "class string, ancestor string")
    got = verify.applicable(requirements, spark.createDataFrame(subjects, "subject long, space_type string, class string"), family, "now")
    want = set()
    for row, verified, blanks, phases, types, classes in rows:
        for subject, kind, name in subjects:
            wants = above.get(name.lower(), [name.lower()]) if name else []
            fits = (kind and kind in types) or any(c and c.lower() in wants for c in classes or [])
            if verified and not blanks and (not phases or "now" in phases) and fits:
                want.add((subject, row))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 10
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < (plan + "Aggregate").index("Aggregate")  # nothing is grouped after the pairs


def test_sequence_items_read_the_samples_once(spark):
    """Items are tested in one pass over their common steps, not by a read and a resampling each."""
    bound = spark.createDataFrame(
        [(e, i, r, True, f"{e}{r}" if (e, r) != ("f", "heat") else None, "", "number") for e in "ef" for i, rs in (("zone_deadband", ("cool", "heat")), ("sat_reset", ("setpoint",))) for r in rs],
        "equip string, item string, role string, needed boolean, point string, how string, kind string",
    )
    values = {"ecool": [24.0, 21.0, 24.0], "eheat": [20.0, 20.0, 20.0], "esetpoint": [12.0, 18.0, 12.0], "fcool": [24.0], "fsetpoint": [15.0, 15.0]}
    rows = [(p, T0 + timedelta(minutes=5 * i), v, None, None, None) for p, vs in values.items() for i, v in enumerate(vs)]
    samples = spark.createDataFrame(rows, "point string, ts timestamp_ntz, value double, text string, flag boolean, unit string")
    items = (roles.deadband_item(), roles.supply_item(30.0))
    got = roles.check_items(bound, roles.resampled(bound, samples), items, 0.3)
    assert {(r.equip, r.item): tuple(r)[2:] for r in got.collect()} == {
        ("e", "zone_deadband"): (2, 1, "", "fail"), ("e", "sat_reset"): (3, 0, "", "pass"), ("f", "zone_deadband"): (0, 0, "heat", "inconclusive"), ("f", "sat_reset"): (0, 2, "", "fail")}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD [point#") == 1
