"""Verification checks over equipment: existence, liveness, responsiveness, ladders, sequences, compliance, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantflow.operators.timejoin import micros
from plantflow.session import cut
from plantflow.sources.history import HAS_VALUE

RANKS = {"fail": 0, "inconclusive": 1, "pass": 2}


def worst(status: Column, empty: str = "not_applicable") -> Column:
    """Aggregate: fail before inconclusive before pass; `not_applicable` doesn't count; nothing left gives `empty`."""
    rank = F.when(status == "fail", 0).when(status == "inconclusive", 1).when(status == "pass", 2)
    low = F.min(rank)
    return F.when(low == 0, "fail").when(low == 1, "inconclusive").when(low == 2, "pass").otherwise(empty)


def existence(points: DataFrame, history: DataFrame, now, window_s: float) -> DataFrame:
    """Pass with a recent value, fail with only empty or old samples, inconclusive if never heard of."""
    newest = history.groupBy("point_uri").agg(F.max("ts").alias("newest"), F.max(F.when(F.expr(HAS_VALUE), F.col("ts"))).alias("valued"))
    fresh = micros(F.col("valued")) >= micros(now) - int(window_s * 1e6)
    status = F.when(F.col("newest").isNull(), "inconclusive").when(fresh, "pass").otherwise("fail")
    return points.select("point_uri").distinct().join(newest, "point_uri", "left").select("point_uri", status.alias("status"))


def liveness(history: DataFrame, key: str = "point_uri", least: int = 3, flat: float = 0.01) -> DataFrame:
    """Fewer than `least` numbers: inconclusive; range within `flat`: fail."""
    stats = history.groupBy(key).agg(F.count("value").alias("n"), F.max("value").alias("hi"), F.min("value").alias("lo"))
    status = F.when(F.col("n") < least, "inconclusive").when(F.col("hi") - F.col("lo") <= flat, "fail").otherwise("pass")
    return stats.select(key, status.alias("status"))


def agreement(paired: DataFrame, key: str, least: int = 3, needed: float = 0.9) -> DataFrame:
    """Share of paired samples (value, match) on the same side of 0.5."""
    same = ((F.col("value") > 0.5) == (F.col("match") > 0.5)).cast("int")
    stats = paired.groupBy(key).agg(F.count("*").alias("n"), F.avg(same).alias("ratio"))
    status = F.when(F.col("n") < least, "inconclusive").when(F.col("ratio") >= needed, "pass").otherwise("fail")
    return stats.select(key, "n", "ratio", status.alias("status"))


def tracking(paired: DataFrame, key: str, tolerance: float, relative: bool = False, least: int = 3) -> DataFrame:
    """Mean (relative) distance between paired sensor and setpoint samples."""
    miss = F.abs(F.col("value") - F.col("match"))
    rows = paired.where("match > 0") if relative else paired
    stats = rows.groupBy(key).agg(F.count("*").alias("n"), F.avg(miss / F.col("match") if relative else miss).alias("mae"))
    status = F.when(F.col("n") < least, "inconclusive").when(F.col("mae") <= tolerance, "pass").otherwise("fail")
    return stats.select(key, "n", "mae", status.alias("status"))


def tail_flat(samples: DataFrame, key: str, share: float = 0.25, flat: float = 0.01) -> DataFrame:
    """Whether the last part of each series' time span hardly moves."""
    ends = samples.groupBy(key).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    start = micros(F.col("hi")) - share * (micros(F.col("hi")) - micros(F.col("lo")))
    tail = samples.join(ends, key).where(micros(F.col("ts")) >= start)
    return tail.groupBy(key).agg(((F.max("value") - F.min("value")) <= flat).alias("flat"))


def ladder(rungs: DataFrame, key: str) -> DataFrame:
    """Highest rung and status from (key, rung, status); nothing above a failed rung counts."""
    at = {r: F.max(F.when(F.col("rung") == r, F.col("status"))).alias(f"r{r}") for r in (1, 2, 3)}
    wide = rungs.groupBy(key).agg(*at.values())
    ok = lambda r: F.coalesce(F.col(f"r{r}") == "pass", F.lit(False))
    highest = F.when(~ok(1), 0).when(~ok(2) & F.col("r2").isNotNull(), 1).when(~ok(3), F.when(ok(2), 2).otherwise(1)).otherwise(3)
    failed = F.greatest(*(F.coalesce((F.col(f"r{r}") == "fail").cast("int"), F.lit(0)) for r in (1, 2, 3))) == 1
    status = F.when(failed, "fail").when(F.col("highest") == 3, "pass").otherwise("inconclusive")
    return wide.withColumn("highest", highest).select(key, "highest", status.alias("status"))


def completeness(equips: DataFrame, points: DataFrame, templates: DataFrame) -> DataFrame:
    """(equip, needed, met) from equips (equip, type), points (equip, class), templates (type, class)."""
    wanted = equips.join(templates, "type").select("equip", "class")
    have = points.select("equip", "class").distinct().withColumn("hit", F.lit(1))
    return wanted.join(have, ["equip", "class"], "left").groupBy("equip").agg(F.count("*").alias("needed"), F.count("hit").alias("met"))


def economizer(rows: DataFrame, high_limit: float, minimum: float = 20, tolerance: float = 5, margin: float = 1, on: float = 5) -> DataFrame:
    """Counts for both economizer checks on aligned rows (key, oat, damper, cooling, rat)."""
    hot = F.col("oat") > high_limit + margin
    cool = (F.col("cooling") > on) & (F.col("oat") < high_limit - margin) & (F.col("rat").isNull() | (F.col("oat") < F.col("rat") - margin))
    return rows.groupBy("key").agg(
        F.count_if(hot).alias("hot"),
        F.count_if(hot & (F.col("damper") > minimum + tolerance)).alias("hot_fail"),
        F.count_if(cool).alias("cool"),
        F.count_if(cool & (F.col("damper") <= minimum + tolerance)).alias("cool_fail"),
    )


def sequence(rows: DataFrame, key: str, test: Column, allowed: float = 0.0) -> DataFrame:
    """Any failed step fails (beyond the allowed share of tested ones), else any passed step passes, else untested.

    `test` is null where a step can't be judged.
    """
    steps = rows.groupBy(key).agg(F.count_if(test).alias("ok"), F.count_if(~test).alias("bad"))
    status = F.when(F.col("bad") > allowed * (F.col("ok") + F.col("bad")), "fail").when(F.col("ok") > 0, "pass").otherwise("untested")
    return steps.select(key, "ok", "bad", status.alias("status"))


def compliance(samples: DataFrame, key: str, lo: float, hi: float, coverage: DataFrame, needed_pct: float) -> DataFrame:
    """fail on any sample outside [lo, hi], else inconclusive under the needed coverage; with the worst sample."""
    miss, middle = (F.col("value") < lo) | (F.col("value") > hi), (lo + hi) / 2
    stats = samples.groupBy(key).agg(F.count_if(miss).alias("n_bad"), F.max_by("value", F.struct(F.abs(F.col("value") - middle), "ts")).alias("worst"))
    status = F.when(F.col("n_bad") > 0, "fail").when(F.coalesce("pct", F.lit(0.0)) < needed_pct, "inconclusive").otherwise("pass")
    return stats.join(coverage, key, "left").select(key, "n_bad", "worst", status.alias("status"))


def space_compliance(requirements: DataFrame, spaces: DataFrame, points: DataFrame, family: DataFrame, samples: DataFrame, now: Column, gap_s: float = 900) -> tuple[DataFrame, DataFrame]:
    """(per space and requirement, per point) judgements of the requirements that apply to each space.

    `requirements` is (row, space_type, point_class, op, lo, hi, hours, coverage): the operator of `scalars.meets` with its limit in `lo` (both
    for between), over the last `hours`, reported for at least the share `coverage`; without an operator or a class nothing can be judged.
    `spaces` is (space, space_type), `points` (space, point, class), `family` (class, ancestor), `samples` (point, ts, value).

    A point fails on any sample that breaks the criterion, else it is inconclusive when covered too little; its worst sample is the one
    farthest from the limit, or from the middle of two. A space fails with any of its points, and is inconclusive without one.
    """
    from plantflow.functions.scalars import meets

    work = requirements.join(spaces, "space_type").drop("space_type")
    kinds = points.join(family, "class").select("space", "point", F.col("ancestor").alias("point_class")).unionByName(points.select("space", "point", F.col("class").alias("point_class"))).distinct()
    judged = work.where("op is not null and point_class is not null").join(kinds, ["space", "point_class"])
    keys = ["space", "row", "point"]
    end = micros(now)
    start = end - (F.col("hours") * 3_600_000_000).cast("long")
    rows = judged.join(samples.where("value is not null"), "point").withColumns({"t": micros(F.col("ts")), "start": start}).where((F.col("t") >= F.col("start")) & (F.col("t") <= end))
    gap = F.lit(int(gap_s * 1e6))
    following = F.lead("t").over(Window.partitionBy(*keys).orderBy("t"))
    ok = None
    for op in ("between", ">=", "<=", ">", "<", "=="):
        one = F.when(F.col("op") == op, meets(F.col("value"), op, F.col("lo"), F.col("hi")))
        ok = one if ok is None else F.coalesce(ok, one)
    target = F.when(F.col("op") == "between", (F.col("lo") + F.col("hi")) / 2).otherwise(F.col("lo"))
    rows = rows.withColumns({"cover": F.least(F.coalesce(following, end) - F.col("t"), gap), "bad": ~ok, "far": F.abs(F.col("value") - target)})
    bad = lambda column: F.when(F.col("bad"), column)
    stats = rows.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.min("value").alias("low"), F.max("value").alias("high"), F.count_if("bad").alias("exceedances"), F.min(bad(F.col("ts"))).alias("first"), F.max(bad(F.col("ts"))).alias("last"),
        F.min_by("value", bad(F.struct(-F.col("far"), F.col("ts")))).alias("worst"), (F.sum("cover") + F.least(F.min("t") - F.min("start"), gap)).alias("covered"),
    )
    each = judged.select(*keys, "hours", "coverage").join(stats, keys, "left")
    total = (F.col("hours") * 3_600_000_000).cast("long")
    pct = F.round(100 * F.least(F.coalesce("covered", F.lit(0)), total) / total, 2)
    status = F.when(F.col("exceedances") > 0, "fail").when(pct < 100.0 * F.col("coverage"), "inconclusive").otherwise("pass")
    counted = [F.coalesce(c, F.lit(0)).alias(c) for c in ("samples", "exceedances")]
    each = each.select(*keys, *counted, pct.alias("coverage_pct"), "low", "high", "first", "last", "worst", status.alias("status"))
    worst_of = F.when(F.bool_or(F.col("status") == "fail"), "fail").when(F.bool_or(F.col("status") == "inconclusive"), "inconclusive").otherwise("pass")
    folded = each.groupBy("space", "row").agg(worst_of.alias("status"), F.count("*").alias("points"))
    whole = work.select("space", "row").join(folded, ["space", "row"], "left")
    return whole.select("space", "row", F.coalesce("status", F.lit("inconclusive")).alias("status"), F.coalesce("points", F.lit(0)).alias("points")), each


def gate(results: DataFrame, waivers: DataFrame, phase: str = "phase") -> DataFrame:
    """A phase passes when every failed item is waived."""
    failed = results.where("status = 'fail'").join(waivers, "item", "left_anti").groupBy(phase).agg(F.count("*").alias("open"))
    return results.select(phase).distinct().join(failed, phase, "left").select(phase, F.coalesce("open", F.lit(0)).alias("open"), F.col("open").isNull().alias("passed"))


def issue_transitions(issues: DataFrame, results: DataFrame) -> DataFrame:
    """New state of each issue (key, state) after a run's results (key, status)."""
    both = issues.join(results, "key", "full_outer")
    state = (
        F.when(F.col("state").isNull() & (F.col("status") == "fail"), "open")
        .when(F.col("state").isin("open", "accepted") & (F.col("status") == "pass"), "resolved")
        .when((F.col("state") == "resolved") & (F.col("status") == "fail"), "reopened")
        .otherwise(F.col("state"))
    )
    return both.select("key", state.alias("state")).where("state is not null")


def mirror_plan(failing: DataFrame, open_faults: DataFrame) -> DataFrame:
    """Faults to open and to close so that open faults equal failing checks."""
    to_open = failing.select("key").join(open_faults.select("key"), "key", "left_anti").withColumn("action", F.lit("open"))
    to_close = open_faults.select("key").join(failing.select("key"), "key", "left_anti").withColumn("action", F.lit("close"))
    return to_open.unionByName(to_close)


def deadband(rows: DataFrame, key: str, least: float = 2.77, slack: float = 0.5) -> DataFrame:
    """Cooling and heating setpoints (key, cool, heat) must stay apart."""
    return sequence(rows, key, F.when(F.col("cool").isNotNull() & F.col("heat").isNotNull(), F.col("cool") - F.col("heat") > least - slack))


def reset_range(samples: DataFrame, key: str, design: float, share: float = 0.25) -> DataFrame:
    """A reset setpoint must use at least a share of the range up to its design value."""
    ends = samples.groupBy(key).agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
    return ends.select(key, (F.col("hi") - F.col("lo") >= (design - F.col("lo")) * share * 0.99).alias("ok"))


def loop_report(now: DataFrame, base: DataFrame, key: str, factor: float = 3.0, default: float = 12.0) -> DataFrame:
    """Loops (key, rate) worse than `factor` times their baseline; without a baseline `default` is the limit."""
    both = now.join(base.select(key, F.col("rate").alias("base")), key, "left")
    limit = F.greatest(F.coalesce(F.col("base") * factor, F.lit(default)), F.lit(1.0))
    return both.select(key, "rate", "base", (F.col("rate") / F.greatest("base", F.lit(1.0))).alias("ratio"), (F.col("rate") > limit).alias("hunting"))


def bench_tests(steps: DataFrame, measured: DataFrame) -> DataFrame:
    """Each step's measurements against its tolerance, and the first passing one as baseline.

    Steps are (step, target, tolerance), measurements (step, at, value).
    """
    ok = F.abs(F.col("value") - F.col("target")) <= F.col("tolerance")
    judged = steps.join(measured, "step", "left").groupBy("step").agg(
        F.count("value").alias("n"), F.count_if(ok).alias("passed"), F.min_by(F.when(ok, F.col("value")), F.when(ok, F.col("at"))).alias("baseline")
    )
    status = F.when(F.col("n") == 0, "untested").when(F.col("passed") > 0, "pass").otherwise("fail")
    return judged.select("step", "n", "baseline", status.alias("status"))


def spec_match(spec: DataFrame, field: DataFrame) -> DataFrame:
    """Best field tag for each spec tag by names: same 1.0, contained 0.9, same number 0.4, same letters 0.2.

    A worse way looks only at tags that no better one has matched. A name is contained in another whatever number or letters the
    other has besides, so "AHU-1" is in "Bldg 3 AHU-1". Of each substring, number or letters only the first field tag counts, so
    groups that share them are folded, not paired. Rows are (tag).
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    parts = lambda df, name: df.select(
        F.col("tag").alias(name), plain(F.col("tag")).alias(f"{name}_p"), F.regexp_replace(plain(F.col("tag")), "[^0-9]", "").alias("n"), F.regexp_replace(plain(F.col("tag")), "[0-9]", "").alias("l")
    ).distinct()
    a, b = parts(spec, "spec"), parts(field, "field")

    def within(names: DataFrame, text: str, others: DataFrame, other: str) -> DataFrame:
        """`names` with each `part` of `text` that starts with the two characters of one of the `others` and is as long: none of them is missed."""
        sizes = others.groupBy(F.substring(other, 1, 2).alias("head")).agg(F.collect_set(F.length(other)).alias("sizes"))
        at = names.withColumn("at", F.explode(F.sequence(F.lit(1), F.length(text))))
        heads = F.array_distinct(F.array(F.substring(text, F.col("at"), 1), F.substring(text, F.col("at"), 2)))  # a name of one character has a head of one
        met = at.withColumn("head", F.explode(heads)).join(F.broadcast(sizes), "head")  # 1,332 heads at most, as names are of a-z and 0-9
        fits = F.filter("sizes", lambda n: n <= F.length(text) - F.col("at") + 1)
        return met.withColumn("size", F.explode(fits)).select(*names.columns, F.substring(text, F.col("at"), F.col("size")).alias("part"))

    known = b.where("field_p != ''").groupBy("field_p").agg(F.min("field").alias("field"))
    equal = a.join(known.withColumnRenamed("field_p", "spec_p"), "spec_p").select("spec", F.lit(1.0).alias("score"), "field")
    left = cut(a.join(equal.select("spec"), "spec", "left_anti"))
    asked = left.where("spec_p != ''").select("spec", "spec_p")
    inside = within(known, "field_p", asked, "spec_p").groupBy(F.col("part").alias("spec_p")).agg(F.min("field").alias("field"))
    around = within(asked.select("spec_p").distinct(), "spec_p", known, "field_p").join(known.withColumnRenamed("field_p", "part"), "part")
    around = around.groupBy("spec_p").agg(F.min("field").alias("field"))
    rows = equal.unionByName(asked.join(inside.unionByName(around), "spec_p").select("spec", F.lit(0.9).alias("score"), "field"))
    for key, score in (("n", 0.4), ("l", 0.2)):
        first = b.where(F.col(key) != "").groupBy(key).agg(F.min("field").alias("field"))
        rows = rows.unionByName(left.join(first, key).select("spec", F.lit(score).alias("score"), "field"))
    return rows.groupBy("spec").agg(F.max("score").alias("score"), F.min_by("field", F.struct(-F.col("score"), "field")).alias("field"))


# Related pairs of points, how they are judged, and by what tolerance.
PAIRS = (
    ("fan_cmd_status", "cmd_status", ("Fan_Command",), ("Fan_Status",), 0.9),
    ("pump_cmd_status", "cmd_status", ("Pump_Command",), ("Pump_Status",), 0.9),
    ("run_cmd_status", "cmd_status", ("Start_Stop_Command", "On_Off_Command", "Enable_Command"), ("Run_Status",), 0.9),
    ("zone_air_temperature", "track_abs", ("Zone_Air_Temperature_Sensor",), ("Zone_Air_Temperature_Setpoint",), 3.0),
    ("supply_air_temperature", "track_abs", ("Supply_Air_Temperature_Sensor",), ("Supply_Air_Temperature_Setpoint",), 3.0),
    ("supply_air_static_pressure", "track_abs", ("Supply_Air_Static_Pressure_Sensor",), ("Supply_Air_Static_Pressure_Setpoint",), 0.3),
    ("air_flow", "track_rel", ("Air_Flow_Sensor",), ("Air_Flow_Setpoint",), 0.2),
)


def pair_definitions(spark, pairs=PAIRS) -> DataFrame:
    """(pair, kind, tolerance, side, class) of the pairs: configuration of fixed size."""
    rows = [(name, kind, float(tol), side, c.lower()) for name, kind, a, b, tol in pairs for side, classes in (("a", a), ("b", b)) for c in classes]
    return spark.createDataFrame(rows, "pair string, kind string, tolerance double, side string, class string")


def bind_pairs(points: DataFrame, family: DataFrame, definitions: DataFrame) -> DataFrame:
    """(equip, pair, kind, tolerance, a, b, ambiguous): the point of each side, where there is just one.

    Points are (equip, point_uri, class), family (class, ancestor). Of several points of a
    side's classes, a single one of exactly such a class is taken; otherwise the side is ambiguous.
    """
    low = points.select("equip", "point_uri", F.lower("class").alias("own"))
    wanted = F.broadcast(definitions.withColumnRenamed("class", "want"))
    known = low.join(family.select(F.col("class").alias("own"), F.col("ancestor").alias("want")), "own").unionByName(low.withColumn("want", F.col("own"))).distinct()
    hits = known.join(wanted, "want").groupBy("equip", "pair", "kind", "tolerance", "side", "point_uri").agg(F.max((F.col("own") == F.col("want")).cast("int")).alias("exact"))
    sides = hits.groupBy("equip", "pair", "kind", "tolerance", "side").agg(
        F.count("*").alias("n"), F.sum("exact").alias("n_exact"), F.min("point_uri").alias("any"), F.min(F.when(F.col("exact") == 1, F.col("point_uri"))).alias("sure")
    )
    sides = sides.withColumn("pick", F.when(F.col("n") == 1, F.col("any")).when(F.col("n_exact") == 1, F.col("sure")))
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("pick"))).alias(s)
    return sides.groupBy("equip", "pair", "kind", "tolerance").agg(pick("a"), pick("b"), F.bool_or(F.col("pick").isNull()).alias("ambiguous"))


def judge_pairs(bound: DataFrame, paired: DataFrame, least: int = 3) -> DataFrame:
    """(equip, pair, n, status) of bound pairs by their paired samples (equip, pair, value, match).

    A pair with an ambiguous side or too few paired samples is inconclusive; one without a
    point on either side isn't there at all.
    """
    v, m = F.col("value"), F.col("match")
    rows = bound.where("ambiguous or (a is not null and b is not null)").join(paired, ["equip", "pair"], "left")
    counted = v.isNotNull() & m.isNotNull() & ((F.col("kind") != "track_rel") | (m > 0))
    measure = F.when(F.col("kind") == "cmd_status", ((v > 0.5) == (m > 0.5)).cast("double")).when(F.col("kind") == "track_rel", F.abs(v - m) / m).otherwise(F.abs(v - m))
    out = rows.groupBy("equip", "pair", "kind", "tolerance", "ambiguous").agg(F.count_if(counted).alias("n"), F.avg(F.when(counted, measure)).alias("score"))
    good = F.when(F.col("kind") == "cmd_status", F.col("score") >= F.col("tolerance")).otherwise(F.col("score") <= F.col("tolerance"))
    status = F.when(F.col("ambiguous") | (F.col("n") < least), "inconclusive").when(good, "pass").otherwise("fail")
    return out.select("equip", "pair", "n", "score", status.alias("status"))


def completeness_by_family(equips: DataFrame, points: DataFrame, templates: DataFrame, family: DataFrame) -> DataFrame:
    """(equip, needed, met): a requirement is met by a point whose class counts as it, else by one with all its markers.

    Equips are (equip, type), points (equip, class, markers), templates (type, class, markers).
    """
    wanted = equips.join(templates, "type").select("equip", F.lower("class").alias("want"), F.col("markers").alias("need"))
    known = points.select("equip", F.lower("class").alias("class"), "markers").join(family, "class", "left")
    by_class = known.select("equip", F.coalesce("ancestor", "class").alias("want")).distinct().withColumn("by_class", F.lit(True))
    left = wanted.join(by_class, ["equip", "want"], "left")
    open_ = left.where("by_class is null and size(need) > 0").select("equip", "want", "need")
    tagged = points.select("equip", "markers").distinct()
    by_tags = open_.join(tagged, "equip").where(F.size(F.array_except("need", "markers")) == 0).select("equip", "want").distinct().withColumn("by_tags", F.lit(True))
    both = left.join(by_tags, ["equip", "want"], "left")
    return both.groupBy("equip").agg(F.count("*").alias("needed"), F.count_if(F.coalesce("by_class", "by_tags", F.lit(False))).alias("met"))


def readiness(rooms: DataFrame, findings: DataFrame, open_issues: DataFrame) -> DataFrame:
    """(room, status, verdict, n_open) of rooms from findings (room, part, status) and open issues (room).

    The parts are requirements, tests and balancing: any failure or open issue makes a room not
    ready, a part without a verdict leaves it incomplete.
    """
    parts = ("requirements", "tests", "balancing")
    folded = findings.groupBy("room", "part").agg(worst(F.col("status"), "inconclusive").alias("status"))
    wide = rooms.join(folded, "room", "left").groupBy("room").agg(*(F.max(F.when(F.col("part") == p, F.col("status"))).alias(p) for p in parts))
    issues = open_issues.groupBy("room").agg(F.count("*").alias("n_open"))
    rows = wide.join(issues, "room", "left").withColumn("n_open", F.coalesce("n_open", F.lit(0)))
    bad = (F.col("n_open") > 0) | F.coalesce(F.greatest(*((F.coalesce(p, F.lit("inconclusive")) == "fail").cast("int") for p in parts)) == 1, F.lit(False))
    whole = F.least(*((F.coalesce(p, F.lit("inconclusive")) == "pass").cast("int") for p in parts)) == 1
    status = F.when(bad, "fail").when(whole, "pass").otherwise("inconclusive")
    verdict = F.when(bad, "not_ready").when(whole, "ready").otherwise("incomplete")
    return rows.select("room", status.alias("status"), verdict.alias("verdict"), "n_open")


# Fixed value: the rows and the subjects of each pair of key sets are dealt to so many slices each, their product is that many tasks' work.
SLICES = 8


def applicable(requirements: DataFrame, subjects: DataFrame, family: DataFrame, phase: str) -> DataFrame:
    """(subject, row): confirmed requirement rows without blanks that apply to each space or piece of equipment in a phase.

    Requirements are (row, verified_by, blanks, phases, space_types, classes), subjects
    (subject, space_type, class). A row without phases holds in all of them; classes count with those under them.

    The result is rows times subjects by nature. Rows with equal sets of keys apply to the same subjects, so the sets are
    matched, each pair of them once; a pair of row and subject then comes up once, and none is shuffled or kept to find others like it.
    """
    active = requirements.where("verified_by is not null and blanks = 0").where((F.size("phases") == 0) | F.array_contains("phases", F.lit(phase)))
    space, kind = (lambda c, prefix=prefix: F.concat(F.lit(prefix), c) for prefix in ("space:", "class:"))
    asked = active.select("row", F.explode("space_types").alias("key")).select("row", space(F.col("key")).alias("key"))
    asked = asked.unionByName(active.select("row", F.explode("classes").alias("key")).select("row", kind(F.lower("key")).alias("key")))
    known = subjects.where("class is not null").select("subject", F.lower("class").alias("class")).join(family, "class", "left")
    owned = subjects.select("subject", space(F.col("space_type")).alias("key")).unionByName(known.select("subject", kind(F.coalesce("ancestor", "class")).alias("key")))

    def sets(rows: DataFrame, name: str, others: DataFrame) -> DataFrame:
        """The keys of each id that the other side has too."""
        shared = rows.join(others.select("key").distinct(), "key", "left_semi")
        return shared.groupBy(name).agg(F.array_sort(F.collect_set("key")).alias("keys"))

    rows, having = sets(asked, "row", owned).withColumnRenamed("keys", "asked"), sets(owned, "subject", asked).withColumnRenamed("keys", "owned")
    each = lambda of, name: of.select(name).distinct().select(name, F.explode(name).alias("key"))
    met = each(rows, "asked").join(each(having, "owned"), "key").select("asked", "owned").distinct()
    own = lambda c: F.pmod(F.xxhash64(c), F.lit(SLICES)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))
    keys = ["owned", "i", "j"]
    a = rows.join(met, "asked").select("row", "owned", own("row").alias("i"), every.alias("j"))
    b = having.select("subject", "owned", own("subject").alias("j"), every.alias("i"))
    a, b = (x.repartition(SLICES * SLICES, *keys) for x in (a, b))  # by number, so that few bytes of input don't become one task
    return a.join(b, keys).select("subject", "row")


def run_summary(results: DataFrame) -> DataFrame:
    """(equip, checks, pass, fail, inconclusive, highest, status) of a run's results (equip, rung, status)."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    highest = F.max(F.when(F.col("status") == "pass", F.col("rung"))).alias("highest")
    return results.groupBy("equip").agg(F.count("*").alias("checks"), n("pass"), n("fail"), n("inconclusive"), highest, worst(F.col("status")).alias("worst"))


def coverage_by_method(equipment: DataFrame, steps: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """Sets of equipment per class, counted: sampled, tested, passed, failed, untested, and tested by each method.

    `equipment` is (equip, class, sampled), one row each, `steps` (equip, status, method). A step without a method is passive.
    One aggregate over steps gives each equipment's flags, so no set of equipment is gathered.
    """
    judged, method = F.col("status").isin("pass", "fail"), F.coalesce("method", F.lit("passive"))
    flags = {"tested": judged, "failed": F.col("status") == "fail", "incomplete": F.col("status") == "inconclusive"}
    flags |= {f"by_{m}": judged & (method == m) for m in methods}
    seen = steps.groupBy("equip").agg(*[F.coalesce(F.bool_or(flag), F.lit(False)).alias(name) for name, flag in flags.items()])
    rows = equipment.join(seen, "equip", "left").na.fill(False, list(flags))
    passed = F.col("tested") & ~F.col("failed") & ~F.col("incomplete")
    return rows.groupBy("class").agg(
        F.count("*").alias("in_class"), F.count_if("sampled").alias("sampled"), F.count_if("tested").alias("tested"), F.count_if(passed).alias("passed"),
        F.count_if("failed").alias("failed"), F.count_if(F.col("sampled") & ~F.col("tested")).alias("untested"), *[F.count_if(f"by_{m}").alias(f"by_{m}") for m in methods],
    )
