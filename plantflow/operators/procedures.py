"""Criteria of test procedures on equipment: ranges, availability, responses, results of checks, and how they fold.

A procedure applies to pieces of equipment: `applies` is (criterion, equip). Criteria are rows with
`criterion`, `point_class` or `point`, `required`, and the columns of their kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantflow.functions.scalars import is_fahrenheit
from plantflow.operators.timejoin import micros
from plantflow.operators.verify import worst

EPSILON = 1e-9


def targets(applies: DataFrame, criteria: DataFrame, points: DataFrame, family: DataFrame) -> DataFrame:
    """(criterion, equip, point_uri, unit): a named point counts for all equipment, a class for the equipment's own points.

    Points are (equip, point_uri, class, unit), family (class, ancestor); classes under the wanted one count.
    """
    columns = ["criterion", "equip", "point_uri", "unit"]
    own = points.select("equip", "point_uri", "unit", F.lower("class").alias("class"))
    above = family.select("class", F.col("ancestor").alias("want"))
    known = own.join(above, "class").unionByName(own.withColumn("want", F.col("class")))
    by_class = known.join(criteria.where("point is null").select("criterion", F.lower("point_class").alias("want")), "want")
    by_class = by_class.join(applies, ["criterion", "equip"], "left_semi")
    named = criteria.where("point is not null").select("criterion", F.col("point").alias("point_uri")).join(applies, "criterion")
    by_uri = named.join(own.select("point_uri", "unit"), "point_uri")
    return by_class.select(columns).unionByName(by_uri.select(columns)).distinct()


def in_rule_hours(ts: Column) -> Column:
    """Whether an instant lies in the local hours of its row (zone, days, from_hour, to_hour); nulls don't restrict."""
    local = F.when(F.col("zone").isNull(), ts.cast("timestamp")).otherwise(F.from_utc_timestamp(ts.cast("timestamp"), F.col("zone")))
    day = F.col("days").isNull() | F.array_contains("days", F.weekday(local))
    return day & (F.hour(local) >= F.coalesce("from_hour", F.lit(0))) & (F.hour(local) < F.coalesce("to_hour", F.lit(24)))


def judge_range(aims: DataFrame, criteria: DataFrame, samples: DataFrame, truncated: DataFrame) -> DataFrame:
    """(criterion, equip, point_uri, low, high, status) of range criteria (lo, hi, unit F or C, zone, days, from_hour, to_hour).

    Limits follow the unit of the point. A point without numbers in the judged hours is inconclusive;
    one whose read was truncated (point_uri) can fail but not pass.
    """
    hours = ["zone", "days", "from_hour", "to_hour"]
    rules = criteria.select("criterion", "lo", "hi", F.col("unit").alias("in_unit"), *hours)
    bound = aims.join(rules, "criterion")
    read = samples.where("value is not null").join(bound.select("criterion", "point_uri", *hours).distinct(), "point_uri")
    seen = read.where(in_rule_hours(F.col("ts"))).groupBy("criterion", "point_uri").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    rows = bound.join(seen, ["criterion", "point_uri"], "left").join(truncated.select("point_uri").distinct().withColumn("cut", F.lit(True)), "point_uri", "left")
    warm = F.coalesce(is_fahrenheit(F.col("unit")), F.lit(False))
    to_celsius, to_fahrenheit = (F.col("in_unit") == "F") & (F.col("unit") != "") & ~warm, (F.col("in_unit") == "C") & warm
    limit = lambda x: F.when(to_celsius, (F.col(x) - 32) * 5 / 9).when(to_fahrenheit, F.col(x) * 9 / 5 + 32).otherwise(F.col(x))
    outside = F.coalesce(F.col("low") < limit("lo"), F.lit(False)) | F.coalesce(F.col("high") > limit("hi"), F.lit(False))
    status = F.when(F.col("low").isNull(), "inconclusive").when(outside, "fail").when(F.col("cut"), "inconclusive").otherwise("pass")
    return rows.select("criterion", "equip", "point_uri", "low", "high", status.alias("status"))


def judge_availability(aims: DataFrame, criteria: DataFrame, samples: DataFrame, start: Column, end: Column, truncated: DataFrame) -> DataFrame:
    """(criterion, equip, point_uri, pct, status) of criteria (max_gap_s, min_pct) over [start, end), whatever kind of value a sample has.

    The distance to the next sample is found once a point; each criterion then applies its own gap.
    """
    lo, hi, t = micros(start), micros(end), micros(F.col("ts"))
    inside = samples.where((t >= lo) & (t < hi)).select("point_uri", t.alias("t"))
    held = inside.withColumn("held", F.coalesce(F.lead("t").over(Window.partitionBy("point_uri").orderBy("t")), hi) - F.col("t"))
    bound = aims.join(criteria.select("criterion", (F.col("max_gap_s") * 1_000_000).cast("long").alias("gap"), "min_pct"), "criterion")
    covers = held.join(bound.select("criterion", "point_uri", "gap").distinct(), "point_uri").groupBy("criterion", "point_uri", "gap")
    covers = covers.agg((F.sum(F.least("held", "gap")) + F.least(F.min("t") - lo, F.col("gap"))).alias("cover")).drop("gap")
    rows = bound.join(covers, ["criterion", "point_uri"], "left").join(truncated.select("point_uri").distinct().withColumn("cut", F.lit(True)), "point_uri", "left")
    pct = F.round(100 * F.least(F.coalesce("cover", F.lit(0)), hi - lo) / (hi - lo), 2)
    status = F.when(F.col("cut"), "inconclusive").when(F.col("pct") + EPSILON < F.col("min_pct"), "fail").otherwise("pass")
    return rows.withColumn("pct", pct).select("criterion", "equip", "point_uri", "pct", status.alias("status"))


def judge_response(whens: DataFrame, thens: DataFrame, criteria: DataFrame, samples: DataFrame) -> DataFrame:
    """(criterion, equip, point_uri, trigger, edge, moved, status) of criteria (equals, changes_by, within_s).

    `whens` and `thens` are the targets of both sides. After each start of the condition every `then` point
    must move; equipment with both sides whose condition never started has one inconclusive row.
    Edges and samples meet by point and time slots as long as the criterion's time.
    """
    rule = criteria.select("criterion", "equals", "changes_by", "within_s")
    valued = samples.where("value is not null").select("point_uri", "ts", "value")
    was = F.lag("value").over(Window.partitionBy("point_uri").orderBy("ts"))
    starts = valued.withColumn("was", was).join(whens.join(rule, "criterion"), "point_uri").where("value = equals and was <> equals")
    edges = starts.select("criterion", "equip", F.col("point_uri").alias("trigger"), F.col("ts").alias("edge"))
    bound = thens.select("criterion", "equip", "point_uri").join(rule, "criterion")
    slot = lambda c: F.floor(micros(c) / (F.col("within_s") * 1_000_000))
    pairs = edges.join(bound, ["criterion", "equip"])
    slots = pairs.withColumn("slot", F.explode(F.array(slot(F.col("edge")), slot(F.col("edge")) + 1)))
    timed = valued.join(bound.select("criterion", "point_uri", "within_s").distinct(), "point_uri").select("criterion", "point_uri", "ts", "value", slot(F.col("ts")).alias("slot"))
    near = slots.join(timed, ["criterion", "point_uri", "slot"], "left")
    after = micros(F.col("ts")) - micros(F.col("edge"))
    value = F.when((after >= 0) & (after <= F.col("within_s") * 1_000_000), F.col("value"))
    moved = near.groupBy("criterion", "equip", "point_uri", "trigger", "edge", "changes_by").agg(F.count(value).alias("n"), (F.max(value) - F.min(value)).alias("swing"))
    moved = moved.withColumn("moved", F.when(F.col("n") >= 2, F.col("swing")))
    status = F.when(F.col("moved") + EPSILON >= F.col("changes_by"), "pass").otherwise("fail")
    judged = moved.select("criterion", "equip", "point_uri", "trigger", "edge", "moved", status.alias("status"))
    both = whens.select("criterion", "equip").distinct().join(thens.select("criterion", "equip"), ["criterion", "equip"], "left_semi")
    idle = both.join(edges, ["criterion", "equip"], "left_anti").withColumn("status", F.lit("inconclusive"))
    return judged.unionByName(idle, allowMissingColumns=True)


def judge_checks(criteria: DataFrame, results: DataFrame) -> DataFrame:
    """(criterion, equip, status) of results (equip, check, severity, status) that criteria (check, severity, strict) ask for.

    A check is met by its own id and by ids below it after a colon; one that ends in a colon or a star
    by all ids that start so. A strict criterion counts inconclusive results as failures. Only the
    distinct ids are matched, by their beginnings.
    """
    star, colon = F.col("check").endswith("*"), F.col("check").endswith(":")
    head = F.when(star, F.expr("left(check, length(check) - 1)")).otherwise(F.col("check"))
    wanted = criteria.select("criterion", head.alias("head"), (star | colon).alias("open"), F.col("severity").alias("grade"), F.coalesce("strict", F.lit(False)).alias("strict"))
    begins = F.explode(F.transform(F.sequence(F.lit(0), F.length("check")), lambda n: F.substring("check", 1, n)))
    ids = results.select("check").distinct().withColumn("head", begins).join(wanted, "head")
    ids = ids.where("open or head = check or substring(check, length(head) + 1, 1) = ':'").drop("head")
    rows = results.join(ids, "check").where("grade is null or grade = severity")
    status = F.when(F.col("strict") & (F.col("status") == "inconclusive"), "fail").otherwise(F.col("status"))
    return rows.select("criterion", "equip", status.alias("status"))


def fold(applies: DataFrame, criteria: DataFrame, judged: DataFrame) -> DataFrame:
    """(criterion, equip, n_pass, n_fail, n_inconclusive, status) for every criterion that applies.

    Without anything judged a required criterion, or one about a named point, is inconclusive, others not applicable.
    """
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    counts = judged.groupBy("criterion", "equip").agg(n("pass"), n("fail"), n("inconclusive"), worst(F.col("status")).alias("status"))
    needed = criteria.select("criterion", (F.coalesce("required", F.lit(False)) | F.col("point").isNotNull()).alias("needed"))
    rows = applies.join(needed, "criterion").join(counts, ["criterion", "equip"], "left").na.fill(0, ["n_pass", "n_fail", "n_inconclusive"])
    status = F.coalesce("status", F.when(F.col("needed"), "inconclusive").otherwise("not_applicable"))
    return rows.select("criterion", "equip", "n_pass", "n_fail", "n_inconclusive", status.alias("status"))


def procedure_results(folded: DataFrame, steps: DataFrame) -> DataFrame:
    """(equip, step, status) by the worst of a step's criteria, steps are (criterion, step); the row without a step is the whole procedure."""
    by_step = folded.join(steps, "criterion").groupBy("equip", "step").agg(worst(F.col("status")).alias("status"))
    whole = by_step.groupBy("equip").agg(worst(F.col("status")).alias("status"))
    return by_step.unionByName(whole.withColumn("step", F.lit(None).cast("string")))
