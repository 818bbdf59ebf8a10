"""Points bound to the roles of a sequence check, and the checks on the bound points' common time grid.

A role names ranked rules; the first rule that a point meets binds it, of several points the smallest id. Rules
look at the equipment's own points or at its whole site. All rules are tested in one pass over
the points; what they match is folded by equipment (and by site) before anything is joined, so no point
meets a role that it doesn't fill.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantflow.functions import scalars
from plantflow.operators.timejoin import held_grid, micros


def exactly(name: str) -> Column:
    return F.coalesce(F.col("class") == name, F.lit(False))


def of_family(*names: str) -> Column:
    """The point's class is one of `names` or below it; `kinds` holds all that it counts as."""
    return F.coalesce(F.arrays_overlap("kinds", F.array(*map(F.lit, names))), F.lit(False))


def tagged(*tags: str) -> Column:
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0, F.lit(False))


def marked(*tags: str) -> Column:
    """Markers stand in where a point has no class."""
    return F.col("class").isNull() & tagged(*tags)


def named(pattern: str) -> Column:
    """The display name or the last part of the id matches."""
    last = F.regexp_extract(F.col("point"), "([^/]*)$", 1)
    return F.coalesce(F.col("dis").rlike(pattern), F.lit(False)) | last.rlike(pattern)


@dataclass(frozen=True)
class Rule:
    test: Callable[[], Column]
    how: str
    site: bool = False  # the equipment's whole site, not only its own points
    unique: bool = False  # counts only where a single point meets it
    kind: str | None = None  # another kind of value than the role's, for stand-ins


@dataclass(frozen=True)
class Role:
    name: str
    rules: tuple[Rule, ...]
    kind: str = "number"
    needed: bool = True


@dataclass(frozen=True)
class Item:
    name: str
    classes: tuple[str, ...]  # of the equipment that it applies to
    roles: tuple[Role, ...]
    params: dict[str, float] = field(default_factory=dict)


def by_class(*names: str, markers: tuple[str, ...] = (), how: str = "", site: bool = False, kind: str | None = None) -> tuple[Rule, ...]:
    """Classes in order of preference, then what lies below them, then markers."""
    rules = [Rule(lambda n=n: exactly(n), how or "class", site, kind=kind) for n in names]
    rules += [Rule(lambda n=n: of_family(n), how or "family", site, kind=kind) for n in names]
    if markers:
        rules.append(Rule(lambda: marked(*markers), how or "markers", site, kind=kind))
    return tuple(rules)


# The classes, in order of preference, that fill the roles of the sequence items, and what stands in for flow.
STATUS = by_class("Run_Status", "On_Off_Status", "Status", how="proxy", kind="binary")
OUTDOOR = by_class("Outside_Air_Temperature_Sensor", markers=("outside", "air", "temp", "sensor"))
OUTDOOR = OUTDOOR + tuple(Rule(r.test, "site", True) for r in OUTDOOR)


def deadband_item() -> Item:
    return Item("zone_deadband", ("Terminal_Unit",), (
        Role("cool", by_class("Zone_Air_Cooling_Temperature_Setpoint"), "temperature"),
        Role("heat", by_class("Zone_Air_Heating_Temperature_Setpoint"), "temperature")))


def supply_item(design: float) -> Item:
    classes = ("Supply_Air_Temperature_Setpoint", "Discharge_Air_Temperature_Setpoint")
    return Item("sat_reset", ("Air_Handling_Unit",), (Role("setpoint", by_class(*classes), "temperature"),), {"design": design})


def water_item(name: str, equip: str, water: str, outdoor_min: float, outdoor_max: float, water_min: float, water_max: float) -> Item:
    """Reset of chilled or hot water by outdoor temperature; `water` is Chilled or Hot."""
    roles = (
        Role("oat", OUTDOOR, "temperature"),
        Role("water", by_class(f"{water}_Water_Supply_Temperature_Sensor"), "temperature"),
        Role("flow", by_class(f"{water}_Water_Flow_Sensor") + STATUS),
    )
    return Item(name, (equip,), roles, {"outdoor_min": outdoor_min, "outdoor_max": outdoor_max, "water_min": water_min, "water_max": water_max})


# Name patterns of outdoor air dampers and of cooling valves.
OUTDOOR_NAME = r"(?i)(^|[^a-z])(oa|osa|outside|outdoor)([^a-z]|$)"
COOLING_NAME = r"(?i)(chw|clg|cool|dx)"


def _damper() -> Column:
    return of_family("Damper_Position_Command", "Damper_Position_Sensor") | marked("damper")


def _valve() -> Column:
    return (of_family("Valve_Position_Command", "Valve_Command", "Valve_Position_Sensor") | marked("valve")) & (tagged("cool") | tagged("chilled") | named(COOLING_NAME))


def economizer_roles() -> tuple[Role, ...]:
    family = lambda *names: Rule(lambda: of_family(*names), "class")
    outdoor = (
        family("Outside_Air_Temperature_Sensor"), Rule(lambda: of_family("Outside_Air_Temperature_Sensor"), "site", True),
        Rule(lambda: marked("outside", "air", "temp", "sensor"), "markers"), Rule(lambda: marked("outside", "air", "temp", "sensor"), "site", True),
    )
    return (
        Role("oat", outdoor, "temperature"),
        Role("damper", (Rule(lambda: _damper() & (tagged("outside") | named(OUTDOOR_NAME)), "outside air", unique=True), Rule(_damper, "only damper", unique=True))),
        Role("cooling", (family("Cooling_Command", "Cooling_Enable_Command", "Cooling_Demand_Sensor"), Rule(_valve, "cooling valve", unique=True))),
        Role("rat", (family("Return_Air_Temperature_Sensor"),), "temperature", needed=False),
    )


def economizer_items(high_limit: float, **params: float) -> tuple[Item, Item]:
    """High limit and integrated operation; temperatures in Fahrenheit."""
    oat, damper, cooling, rat = economizer_roles()
    given = {"high_limit": high_limit, "minimum": 20.0, "tolerance": 5.0, "margin": 1.0, "on": 5.0} | params
    return Item("high_limit", ("Air_Handling_Unit",), (oat, damper), given), Item("integrated", ("Air_Handling_Unit",), (oat, damper, cooling, rat), given)


def with_kinds(rows: DataFrame, family: DataFrame) -> DataFrame:
    """`rows` (class, ...) with the array `kinds` of what the class counts as; `family` is (class, ancestor)."""
    known = family.groupBy("class").agg(F.collect_set("ancestor").alias("above"))
    up = F.when(F.col("class").isNotNull(), F.array_union(F.coalesce("above", F.array().cast("array<string>")), F.array("class")))
    return rows.join(known, "class", "left").withColumn("kinds", up).drop("above")


def bind(equips: DataFrame, points: DataFrame, family: DataFrame, items: tuple[Item, ...], settings: DataFrame | None = None) -> DataFrame:
    """(equip, item, role, needed, point, how, kind): a row per role of each item that applies; point is null where nothing fills it.

    `equips` is (equip, site, class), `points` (equip, point, class, tags, dis), `settings` (equip, role, point) names
    points outright, which count where they exist.
    """
    roles = [(i, r) for i in items for r in i.roles]
    fits = F.array(*[F.when(of_family(*i.classes), F.lit(i.name)) for i in items])
    applied = with_kinds(equips, family).select("equip", "site", F.explode(F.array_compact(fits)).alias("item")).distinct()
    hit = lambda i, r, rank, rule: F.when(rule.test(), F.struct(F.lit(i.name).alias("item"), F.lit(r.name).alias("role"), F.lit(rank).alias("rank"), F.lit(rule.site).alias("wide"),
        F.lit(rule.unique).alias("unique"), F.lit(rule.how).alias("how"), F.lit(rule.kind or r.kind).alias("kind")))
    hits = F.array_compact(F.array(*[hit(i, r, rank, rule) for i, r in roles for rank, rule in enumerate(r.rules)]))
    placed = with_kinds(points, family).join(equips.select("equip", "site").distinct(), "equip")
    found = placed.select("equip", "site", "point", F.explode(hits).alias("h")).select("equip", "site", "point", "h.*")

    def best(rows: DataFrame, key: str) -> DataFrame:
        """The first rule met by each key's points, and the point."""
        folded = rows.groupBy(key, "item", "role", "rank").agg(F.min("point").alias("point"), F.countDistinct("point").alias("n"), F.first("unique").alias("unique"), F.first("how").alias("how"), F.first("kind").alias("kind"))
        pick = F.min(F.struct("rank", "point", "how", "kind"))
        return folded.where(~F.col("unique") | (F.col("n") == 1)).groupBy(key, "item", "role").agg(pick.alias("pick"))

    own = best(found.where("not wide"), "equip")
    near = applied.join(best(found.where("wide"), "site"), ["site", "item"]).select("equip", "item", "role", "pick")
    options = own.unionByName(near)
    if settings is not None:
        real = settings.join(points.select("point").distinct(), "point").select("equip", "role", "point")
        kinds = applied.sparkSession.createDataFrame([(i.name, r.name, r.kind) for i, r in roles], "item string, role string, kind string")
        given = real.join(F.broadcast(kinds), "role").select("equip", "item", "role", F.struct(F.lit(-1).alias("rank"), "point", F.lit("setting").alias("how"), "kind").alias("pick"))
        options = options.unionByName(given)
    chosen = options.groupBy("equip", "item", "role").agg(F.min("pick").alias("pick"))
    wanted = applied.sparkSession.createDataFrame([(i.name, r.name, r.needed) for i, r in roles], "item string, role string, needed boolean")
    asked = applied.select("equip", "item").join(F.broadcast(wanted), "item")
    return asked.join(chosen, ["equip", "item", "role"], "left").select("equip", "item", "role", "needed", "pick.point", "pick.how", "pick.kind")


def _values(bound: DataFrame, samples: DataFrame, fahrenheit: bool) -> DataFrame:
    """(equip, item, role, ts, value) of bound points; temperatures in one unit. Samples are (point, ts, value, text, flag, unit)."""
    rows = bound.where("point is not null").join(samples, "point")
    args = [F.col(c) for c in ("value", "text", "flag", "unit")]
    number = scalars.sequence_number(*args, "number")
    celsius = scalars.sequence_number(*args, "temperature")
    warm = F.when(F.coalesce(scalars.is_fahrenheit(F.col("unit")), F.lit(False)), number).otherwise(number * 9 / 5 + 32)
    value = F.when(F.col("kind") == "binary", scalars.sequence_number(*args, "binary")).when(F.col("kind") == "temperature", warm if fahrenheit else celsius).otherwise(number)
    return rows.select("equip", "item", "role", "ts", value.alias("value")).where("value is not null")


def _complete(steps: DataFrame, bound: DataFrame) -> DataFrame:
    """One row per equipment, item and step at which every bound role has a value, in the map `at`."""
    roles = bound.groupBy("equip", "item").agg(F.count("point").alias("n"), F.count_if(F.col("needed") & F.col("point").isNull()).alias("lacking"))
    rows = steps.groupBy("equip", "item", "ts").agg(F.map_from_entries(F.collect_list(F.struct("role", "value"))).alias("at"))
    return rows.join(roles.where("lacking = 0"), ["equip", "item"]).where(F.size("at") == F.col("n")).drop("n", "lacking")


def resampled(bound: DataFrame, samples: DataFrame, step_s: int = 300, hold: int = 3) -> DataFrame:
    """Complete steps: the last value of each step, carried up to `hold` steps, between a role's own first and last value."""
    keys = ["equip", "item", "role"]
    b = F.floor(micros(F.col("ts")) / F.lit(step_s * 1_000_000))
    last = _values(bound, samples, False).groupBy(*keys, b.alias("b")).agg(F.max_by("value", F.struct("ts", "value")).alias("value"))
    last = last.repartition("equip", "item")  # what follows is done where an item's steps are
    # A value holds until the next one or for `hold` steps more, whichever comes first; the last one doesn't.
    following = F.lead("b").over(Window.partitionBy(*keys).orderBy("b"))
    until = F.when(following.isNull(), F.col("b")).otherwise(F.least(following - 1, F.col("b") + hold))
    steps = last.withColumn("until", until).withColumn("b", F.explode(F.sequence("b", "until")))
    steps = steps.withColumn("ts", F.timestamp_micros(F.col("b") * F.lit(step_s * 1_000_000)).cast("timestamp_ntz"))
    return _complete(steps.select(*keys, "ts", "value"), bound)


def on_grid(bound: DataFrame, samples: DataFrame, start, end, step_s: int = 300, hold: int = 3) -> DataFrame:
    """Complete steps of a regular grid from `start` to `end`: the latest value, no older than `hold` steps."""
    values = _values(bound, samples, True).withColumn("key", F.struct("equip", "item", "role"))
    spans = values.select("key").distinct().withColumns({"lo": start, "hi": end})
    held = held_grid(values.select("key", "ts", "value"), spans, "key", step_s, hold)
    return _complete(held.where("value is not null").select("key.*", "ts", "value"), bound)


# Tolerances of the sequence items, in degrees Celsius and as a share.
NEAR, SHARE = 0.5, 0.01


def _reset(row: Column, item: Item) -> Column:
    """Water in place for the outdoor temperature, or no flow."""
    p, oat, water = item.params, row["oat"], row["water"]
    cold, warm = oat <= p["outdoor_min"] + NEAR, oat >= p["outdoor_max"] - NEAR
    between = (oat >= p["outdoor_min"] - NEAR) & (oat <= p["outdoor_max"] + NEAR)
    inside = (water >= p["water_min"] - NEAR) & (water <= p["water_max"] + NEAR)
    high, low = ("water_max", "water_min") if item.name == "hw_reset" else ("water_min", "water_max")
    return (row["flow"] <= 0) | (cold & (water >= p[high] - NEAR)) | (warm & (water <= p[low] + NEAR)) | (between & inside)


def step_test(item: Item) -> Column:
    """Whether a complete step (map `at`, with `low`, `high` and `states` of all steps) passes; null where it says nothing about the item."""
    at, p = F.col("at"), item.params
    if item.name == "zone_deadband":
        return at["cool"] - at["heat"] > 2.77 - NEAR
    if item.name == "sat_reset":
        return F.col("high") - F.col("low") >= (p["design"] - F.col("low")) * 0.25 * (1 - SHARE)
    if item.name in ("chw_reset", "hw_reset"):
        return _reset(at, item)
    closed = at["damper"] <= p["minimum"] + p["tolerance"]
    if item.name == "high_limit":
        return F.when(at["oat"] > p["high_limit"] + p["margin"], closed)
    useful = (at["oat"] < p["high_limit"] - p["margin"]) & (at["rat"].isNull() | (at["oat"] < at["rat"] - p["margin"]))
    return F.when(useful & (at["cooling"] > F.when(F.col("states"), 0.5).otherwise(p["on"])), ~closed)


def check_items(bound: DataFrame, steps: DataFrame, items: tuple[Item, ...], allowed: float = 0.0) -> DataFrame:
    """(equip, item, ok, bad, missing, status): any failed step fails beyond the allowed share; nothing tested or a role unfilled is inconclusive."""
    at = F.col("at")
    whole = Window.partitionBy("equip", "item")
    steps = steps.withColumns({"low": F.min(at["setpoint"]).over(whole), "high": F.max(at["setpoint"]).over(whole), "states": F.bool_and(at["cooling"].isin(0.0, 1.0)).over(whole)})
    ok = F.coalesce(*[F.when(F.col("item") == item.name, step_test(item)) for item in items])  # one pass over the steps of all items
    tested = steps.select("equip", "item", ok.alias("ok"))
    counts = tested.groupBy("equip", "item").agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("bad"))
    unfilled = F.array_sort(F.collect_list(F.when(F.col("needed") & F.col("point").isNull(), F.col("role"))))
    out = bound.groupBy("equip", "item").agg(F.array_join(unfilled, ",").alias("missing")).join(counts, ["equip", "item"], "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("ok", "bad")})
    total = F.col("ok") + F.col("bad")
    status = F.when((F.col("missing") != "") | (total == 0), "inconclusive").when(F.col("bad") > allowed * total, "fail").otherwise("pass")
    return out.select("equip", "item", "ok", "bad", "missing", status.alias("status"))
