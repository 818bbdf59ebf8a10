"""Registered queries: points bound to roles, sequence items and economizer checks on what is bound."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantflow.operators import roles
from plantflow.plans.history_queries import ntz
from plantflow.registry import register
from plantflow.session import table

CLASSES = (
    "Zone_Air_Cooling_Temperature_Setpoint", "Zone_Air_Heating_Temperature_Setpoint", "Discharge_Air_Temperature_Setpoint", "Supply_Air_Temperature_Setpoint",
    "Outside_Air_Temperature_Sensor", "Chilled_Water_Supply_Temperature_Sensor", "Chilled_Water_Flow_Sensor", "Hot_Water_Supply_Temperature_Sensor",
    "On_Off_Status", "Run_Status", "Heating_Flow", None, "Leaving_Water_Temperature", None,
)
FAMILY = [("VAV", "Terminal_Unit"), ("Heating_Flow", "Hot_Water_Flow_Sensor"), ("Leaving_Water_Temperature", "Hot_Water_Supply_Temperature_Sensor")]
ITEMS = (
    roles.deadband_item(), roles.supply_item(30.0), roles.water_item("chw_reset", "Chiller", "Chilled", 5.0, 25.0, 6.0, 30.0),
    roles.water_item("hw_reset", "Boiler", "Hot", 0.0, 20.0, 10.0, 40.0),
)


def slot():
    return (F.col("l_partkey") % 14).cast("int")


def there(slots):
    """A third of all points is missing."""
    return (F.col("l_suppkey") * 7 + slots) % 3 != 0


def point(slots):
    return F.concat_ws("/", F.col("l_suppkey").cast("string"), slots.cast("string"))


def plant(spark, sf_dir):
    """(equips, points, family): suppliers as equipment of nations, points by part."""
    s, li = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    kinds = F.array(*map(F.lit, ("VAV", "Air_Handling_Unit", "Chiller", "Boiler")))
    equips = s.select(F.col("s_suppkey").alias("equip"), F.col("s_nationkey").alias("site"), F.get(kinds, (F.col("s_suppkey") % 4).cast("int")).alias("class"))
    rows = li.select("l_suppkey", slot().alias("slot")).distinct().where(there(F.col("slot")))
    tags = F.when(F.col("slot") == 11, F.array(*map(F.lit, ("sensor", "outside", "air", "temp")))).otherwise(F.array().cast("array<string>"))
    points = rows.select(F.col("l_suppkey").alias("equip"), point(F.col("slot")).alias("point"), F.get(F.array(*map(F.lit, CLASSES)), F.col("slot")).alias("class"), tags.alias("tags"), F.lit(None).cast("string").alias("dis"))
    return equips, points, spark.createDataFrame(FAMILY, "class string, ancestor string")


_NAMES = ", ".join("NULL" if c is None else f"'{c}'" for c in CLASSES)
_WATER = "".join(
    f"""('{item}', 'oat', 1, false, 'class', 'temperature', 'exact', 'Outside_Air_Temperature_Sensor'), ('{item}', 'oat', 2, false, 'family', 'temperature', 'family', 'Outside_Air_Temperature_Sensor'), ('{item}', 'oat', 3, false, 'markers', 'temperature', 'markers', ''),
    ('{item}', 'oat', 4, true, 'site', 'temperature', 'exact', 'Outside_Air_Temperature_Sensor'), ('{item}', 'oat', 5, true, 'site', 'temperature', 'family', 'Outside_Air_Temperature_Sensor'), ('{item}', 'oat', 6, true, 'site', 'temperature', 'markers', ''),
    ('{item}', 'water', 1, false, 'class', 'temperature', 'exact', '{water}_Water_Supply_Temperature_Sensor'), ('{item}', 'water', 2, false, 'family', 'temperature', 'family', '{water}_Water_Supply_Temperature_Sensor'),
    ('{item}', 'flow', 1, false, 'class', 'number', 'exact', '{water}_Water_Flow_Sensor'), ('{item}', 'flow', 2, false, 'family', 'number', 'family', '{water}_Water_Flow_Sensor'),
    ('{item}', 'flow', 3, false, 'proxy', 'binary', 'exact', 'Run_Status'), ('{item}', 'flow', 4, false, 'proxy', 'binary', 'exact', 'On_Off_Status'),"""
    for item, water in (("chw_reset", "Chilled"), ("hw_reset", "Hot"))
)
BOUND = f"""fam(class, ancestor) AS (VALUES ('VAV', 'Terminal_Unit'), ('Heating_Flow', 'Hot_Water_Flow_Sensor'), ('Leaving_Water_Temperature', 'Hot_Water_Supply_Temperature_Sensor')),
    eq AS (SELECT s_suppkey AS equip, s_nationkey AS site, ['VAV', 'Air_Handling_Unit', 'Chiller', 'Boiler'][s_suppkey % 4 + 1] AS class FROM supplier),
    pt AS (SELECT DISTINCT l_suppkey AS equip, l_partkey % 14 AS slot FROM lineitem WHERE (l_suppkey * 7 + l_partkey % 14) % 3 <> 0),
    p AS (SELECT pt.equip, site, pt.equip || '/' || slot AS point, [{_NAMES}][slot + 1] AS class, slot FROM pt JOIN eq USING (equip)),
    pk AS (SELECT point, class AS kind_of FROM p UNION SELECT point, ancestor FROM p JOIN fam USING (class)),
    it(item, cls) AS (VALUES ('zone_deadband', 'Terminal_Unit'), ('sat_reset', 'Air_Handling_Unit'), ('chw_reset', 'Chiller'), ('hw_reset', 'Boiler')),
    ap AS (SELECT equip, site, item FROM (SELECT equip, site, class AS cls FROM eq UNION SELECT equip, site, ancestor FROM eq JOIN fam USING (class)) JOIN it USING (cls)),
    ru(item, role, rank, wide, how, kind, mode, cls) AS (VALUES {_WATER}
    ('zone_deadband', 'cool', 1, false, 'class', 'temperature', 'exact', 'Zone_Air_Cooling_Temperature_Setpoint'), ('zone_deadband', 'heat', 1, false, 'class', 'temperature', 'exact', 'Zone_Air_Heating_Temperature_Setpoint'),
    ('sat_reset', 'setpoint', 1, false, 'class', 'temperature', 'exact', 'Supply_Air_Temperature_Setpoint'), ('sat_reset', 'setpoint', 2, false, 'class', 'temperature', 'exact', 'Discharge_Air_Temperature_Setpoint')),
    hit AS (SELECT p.equip, p.site, p.point, ru.* FROM p JOIN ru ON ru.mode = 'exact' AND p.class = ru.cls UNION ALL SELECT p.equip, p.site, p.point, ru.* FROM p JOIN pk USING (point) JOIN ru ON ru.mode = 'family' AND pk.kind_of = ru.cls
      UNION ALL SELECT p.equip, p.site, p.point, ru.* FROM p JOIN ru ON ru.mode = 'markers' AND p.slot = 11),
    o AS (SELECT ap.equip, ap.item, role, rank, how, kind, min(point) AS point FROM ap JOIN hit ON hit.item = ap.item AND ((NOT wide AND hit.equip = ap.equip) OR (wide AND hit.site = ap.site)) GROUP BY ALL),
    b AS (SELECT equip, item, role, arg_min(point, rank) AS point, arg_min(how, rank) AS how, arg_min(kind, rank) AS kind FROM o GROUP BY 1, 2, 3),
    bound AS (SELECT ap.equip, ap.item, r.role, b.point, b.how, b.kind FROM ap JOIN (SELECT DISTINCT item, role FROM ru) r ON r.item = ap.item LEFT JOIN b ON b.equip = ap.equip AND b.item = ap.item AND b.role = r.role)"""


@register("role_binding", f"WITH {BOUND} SELECT * FROM bound")
def role_binding(spark, sf_dir):
    """Points of every role of every item that applies: class order, then families, markers, the site, stand-ins."""
    return roles.bind(*plant(spark, sf_dir), ITEMS).drop("needed")


def _reset_sql(item, low, high, outdoor_min, outdoor_max, water_min, water_max):
    return f"""WHEN '{item}' THEN flow <= 0 OR (oat <= {outdoor_min} + 0.5::DOUBLE AND water >= {high} - 0.5::DOUBLE) OR (oat >= {outdoor_max} - 0.5::DOUBLE AND water <= {low} + 0.5::DOUBLE)
      OR (oat BETWEEN {outdoor_min} - 0.5::DOUBLE AND {outdoor_max} + 0.5::DOUBLE AND water BETWEEN {water_min} - 0.5::DOUBLE AND {water_max} + 0.5::DOUBLE)"""


@register(
    "sequence_items",
    f"""WITH {BOUND}, s AS (SELECT l_suppkey || '/' || (l_partkey % 14) AS point, CAST(l_shipdate AS DATE) AS d, CASE WHEN l_partkey % 14 IN (8, 9) THEN CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END
      WHEN l_suppkey % 2 = 0 AND l_partkey % 14 NOT IN (6, 10) THEN (l_quantity - 32) * 5 / 9 ELSE l_quantity END::DOUBLE AS v FROM lineitem),
    l AS (SELECT equip, item, role, d, max(v) AS v FROM bound JOIN s USING (point) GROUP BY 1, 2, 3, 4), n AS (SELECT *, lead(d) OVER (PARTITION BY equip, item, role ORDER BY d) AS nxt FROM l),
    f AS (SELECT equip, item, role, unnest(range(d::TIMESTAMP, CASE WHEN nxt IS NULL THEN d + 1 ELSE least(nxt, d + 4) END::TIMESTAMP, INTERVAL 1 DAY)) AS d, v FROM n),
    c AS (SELECT equip, item, count(point) AS n, count(*) AS roles, coalesce(string_agg(role, ',' ORDER BY role) FILTER (point IS NULL), '') AS missing FROM bound GROUP BY 1, 2),
    w AS (SELECT f.equip, f.item, d, max(v) FILTER (role = 'cool') AS cool, max(v) FILTER (role = 'heat') AS heat, max(v) FILTER (role = 'setpoint') AS setpoint, max(v) FILTER (role = 'oat') AS oat, max(v) FILTER (role = 'water') AS water, max(v) FILTER (role = 'flow') AS flow
      FROM f JOIN c ON c.equip = f.equip AND c.item = f.item AND c.n = c.roles GROUP BY 1, 2, 3, c.n HAVING count(*) = c.n),
    k AS (SELECT equip, item, CASE item WHEN 'zone_deadband' THEN cool - heat > 2.77::DOUBLE - 0.5 WHEN 'sat_reset' THEN max(setpoint) OVER e - min(setpoint) OVER e >= (30 - min(setpoint) OVER e) * 0.25::DOUBLE * 0.99::DOUBLE
      {_reset_sql("chw_reset", 30, 6, 5, 25, 6, 30)} {_reset_sql("hw_reset", 10, 40, 0, 20, 10, 40)} END AS ok FROM w WINDOW e AS (PARTITION BY equip, item)),
    t AS (SELECT equip, item, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS bad FROM k GROUP BY 1, 2)
    SELECT equip, item, coalesce(ok, 0) AS ok, coalesce(bad, 0) AS bad, missing, CASE WHEN missing <> '' OR coalesce(ok, 0) + coalesce(bad, 0) = 0 THEN 'inconclusive' WHEN bad > 0.3::DOUBLE * (ok + bad) THEN 'fail' ELSE 'pass' END AS status FROM c LEFT JOIN t USING (equip, item)""",
)
def sequence_items(spark, sf_dir):
    """Dead band, supply reset and both water resets on the daily grid of what is bound; up to 30 % of steps may fail."""
    li = table(spark, sf_dir, "lineitem")
    state = F.when(slot().isin(8, 9), F.when(F.col("l_quantity") > 25, "Running").otherwise("off"))
    samples = li.select(
        point(slot()).alias("point"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), F.when(state.isNull(), F.col("l_quantity")).alias("value"),
        state.alias("text"), F.lit(None).cast("boolean").alias("flag"), F.when(F.col("l_suppkey") % 2 == 0, "°F").alias("unit"),
    )
    bound = roles.bind(*plant(spark, sf_dir), ITEMS)
    return roles.check_items(bound, roles.resampled(bound, samples, 86_400), ITEMS, 0.3)


@register(
    "economizer_items",
    """WITH s AS (SELECT l_suppkey AS equip, l_partkey % 4 AS role, l_shipdate AS ts, l_quantity AS q FROM lineitem),
    g AS (SELECT equip, CAST(unnest(range(TIMESTAMP '1994-01-01', TIMESTAMP '1995-01-02', INTERVAL 1 DAY)) AS TIMESTAMP) AS d FROM (SELECT DISTINCT equip FROM s)),
    l AS (SELECT equip, role, ts, max(CASE role WHEN 0 THEN CASE WHEN equip % 3 = 0 THEN q * 9 / 5 + 32 ELSE q END WHEN 3 THEN CASE WHEN equip % 3 = 0 THEN q * 9 / 5 + 32 ELSE q END WHEN 2 THEN q - 25 ELSE q END) AS v FROM s GROUP BY 1, 2, 3),
    a AS (SELECT g.equip, g.d, r.role, arg_max(l.v, l.ts) AS v FROM g JOIN (SELECT unnest([0, 1, 2, 3]) AS role) r ON true JOIN l ON l.equip = g.equip AND l.role = r.role AND l.ts <= g.d AND l.ts >= g.d - INTERVAL 3 DAY GROUP BY 1, 2, 3),
    w AS (SELECT equip, d, max(v) FILTER (role = 0) AS oat, max(v) FILTER (role = 1) AS damper, max(v) FILTER (role = 2) AS cooling, max(v) FILTER (role = 3) AS rat, count(*) AS n FROM a GROUP BY 1, 2),
    h AS (SELECT equip, 'high_limit' AS item, CASE WHEN oat > 31 THEN damper <= 25 END AS ok FROM w WHERE oat IS NOT NULL AND damper IS NOT NULL
    UNION ALL SELECT equip, 'integrated', CASE WHEN cooling > 5 AND oat < 29 AND oat < rat - 1 THEN NOT damper <= 25 END FROM w WHERE n = 4),
    c AS (SELECT equip, item, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS bad FROM h GROUP BY 1, 2)
    SELECT s_suppkey AS equip, item, coalesce(ok, 0) AS ok, coalesce(bad, 0) AS bad, '' AS missing, CASE WHEN coalesce(ok, 0) + coalesce(bad, 0) = 0 THEN 'inconclusive' WHEN bad > 0 THEN 'fail' ELSE 'pass' END AS status
    FROM supplier JOIN (SELECT unnest(['high_limit', 'integrated']) AS item) ON true LEFT JOIN c ON c.equip = s_suppkey AND c.item = i.item""".replace("AS item) ON true LEFT", "AS item) i ON true LEFT").replace("AS equip, item, coalesce(ok, 0) AS ok, coalesce(bad, 0) AS bad, ''", "AS equip, i.item, coalesce(ok, 0) AS ok, coalesce(bad, 0) AS bad, ''"),
)
def economizer_items(spark, sf_dir):
    """Economizer checks on roles bound by class, marker and name, on a daily grid of one year."""
    s, li = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    equips = s.select(F.col("s_suppkey").alias("equip"), F.col("s_nationkey").alias("site"), F.lit("Air_Handling_Unit").alias("class"))
    role = (F.col("l_partkey") % 4).cast("int")
    key = F.concat_ws("/", F.col("l_suppkey").cast("string"), F.get(F.array(*map(F.lit, ("oat", "OA-damper", "valve", "rat"))), role))
    classes = F.array(*map(F.lit, ("Outside_Air_Temperature_Sensor", "Damper_Position_Command", None, "Return_Air_Temperature_Sensor")))
    tags = F.when(role == 2, F.array(F.lit("valve"), F.lit("cool"))).otherwise(F.array().cast("array<string>"))
    points = li.select(F.col("l_suppkey").alias("equip"), key.alias("point"), F.get(classes, role).alias("class"), tags.alias("tags"), F.lit(None).cast("string").alias("dis")).distinct()
    family = spark.createDataFrame([], "class string, ancestor string")
    items = roles.economizer_items(30.0)
    bound = roles.bind(equips, points, family, items)
    none = F.lit(None)
    # Two thirds report in Fahrenheit, the others in Celsius.
    samples = li.select(
        key.alias("point"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), F.when(role == 2, F.col("l_quantity") - 25).otherwise(F.col("l_quantity")).alias("value"),
        none.cast("string").alias("text"), none.cast("boolean").alias("flag"), F.when(F.col("l_suppkey") % 3 != 0, "degF").otherwise("°C").alias("unit"),
    )
    steps = roles.on_grid(bound, samples, ntz("1994-01-01"), ntz("1995-01-01"), 86_400)
    return roles.check_items(bound, steps, items)
