"""Role binding by rank, scope and uniqueness, and the checks on what is bound."""

from datetime import datetime, timedelta

import pytest

from plantflow.operators import roles

T0 = datetime(2024, 1, 1)
FAMILY = [("VAV", "Terminal_Unit"), ("DOAS", "Air_Handling_Unit"), ("Odd_Flow", "Hot_Water_Flow_Sensor"), ("Dew", "Outside_Air_Temperature_Sensor")]


def tables(spark, equips, points):
    return (
        spark.createDataFrame(equips, "equip string, site string, class string"),
        spark.createDataFrame([(*p, []) if len(p) == 3 else p for p in points], "equip string, point string, class string, tags array<string>").selectExpr("*", "cast(null as string) as dis"),
        spark.createDataFrame(FAMILY, "class string, ancestor string"),
    )


def bound(frame):
    return {(r.equip, r.item, r.role): (r.point, r.how) for r in frame.collect()}


HOT = roles.water_item("hw_reset", "Boiler", "Hot", -5.0, 15.0, 40.0, 80.0)


def test_class_order_family_site_and_stand_ins(spark):
    got = bound(roles.bind(*tables(spark, [("b1", "s", "Boiler"), ("b2", "s", "Boiler"), ("b3", "far", "Boiler"), ("v", "s", "VAV"), ("x", "s", None)], [
        ("b1", "b1/t2", "Hot_Water_Supply_Temperature_Sensor"), ("b1", "b1/t1", "Hot_Water_Supply_Temperature_Sensor"), ("b1", "b1/f", "Odd_Flow"), ("b1", "b1/run", "Run_Status"), ("b1", "b1/dew", "Dew"),
        ("b2", "b2/on", "On_Off_Status"), ("b2", "b2/any", "Status"), ("b2", "b2/marks", None, ["temp", "sensor", "air", "outside", "x"]),
        ("v", "v/oat", "Outside_Air_Temperature_Sensor"), ("v", "v/cool", "Zone_Air_Cooling_Temperature_Setpoint"), ("x", "x/odd", "Odd_Flow"),
    ]), (HOT, roles.deadband_item())))
    assert got == {
        ("b1", "hw_reset", "oat"): ("b1/dew", "family"),  # its own, before the site's exact one
        ("b1", "hw_reset", "water"): ("b1/t1", "class"),
        ("b1", "hw_reset", "flow"): ("b1/f", "family"),  # a flow before a status
        ("b2", "hw_reset", "oat"): ("b2/marks", "markers"),
        ("b2", "hw_reset", "water"): (None, None),
        ("b2", "hw_reset", "flow"): ("b2/on", "proxy"),  # the class order of stand-ins
        ("b3", "hw_reset", "oat"): (None, None),  # another site
        ("b3", "hw_reset", "water"): (None, None),
        ("b3", "hw_reset", "flow"): (None, None),
        ("v", "zone_deadband", "cool"): ("v/cool", "class"),
        ("v", "zone_deadband", "heat"): (None, None),
    }


def test_economizer_roles_want_one_damper(spark):
    equips = [(e, "s", "DOAS") for e in ("one", "two", "named", "set")]
    points = [("one", "one/d", "Damper_Position_Command"), ("two", "two/d1", "Damper_Position_Sensor"), ("two", "two/d2", None, ["damper"]),
              ("named", "named/d1", "Damper_Position_Sensor"), ("named", "named/OA-dpr", None, ["damper"]), ("named", "named/chw-valve", "Valve_Command"),
              ("set", "set/d1", "Damper_Position_Sensor"), ("set", "set/d2", "Damper_Position_Sensor"), ("one", "one/c", "Cooling_Command"), ("one", "one/chw", "Valve_Command")]
    settings = spark.createDataFrame([("set", "damper", "set/d2"), ("one", "damper", "no/such")], "equip string, role string, point string")
    got = bound(roles.bind(*tables(spark, equips, points), roles.economizer_items(70.0), settings))
    assert {e: got[e, "high_limit", "damper"] for e in ("one", "two", "named", "set")} == {
        "one": ("one/d", "only damper"), "two": (None, None), "named": ("named/OA-dpr", "outside air"), "set": ("set/d2", "setting")}
    assert got["one", "integrated", "cooling"] == ("one/c", "class") and got["named", "integrated", "cooling"] == ("named/chw-valve", "cooling valve")


def sampled(spark, rows):
    full = [(p, T0 + timedelta(minutes=m), v if isinstance(v, float) else None, v if isinstance(v, str) else None, None, u) for p, m, v, u in rows]
    return spark.createDataFrame(full, "point string, ts timestamp_ntz, value double, text string, flag boolean, unit string")


def test_steps_carry_values_for_three_steps_at_most(spark):
    bind = spark.createDataFrame([("e", "i", "a", True, "pa", "", "number"), ("e", "i", "b", True, "pb", "", "number")], "equip string, item string, role string, needed boolean, point string, how string, kind string")
    rows = [("pa", 0, 1.0, None), ("pa", 4, 2.0, None), ("pa", 50, 3.0, None), ("pb", 0, 9.0, None), ("pb", 5, 8.0, None), ("pb", 10, 7.0, None), ("pb", 30, 6.0, None)]
    got = {(r.ts - T0).seconds // 60: dict(r.at) for r in roles.resampled(bind, sampled(spark, rows)).collect()}
    # a: step 0 is 2 and holds until 15; b holds 7 from 10 to 25 and ends at 30.
    assert got == {0: {"a": 2.0, "b": 9.0}, 5: {"a": 2.0, "b": 8.0}, 10: {"a": 2.0, "b": 7.0}, 15: {"a": 2.0, "b": 7.0}}


@pytest.mark.parametrize("oat,water,flow,ok", [
    (-6.0, 79.6, 1.0, True), (-6.0, 70.0, 1.0, False), (20.0, 40.4, 1.0, True), (20.0, 60.0, 1.0, False), (5.0, 60.0, 1.0, True), (5.0, 90.0, 1.0, False), (5.0, 90.0, 0.0, True)])
def test_hot_water_reset(spark, oat, water, flow, ok):
    points = [("b", "o", "Outside_Air_Temperature_Sensor"), ("b", "w", "Hot_Water_Supply_Temperature_Sensor"), ("b", "f", "Hot_Water_Flow_Sensor")]
    made = roles.bind(*tables(spark, [("b", "s", "Boiler")], points), (HOT,))
    rows = [("o", 0, oat * 9 / 5 + 32, "°F"), ("w", 0, water, "°C"), ("f", 0, flow, None)]
    got = roles.check_items(made, roles.resampled(made, sampled(spark, rows)), (HOT,)).first()
    assert (got.ok, got.bad, got.status) == (int(ok), int(not ok), "pass" if ok else "fail")


def test_status_stands_in_and_missing_roles_are_told(spark):
    points = [("b", "o", "Outside_Air_Temperature_Sensor"), ("b", "w", "Hot_Water_Supply_Temperature_Sensor"), ("b", "run", "Run_Status"), ("c", "o2", "Outside_Air_Temperature_Sensor")]
    made = roles.bind(*tables(spark, [("b", "s", "Boiler"), ("c", "t", "Boiler")], points), (HOT,))
    rows = [("o", 0, 5.0, "°C"), ("w", 0, 95.0, "°C"), ("run", 0, "stopped", None), ("o", 5, 5.0, "°C"), ("w", 5, 95.0, "°C"), ("run", 5, "Running", None)]
    got = {r.equip: tuple(r)[2:] for r in roles.check_items(made, roles.resampled(made, sampled(spark, rows)), (HOT,), 0.4).collect()}
    assert got == {"b": (1, 1, "", "fail"), "c": (0, 0, "flow,water", "inconclusive")}
    assert {r.status for r in roles.check_items(made, roles.resampled(made, sampled(spark, rows)), (HOT,), 0.5).where("equip = 'b'").collect()} == {"pass"}
