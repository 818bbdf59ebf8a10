"""Registered queries: classes and structure in filters, names, searches, verification by class, chained derivations."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantflow.functions import mapping, scalars
from plantflow.operators import derive, graph, lifecycle, rollup, verify, windows
from plantflow.operators.graph import Tag
from plantflow.plans.history_queries import H, ntz, r6
from plantflow.registry import register
from plantflow.session import table
from plantflow.sources.adapter import containment, history
from plantflow.streaming import faults


def urn(kind: str, key: str):
    return F.concat(F.lit(f"urn:{kind}:"), F.col(key).cast("string"))


def triple(rows, s, p: str, kind: str, o=None, num=None, unit=None):
    none = F.lit(None)
    cells = [s.alias("s"), F.lit(p).alias("p"), F.lit(kind).alias("o_kind"), (none.cast("string") if o is None else o).alias("o")]
    return rows.select(*cells, (none.cast("double") if num is None else num).alias("num"), (none.cast("string") if unit is None else unit).alias("unit"))


def classes(spark, sf_dir):
    """Nations as classes below their regions, each nation with an alias that is equivalent."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    below = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"), F.lit("subclass").alias("kind"))
    alias = n.select(F.concat(F.lit("Alias_"), F.col("n_nationkey").cast("string")).alias("child"), F.col("n_name").alias("parent"), F.lit("alias").alias("kind"))
    return below.unionByName(alias)


def customers(spark, sf_dir):
    """Customers typed by their nation, every second one by its alias, with their segment as text."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"])
    kind = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Alias_"), F.col("n_nationkey").cast("string"))).otherwise(F.col("n_name"))
    s = urn("customer", "c_custkey")
    return triple(rows, s, "a", "ref", kind).unionByName(triple(rows, s, "segment", "str", F.col("c_mktsegment")))


@register("class_filter", "SELECT 'urn:customer:' || c_custkey AS s FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' AND c_mktsegment <> 'BUILDING'")
def class_filter(spark, sf_dir):
    """aSiA and not segment == "BUILDING": classes below and aliases count, whatever the case."""
    triples = graph.classified(customers(spark, sf_dir), graph.class_family(classes(spark, sf_dir)))
    return (Tag.of_class("aSiA") & ~Tag.text("segment", "BUILDING")).match(triples)


@register("class_roster", "SELECT 'urn:customer:' || c_custkey AS s FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey = 3")
def class_roster(spark, sf_dir):
    """A rule's roster by the alias of a class: members typed by the class itself count too."""
    return graph.roster(customers(spark, sf_dir), graph.class_family(classes(spark, sf_dir)), "alias_3")


@register("class_family", """WITH RECURSIVE e AS (SELECT lower(n_name) AS a, lower(r_name) AS b FROM nation JOIN region ON r_regionkey = n_regionkey UNION SELECT 'alias_' || n_nationkey, lower(n_name) FROM nation UNION SELECT lower(n_name), 'alias_' || n_nationkey FROM nation),
    c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b) SELECT a AS class, b AS ancestor FROM c UNION SELECT lower(r_name), lower(r_name) FROM region UNION SELECT lower(n_name), lower(n_name) FROM nation UNION SELECT 'alias_' || n_nationkey, 'alias_' || n_nationkey FROM nation""")
def class_family(spark, sf_dir):
    """Classes with all that they count as; equivalences run both ways, so the graph has cycles."""
    return graph.class_family(classes(spark, sf_dir))


@register("preferred_names", "SELECT 'urn:customer:' || c_custkey AS s, n_name AS preferred FROM customer JOIN nation ON n_nationkey = c_nationkey")
def preferred_names(spark, sf_dir):
    typed = customers(spark, sf_dir).where("p = 'a'").select("s", F.col("o").alias("name"))
    aliases = classes(spark, sf_dir).where("kind = 'alias'").select(F.col("child").alias("alias"), F.col("parent").alias("class"))
    return typed.join(graph.preferred(typed.select("name").distinct(), aliases), "name").select("s", "preferred")


@register("structural_filter", "SELECT 'urn:customer:' || c_custkey AS s FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 'urn:nation:' || n_nationkey FROM nation WHERE n_regionkey = 2 AND n_nationkey IN (SELECT c_nationkey FROM customer)")
def structural_filter(spark, sf_dir):
    """(point and equipRef == @urn:nation:7) or (equip and siteRef == @urn:region:2), from edges alone."""
    e = containment(spark, sf_dir).where(~F.col("child").startswith("urn:supplier:"))
    edge = F.when(F.col("child").startswith("urn:nation:"), "hasEquip").otherwise("hasPoint")
    links = e.select(F.col("parent").alias("a"), edge.alias("edge"), F.col("child").alias("b"))
    owners = links.where("edge = 'hasPoint'").select(F.col("a").alias("s"))
    found = ((Tag.has("point") & Tag.ref("equipRef", "urn:nation:7")) | (Tag.has("equip") & Tag.ref("siteRef", "urn:region:2"))).match(graph.structural(links))
    return found.where(F.col("s").startswith("urn:customer:")).unionByName(found.join(owners, "s", "left_semi"))


def part_markers(spark, sf_dir):
    """Parts with the words of their names as markers, a boolean and a uri."""
    p, s = table(spark, sf_dir, "part"), urn("part", "p_partkey")
    words = p.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    none = F.lit(None)
    marks = words.select(s.alias("s"), F.col("word").alias("p"), F.lit("marker").alias("o_kind"), none.cast("string").alias("o"), none.cast("double").alias("num"), none.cast("string").alias("unit"))
    odd = triple(p, s, "odd", "bool", (F.col("p_size") % 2 == 1).cast("string"))
    text = triple(p.where("p_size % 3 = 0"), s, "odd", "str", F.lit("true"))
    return marks.unionByName(odd).unionByName(text).unionByName(triple(p, s, "home", "uri", F.concat(F.lit("http://"), F.lower("p_brand"))))


@register("spec_filter", "SELECT 'urn:part:' || p_partkey AS s FROM part WHERE (list_contains(string_split(p_name, ' '), 'small') AND list_contains(string_split(p_name, ' '), 'ring')) OR (list_contains(string_split(p_name, ' '), 'red') AND list_contains(string_split(p_name, ' '), 'widget'))")
def spec_filter(spark, sf_dir):
    """^small-ring or lib::RedWidget: a symbol is the conjunction of its parts, a spec that of its required markers."""
    return (Tag.symbol("^small-ring") | Tag.every(["red", "widget"])).match(part_markers(spark, sf_dir))


@register("typed_filter", "SELECT 'urn:part:' || p_partkey AS s FROM part WHERE p_size % 2 = 1 AND lower(p_brand) = 'brand#1'")
def typed_filter(spark, sf_dir):
    """odd == true and home == `http://brand#1`: text that reads like a boolean or an address never matches."""
    return (Tag.flag("odd", True) & Tag.uri("home", "http://brand#1")).match(part_markers(spark, sf_dir))


@register("records_only", "SELECT 'urn:part:' || p_partkey AS s FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0")
def records_only(spark, sf_dir):
    """Neither nested dictionaries nor nodes of the vocabulary are records."""
    p = table(spark, sf_dir, "part")
    s = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("urn:dict:"), F.col("p_partkey").cast("string"))).otherwise(urn("part", "p_partkey"))
    return graph.records_only(p.select(s.alias("s")), p.where("p_partkey % 7 = 0").select(urn("part", "p_partkey").alias("s")))


@register("near_misses", "SELECT n_name AS name, round(1 - levenshtein('nation_1', lower(n_name)) / greatest(8, length(n_name)), 6) AS alike FROM nation WHERE 1 - levenshtein('nation_1', lower(n_name)) / greatest(8, length(n_name)) >= 0.75 ORDER BY alike DESC, name LIMIT 3")
def near_misses(spark, sf_dir):
    """What a filter that matched nothing may have meant."""
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    return graph.near_misses("Nation_1", names).select("name", r6("alike"))


@register("read_first", f"WITH {H} SELECT point_uri FROM h WHERE unit = '°F' ORDER BY point_uri LIMIT 1")
def read_first(spark, sf_dir):
    """A singular read: the first match in the order of the ids."""
    return history(spark, sf_dir).where("unit = '°F'").select("point_uri").distinct().orderBy("point_uri").limit(1)


@register("raw_budget", f"WITH {H}, r AS (SELECT point_uri, ts FROM h WHERE ts >= '2024-01-05'), n AS (SELECT count(DISTINCT point_uri) AS n FROM r) SELECT point_uri, ts FROM r QUALIFY row_number() OVER (PARTITION BY point_uri ORDER BY ts) <= least(1000, greatest(2, 1500 // (SELECT n FROM n)))")
def raw_budget(spark, sf_dir):
    """Raw samples of many points share the budget of the read."""
    rows = history(spark, sf_dir).where(F.col("ts") >= ntz("2024-01-05")).select("point_uri", "ts")
    return rollup.raw_budget(rows, rows.select("point_uri").distinct().count(), 1000, 1500, least=2)


@register(
    "carry_in",
    f"""WITH {H}, s AS (SELECT point_uri, max(ts) AS start FROM h WHERE ts < '2024-01-20' GROUP BY 1), r AS (SELECT h.*, start FROM h JOIN s USING (point_uri))
    SELECT point_uri, ts, false AS carried FROM r WHERE ts >= start UNION ALL SELECT point_uri, ts, true FROM (SELECT * FROM r WHERE ts < start AND ts >= start - INTERVAL 5 DAY AND (quality IS NULL OR quality = 'ok')
    QUALIFY row_number() OVER (PARTITION BY point_uri ORDER BY ts DESC) <= 10)""",
)
def carry_in(spark, sf_dir):
    """What an incremental judge reads: new samples with up to ten good ones before them."""
    h = history(spark, sf_dir)
    starts = h.where(F.col("ts") < ntz("2024-01-20")).groupBy("point_uri").agg(F.max("ts").alias("start"))
    return windows.carry_in(h, starts, 10, 5 * 86400).select("point_uri", "ts", "carried")


@register("path_segments", "SELECT item_id, url_encode(substr(text, 1, 60)) AS segment FROM benchmark")
def path_segments(spark, sf_dir):
    """File names of points: percent-encoded as one segment."""
    return table(spark, sf_dir, "benchmark").select("item_id", scalars.path_segment(F.substring("text", 1, 60)).alias("segment"))


@register(
    "sequence_numbers",
    """WITH t AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN ' Run ' WHEN 1 THEN 'STOPPED' WHEN 2 THEN 'yes' WHEN 3 THEN '12.5' WHEN 4 THEN 'n/a' WHEN 5 THEN '0' END AS txt, value, event_id % 2 = 0 AS warm FROM events),
    n AS (SELECT *, coalesce(CASE WHEN txt IS NULL THEN value END, TRY_CAST(txt AS DOUBLE)) AS v FROM t)
    SELECT event_id, round(v, 6) AS number, round(CASE WHEN warm THEN (v - 32) * 5 / 9 ELSE v END, 6) AS temperature,
    CASE WHEN lower(trim(txt)) IN ('run', 'yes') THEN 1 WHEN lower(trim(txt)) = 'stopped' THEN 0 WHEN v <> 0 THEN 1 WHEN v = 0 THEN 0 END::DOUBLE AS state FROM n""",
)
def sequence_numbers(spark, sf_dir):
    words = F.get(F.array(*map(F.lit, (" Run ", "STOPPED", "yes", "12.5", "n/a", "0"))), (F.col("event_id") % 7).cast("int"))
    e = table(spark, sf_dir, "events").withColumn("txt", words)
    given = F.when(F.col("txt").isNull(), F.col("value")), F.col("txt"), F.lit(None).cast("boolean"), F.when(F.col("event_id") % 2 == 0, "deg F")
    read = lambda kind: scalars.sequence_number(*given, kind)
    return e.select("event_id", F.round(read("number"), 6).alias("number"), F.round(read("temperature"), 6).alias("temperature"), read("binary").alias("state"))


@register("fahrenheit_units", "SELECT p_partkey, p_partkey % 9 IN (0, 1, 2, 3, 4) AS fahrenheit FROM part")
def fahrenheit_units(spark, sf_dir):
    spelled = F.array(*map(F.lit, ("°F", "Deg F", "degrees fahrenheit", "℉", " f ", "deg_f", "degrees-fahrenheit", "K", "°C")))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.is_fahrenheit(F.get(spelled, (F.col("p_partkey") % 9).cast("int"))).alias("fahrenheit"))


@register(
    "word_search",
    r"""SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '\bthe\b')) + len(regexp_extract_all(lower(text), '\bof\b')) AS BIGINT) AS score FROM documents
    WHERE regexp_matches(lower(text), '\bthe\b') AND regexp_matches(lower(text), '\bof\b') AND NOT regexp_matches(lower(text), '\bis\s+to\b') AND NOT regexp_matches(lower(text), '\bwas\b') ORDER BY score DESC, doc_id LIMIT 100""",
)
def word_search(spark, sf_dir):
    """Whole words, quoted phrases and exclusions of a search line, ranked by occurrences."""
    return mapping.word_search(table(spark, sf_dir, "documents"), ["doc_id"], "text", 'the of -"is to" -was', 100)


@register("template_names", "SELECT c_custkey, regexp_extract(regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g'), '^([a-z]+)([0-9]+)$', 1) AS kind, regexp_extract(regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g'), '^([a-z]+)([0-9]+)$', 2) AS number, true AS follows FROM customer")
def template_names(spark, sf_dir):
    """Groups of a naming template over names normalised to letters and digits."""
    return mapping.by_template(table(spark, sf_dir, "customer"), "c_name", "{kind}#{number:d}").select("c_custkey", "kind", "number", "follows")


@register("template_preview", "SELECT split_part(p_name, ' ', 1) = 'small' AS follows, count(*) AS n, min(p_name) AS example FROM part GROUP BY 1")
def template_preview(spark, sf_dir):
    """How many names a template would take, with an example."""
    named = mapping.by_template(table(spark, sf_dir, "part"), "p_name", "small {kind}")
    return named.groupBy("follows").agg(F.count("*").alias("n"), F.min("p_name").alias("example"))


@register(
    "family_completeness",
    """WITH t AS (SELECT 'supplier' AS type, lower(r_name) AS want FROM region), h AS (SELECT DISTINCT l_suppkey AS equip, n_regionkey AS r FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
    g AS (SELECT DISTINCT l_suppkey AS equip FROM lineitem) SELECT equip, 6 AS needed, (SELECT count(*) FROM h WHERE h.equip = g.equip) + CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = equip AND l_returnflag = 'R' AND l_linestatus = 'F') THEN 1 ELSE 0 END AS met FROM g""",
)
def family_completeness(spark, sf_dir):
    """Suppliers must serve every region (by the class of their customers) and have a line with both markers."""
    li, o, c, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    points = rows.select(F.col("l_suppkey").alias("equip"), F.col("n_name").alias("class"), F.array("l_returnflag", "l_linestatus").alias("markers")).distinct()
    none = F.array().cast("array<string>")
    region = table(spark, sf_dir, "region").select(F.lit("supplier").alias("type"), F.col("r_name").alias("class"), none.alias("markers"))
    marked = table(spark, sf_dir, "region").limit(1).select(F.lit("supplier").alias("type"), F.lit("no such class").alias("class"), F.array(F.lit("R"), F.lit("F")).alias("markers"))
    equips = li.select(F.col("l_suppkey").alias("equip"), F.lit("supplier").alias("type")).distinct()
    return verify.completeness_by_family(equips, points, region.unionByName(marked), graph.class_family(classes(spark, sf_dir))).select("equip", F.col("needed").cast("int").alias("needed"), "met")


@register(
    "responsiveness",
    """WITH b AS (SELECT user_id AS equip, epoch_us(ts) // 86400000000 AS d, avg(value) FILTER (event_type = 'view') AS a, avg(value) FILTER (event_type = 'click') AS m FROM events GROUP BY 1, 2),
    p AS (SELECT * FROM (SELECT equip, a, m, unnest(['air_flow', 'fan_cmd_status', 'zone_air_temperature']) AS pair FROM b WHERE a IS NOT NULL AND m IS NOT NULL) WHERE pair <> 'air_flow' OR m > 0),
    u AS (SELECT DISTINCT user_id AS equip, unnest(['air_flow', 'fan_cmd_status', 'zone_air_temperature']) AS pair FROM events),
    s AS (SELECT equip, pair, count(a) AS n, avg(CASE pair WHEN 'fan_cmd_status' THEN CAST((a > 0.5) = (m > 0.5) AS INTEGER) WHEN 'air_flow' THEN abs(a - m) / m ELSE abs(a - m) END) AS score FROM u LEFT JOIN p USING (equip, pair) WHERE pair <> 'air_flow' OR equip % 2 = 1 OR TRUE GROUP BY 1, 2)
    SELECT equip, pair, CASE WHEN pair = 'air_flow' AND equip % 2 = 0 THEN 0 ELSE n END AS n, CASE WHEN (pair = 'air_flow' AND equip % 2 = 0) OR n < 3 THEN 'inconclusive' WHEN pair = 'fan_cmd_status' THEN CASE WHEN score >= 0.9 THEN 'pass' ELSE 'fail' END WHEN pair = 'air_flow' THEN CASE WHEN score <= 0.2 THEN 'pass' ELSE 'fail' END WHEN score <= 3 THEN 'pass' ELSE 'fail' END AS status FROM s""",
)
def responsiveness(spark, sf_dir):
    """Pairs of points bound by class, subclasses included; every second user has two air flow sensors, which is ambiguous."""
    e = table(spark, sf_dir, "events")
    users = e.select(F.col("user_id").alias("equip")).distinct()
    listed = [("view", "Zone_Air_Temperature_Sensor", False), ("click", "Room_Setpoint", False), ("view", "Fan_Command", False), ("click", "Fan_Status", False), ("view", "Flow_A", False), ("click", "Air_Flow_Setpoint", False), ("purchase", "Flow_B", True)]
    kinds = spark.createDataFrame(listed, "role string, class string, even boolean")
    bound_to = users.join(F.broadcast(kinds)).where(~F.col("even") | (F.col("equip") % 2 == 0))  # seven rows
    points = bound_to.select("equip", F.concat_ws("/", F.col("equip").cast("string"), "role", "class").alias("point_uri"), "class")
    family = spark.createDataFrame([("room_setpoint", "zone_air_temperature_setpoint"), ("flow_a", "air_flow_sensor"), ("flow_b", "air_flow_sensor")], "class string, ancestor string")
    bound = verify.bind_pairs(points, family, verify.pair_definitions(spark))
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86400000000)).alias("d")
    daily = e.groupBy(F.col("user_id").alias("equip"), "event_type", day).agg(F.avg("value").alias("v"))
    side = lambda name: F.split(name, "/")[1]
    chosen = bound.where("a is not null and b is not null").select("equip", "pair", side("a").alias("ra"), side("b").alias("rb"))
    a, b = (daily.select("equip", F.col("event_type").alias(r), "d", F.col("v").alias(v)) for r, v in (("ra", "value"), ("rb", "match")))
    paired = chosen.join(a, ["equip", "ra"]).join(b, ["equip", "rb", "d"]).select("equip", "pair", "value", "match")
    return verify.judge_pairs(bound, paired).select("equip", "pair", "n", "status")


@register(
    "room_readiness",
    """WITH f AS (SELECT l_suppkey AS room, CASE l_returnflag WHEN 'A' THEN 'requirements' WHEN 'N' THEN 'tests' ELSE 'balancing' END AS part, CASE WHEN l_quantity > 49 AND l_discount > 0.09 THEN 'fail' WHEN l_linenumber > 6 AND l_returnflag = 'R' AND l_suppkey % 3 = 0 THEN 'inconclusive' ELSE 'pass' END AS status FROM lineitem),
    p AS (SELECT room, part, CASE WHEN count(*) FILTER (status = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (status = 'inconclusive') > 0 THEN 'inconclusive' ELSE 'pass' END AS status FROM f GROUP BY 1, 2),
    w AS (SELECT s_suppkey AS room, count(*) FILTER (p.status = 'fail') AS bad, count(*) FILTER (p.status = 'pass') AS ok FROM supplier LEFT JOIN p ON room = s_suppkey GROUP BY 1), i AS (SELECT s_suppkey AS room, CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END AS n_open FROM supplier)
    SELECT room, CASE WHEN bad > 0 OR n_open > 0 THEN 'fail' WHEN ok = 3 THEN 'pass' ELSE 'inconclusive' END AS status, CASE WHEN bad > 0 OR n_open > 0 THEN 'not_ready' WHEN ok = 3 THEN 'ready' ELSE 'incomplete' END AS verdict, CAST(n_open AS BIGINT) AS n_open FROM w JOIN i USING (room)""",
)
def room_readiness(spark, sf_dir):
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    part = F.when(F.col("l_returnflag") == "A", "requirements").when(F.col("l_returnflag") == "N", "tests").otherwise("balancing")
    status = F.when((F.col("l_quantity") > 49) & (F.col("l_discount") > 0.09), "fail").when((F.col("l_linenumber") > 6) & (F.col("l_returnflag") == "R") & (F.col("l_suppkey") % 3 == 0), "inconclusive").otherwise("pass")
    findings = li.select(F.col("l_suppkey").alias("room"), part.alias("part"), status.alias("status"))
    return verify.readiness(s.select(F.col("s_suppkey").alias("room")), findings, s.where("s_acctbal < 0").select(F.col("s_suppkey").alias("room")))


@register(
    "applicable_requirements",
    """WITH r AS (SELECT p_partkey AS row, p_type, p_size FROM part WHERE p_size % 4 <> 0 AND p_size % 5 <> 0 AND (p_size % 2 = 0 OR p_size % 3 = 0)),
    s AS (SELECT s_suppkey AS subject, s_suppkey % 25 AS st, n_name, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
    SELECT DISTINCT subject, row FROM s JOIN r ON (p_size = st) OR (p_size > 45 AND r_name = 'EUROPE')""",
)
def applicable_requirements(spark, sf_dir):
    """Confirmed rows without blanks, by space type or by class with those under it, in one phase."""
    p = table(spark, sf_dir, "part")
    phases = F.when(F.col("p_size") % 2 == 0, F.array().cast("array<string>")).when(F.col("p_size") % 3 == 0, F.array(F.lit("startup"))).otherwise(F.array(F.lit("handover")))
    rows = p.select(
        F.col("p_partkey").alias("row"), F.when(F.col("p_size") % 4 != 0, "x").alias("verified_by"), (F.col("p_size") % 5 == 0).cast("int").alias("blanks"), phases.alias("phases"),
        F.array(F.col("p_size").cast("string")).alias("space_types"), F.when(F.col("p_size") > 45, F.array(F.lit("Europe"))).otherwise(F.array().cast("array<string>")).alias("classes"),
    )
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    subjects = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("subject"), (F.col("s_suppkey") % 25).cast("string").alias("space_type"), F.col("n_name").alias("class"))
    return verify.applicable(rows, subjects, graph.class_family(classes(spark, sf_dir)), "startup")


@register(
    "run_summary",
    """SELECT l_suppkey AS equip, count(*) AS checks, count(*) FILTER (st = 'pass') AS pass, count(*) FILTER (st = 'fail') AS fail, count(*) FILTER (st = 'inconclusive') AS inconclusive, max(rung) FILTER (st = 'pass') AS highest,
    CASE WHEN count(*) FILTER (st = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (st = 'inconclusive') > 0 THEN 'inconclusive' ELSE 'pass' END AS worst
    FROM (SELECT l_suppkey, l_linenumber % 3 + 1 AS rung, CASE WHEN l_quantity > 49 THEN 'fail' WHEN l_quantity > 48 THEN 'inconclusive' ELSE 'pass' END AS st FROM lineitem) GROUP BY 1""",
)
def run_summary(spark, sf_dir):
    status = F.when(F.col("l_quantity") > 49, "fail").when(F.col("l_quantity") > 48, "inconclusive").otherwise("pass")
    return verify.run_summary(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("equip"), (F.col("l_linenumber") % 3 + 1).alias("rung"), status.alias("status")))


@register(
    "derivation_chain",
    """WITH w AS (SELECT user_id, arg_max(value, ts) AS v FROM events WHERE event_type = 'view' AND ts BETWEEN TIMESTAMP '2024-01-25' - INTERVAL 5 DAY AND '2024-01-25' GROUP BY 1), u AS (SELECT DISTINCT user_id FROM events),
    a AS (SELECT user_id, v * 2 AS v FROM u LEFT JOIN w USING (user_id))
    SELECT 'double' AS derivation, 'd' || user_id AS target, round(v, 6) AS value FROM a UNION ALL SELECT 'plus', 'p' || user_id, round(v + 1, 6) FROM a""",
)
def derivation_chain(spark, sf_dir):
    """A derivation that reads another one's output in the same pass."""
    e = table(spark, sf_dir, "events")
    point = F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type")
    users = e.select("user_id").distinct()
    to = lambda head, source: users.select(F.concat(F.lit(head), F.col("user_id").cast("string")).alias("target"), F.lit("x").alias("name"), source.alias("point_uri"))
    key = F.col("user_id").cast("string")
    last = lambda inputs, target: inputs["x"][-1][1] if inputs.get("x") else None
    chain = {
        "double": (to("d", F.concat(key, F.lit("/view"))), lambda i, t: None if last(i, t) is None else 2 * last(i, t)),
        "plus": (to("p", F.concat(F.lit("d"), key)), lambda i, t: None if last(i, t) is None else last(i, t) + 1),
        "lost": (to("l", key), last),
    }
    samples = e.select(point.alias("point_uri"), "ts", "value")
    out = derive.evaluate_chain(samples, chain, {"double": set(), "plus": {"double"}, "lost": {"missing"}}, ntz("2024-01-25"), 5 * 86400)
    return out.select("derivation", "target", r6("value"))


@register(
    "schedule_transitions",
    """WITH w(dow, minute, value) AS (VALUES (0, 360, 21.0), (0, 1080, 16.0), (1, 360, 21.5), (2, 420, 20.0), (4, 0, 19.0)), x(day, priority, minute, value) AS (VALUES (DATE '2024-01-08', 5, 0, 12.0), (DATE '2024-01-08', 3, 600, 25.0), (DATE '2024-01-10', 16, 300, 11.0)),
    d AS (SELECT DISTINCT ts::DATE AS day FROM events), t AS (SELECT day, 0 AS minute FROM d UNION SELECT day, minute FROM d JOIN w ON dow = isodow(day) - 1 UNION SELECT day, minute FROM d JOIN x USING (day)),
    v AS (SELECT day + to_minutes(minute) AS ts, coalesce((SELECT arg_min(value, priority * 10000 - x.minute) FROM x WHERE x.day = t.day AND x.minute <= t.minute), (SELECT arg_max(value, w.minute) FROM w WHERE dow = isodow(t.day) - 1 AND w.minute <= t.minute), 15.0) AS value FROM t)
    SELECT ts, CAST(value AS DOUBLE) AS value FROM (SELECT *, lag(value) OVER (ORDER BY ts) AS was FROM v) WHERE was <> value""",
)
def schedule_transitions(spark, sf_dir):
    """Every change of a weekly schedule with exceptions over the days that have events."""
    from datetime import date

    weekly = spark.createDataFrame([(0, 360, 21.0), (0, 1080, 16.0), (1, 360, 21.5), (2, 420, 20.0), (4, 0, 19.0)], "dow int, minute int, value double")
    special = spark.createDataFrame([(date(2024, 1, 8), 5, 0, 12.0), (date(2024, 1, 8), 3, 600, 25.0), (date(2024, 1, 10), 16, 300, 11.0)], "day date, priority int, minute int, value double")
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()
    return lifecycle.schedule_transitions(days, weekly, special, 15.0)


@register("week_n_day", "SELECT o_orderkey FROM orders WHERE (month(o_orderdate) % 2 = 0 AND isodow(o_orderdate) = 2 AND day(o_orderdate) > day(last_day(o_orderdate)) - 7) OR (month(o_orderdate) = 3 AND day(o_orderdate) BETWEEN 8 AND 14) OR o_orderdate::DATE BETWEEN '1997-01-05' AND '1997-01-20'")
def week_n_day(spark, sf_dir):
    """The last Tuesday of even months, the second week of March, and a range of dates."""
    day = F.to_date("o_orderdate")
    keep = lifecycle.week_n_day(day, 14, 6, 1) | lifecycle.week_n_day(day, 3, 2) | lifecycle.in_date_range(day, "1997-01-05", "1997-01-20")
    return table(spark, sf_dir, "orders").where(keep).select("o_orderkey")


@register("cost_by_risk", "SELECT o_orderpriority AS risk, count(*) AS items, round(sum(o_totalprice), 2) AS cost FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def cost_by_risk(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderpriority").alias("risk"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("done").alias("status"), F.col("o_totalprice").alias("cost"))
    return lifecycle.cost_by_risk(rows).select("risk", "items", F.round("cost", 2).alias("cost"))


@register(
    "table_recall",
    """WITH t AS (SELECT p_brand AS title, CAST(p_partkey AS VARCHAR) AS row, unnest(['name', 'type']) AS head, unnest([p_name, p_type]) AS value FROM part), p AS (SELECT title, row, head, CASE WHEN CAST(row AS BIGINT) % 4 = 0 THEN '?' ELSE upper(value) END AS value FROM t WHERE CAST(row AS BIGINT) % 7 <> 0 AND title <> 'Brand#2'),
    c AS (SELECT (SELECT count(DISTINCT title) FROM t) AS regions, (SELECT count(DISTINCT title) FROM p) AS found, (SELECT count(*) FROM t) AS n_true, (SELECT count(*) FROM p) AS n_pred, (SELECT count(*) FROM p WHERE value <> '?') AS tp)
    SELECT *, round(found / regions, 6) AS region_recall, round(tp / n_pred, 6) AS precision, round(tp / n_true, 6) AS recall, round(2 * (tp / n_pred) * (tp / n_true) / (tp / n_pred + tp / n_true), 6) AS f1 FROM c""",
)
def table_recall(spark, sf_dir):
    """Extracted tables against true ones, cell by cell and region by region."""
    p = table(spark, sf_dir, "part")
    cells = F.explode(F.array(F.struct(F.lit("name").alias("head"), F.col("p_name").alias("value")), F.struct(F.lit("type").alias("head"), F.col("p_type").alias("value"))))
    truth = p.select(F.col("p_brand").alias("title"), F.col("p_partkey").cast("string").alias("row"), cells.alias("c"), "p_partkey").select("title", "row", "c.*", "p_partkey")
    read = truth.where("p_partkey % 7 <> 0 and title <> 'Brand#2'").withColumn("value", F.when(F.col("p_partkey") % 4 == 0, F.lit("?")).otherwise(F.upper("value")))
    out = lifecycle.cell_totals(truth, read)
    return out.select("regions", "found", "n_true", "n_pred", "tp", r6("region_recall"), r6("precision"), r6("recall"), r6("f1"))


@register(
    "judge_late",
    f"""WITH {H}, r AS (SELECT point_uri, ts, value FROM h WHERE value IS NOT NULL), l AS (SELECT point_uri, ts FROM r WHERE epoch_us(ts) % 11 = 0),
    w AS (SELECT *, list(value) OVER (PARTITION BY point_uri ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) || list(value) OVER (PARTITION BY point_uri ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS n FROM r),
    m AS (SELECT *, list_median(n) AS m FROM w WHERE len(n) = 10), d AS (SELECT *, list_median(list_transform(n, lambda x: abs(x - m))) AS mad FROM m)
    SELECT point_uri, ts FROM d JOIN l USING (point_uri, ts) WHERE abs(value - m) > 6.0 * 1.4826 * greatest(mad, greatest(abs(m) * 0.001, 1e-6))""",
)
def judge_late(spark, sf_dir):
    """Late samples judged for spikes among the samples beside them."""
    h = history(spark, sf_dir).where("value is not null").select("point_uri", "ts", "value")
    late = h.where(F.unix_micros(F.col("ts").cast("timestamp")) % 11 == 0)
    return faults.judge_late(h, late, lambda rows: windows.spikes(rows, "point_uri")).select("point_uri", "ts")
