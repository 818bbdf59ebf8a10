"""Domain tables derived from the driver tables: history, tags, containment, assets.

`history` has one typed reading per (point_uri, ts); the three value columns are never
merged into one. `HISTORY_SQL` is the same relation for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantflow.session import table

POINT = "urn:point:"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of one point per user and event type: numbers, some texts, booleans for errors."""
    e = table(spark, sf_dir, "events")
    boolean, text = F.col("event_type") == "error", (F.col("event_type") != "error") & (F.col("event_id") % 17 == 0)
    unit = F.when(F.col("event_type") == "view", "°F").when(F.col("event_type") == "click", "kW")
    quality = F.when(F.col("event_id") % 23 == 0, "overridden").when(F.col("event_id") % 29 == 0, "fault")
    return e.select(
        F.concat(F.lit(POINT + "u"), F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("point_uri"),
        "ts",
        F.when(~boolean & ~text, F.col("value")).alias("value"),
        F.when(text, F.lit("fault")).alias("value_text"),
        F.when(boolean, F.col("value") > 50).alias("value_bool"),
        unit.alias("unit"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("L"), F.col("user_id").cast("string"))).alias("label"),
        quality.alias("quality"),
    )


HISTORY_SQL = """h AS (
  SELECT 'urn:point:u' || user_id || '/' || event_type AS point_uri, ts,
         CASE WHEN event_type <> 'error' AND event_id % 17 <> 0 THEN value END AS value,
         CASE WHEN event_type <> 'error' AND event_id % 17 = 0 THEN 'fault' END AS value_text,
         CASE WHEN event_type = 'error' THEN value > 50 END AS value_bool,
         CASE event_type WHEN 'view' THEN '°F' WHEN 'click' THEN 'kW' END AS unit,
         CASE WHEN event_id % 5 <> 0 THEN 'L' || user_id END AS label,
         CASE WHEN event_id % 23 = 0 THEN 'overridden' WHEN event_id % 29 = 0 THEN 'fault' END AS quality
  FROM events)"""


def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent): customers and suppliers in nations, nations in regions."""
    part = lambda kind, key: F.concat(F.lit(f"urn:{kind}:"), F.col(key).cast("string"))
    nation = table(spark, sf_dir, "nation").select(part("nation", "n_nationkey").alias("child"), part("region", "n_regionkey").alias("parent"))
    customer = table(spark, sf_dir, "customer").select(part("customer", "c_custkey").alias("child"), part("nation", "c_nationkey").alias("parent"))
    supplier = table(spark, sf_dir, "supplier").select(part("supplier", "s_suppkey").alias("child"), part("nation", "s_nationkey").alias("parent"))
    return nation.unionByName(customer).unionByName(supplier)


CONTAINMENT_SQL = """edges AS (
  SELECT 'urn:nation:' || n_nationkey AS child, 'urn:region:' || n_regionkey AS parent FROM nation
  UNION ALL SELECT 'urn:customer:' || c_custkey, 'urn:nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'urn:supplier:' || s_suppkey, 'urn:nation:' || s_nationkey FROM supplier)"""


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag triples of parts: (s, p, o_kind, o, num, unit). Markers have neither text nor number."""
    p = table(spark, sf_dir, "part").withColumn("s", F.concat(F.lit("urn:equip:p"), F.col("p_partkey").cast("string")))
    text = lambda tag, col: p.select("s", F.lit(tag).alias("p"), F.lit("str").alias("o_kind"), F.col(col).alias("o"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("string").alias("unit"))
    number = lambda tag, col, unit: p.select("s", F.lit(tag).alias("p"), F.lit("num").alias("o_kind"), F.lit(None).cast("string").alias("o"), F.col(col).cast("double").alias("num"), unit.alias("unit"))
    marker = p.where("p_size % 2 = 0").select("s", F.lit("even").alias("p"), F.lit("marker").alias("o_kind"), F.lit(None).cast("string").alias("o"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("string").alias("unit"))
    inch = F.when(F.col("p_size") % 3 == 0, "in")
    return text("brand", "p_brand").unionByName(text("dis", "p_name")).unionByName(number("size", "p_size", inch)).unionByName(marker)


TAGS_SQL = """tags AS (
  SELECT 'urn:equip:p' || p_partkey AS s, 'brand' AS p, 'str' AS o_kind, p_brand AS o, CAST(NULL AS DOUBLE) AS num, CAST(NULL AS VARCHAR) AS unit FROM part
  UNION ALL SELECT 'urn:equip:p' || p_partkey, 'dis', 'str', p_name, NULL, NULL FROM part
  UNION ALL SELECT 'urn:equip:p' || p_partkey, 'size', 'num', NULL, CAST(p_size AS DOUBLE), CASE WHEN p_size % 3 = 0 THEN 'in' END FROM part
  UNION ALL SELECT 'urn:equip:p' || p_partkey, 'even', 'marker', NULL, NULL, NULL FROM part WHERE p_size % 2 = 0)"""
