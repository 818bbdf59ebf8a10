"""Registered queries: votes by scope, question patterns, verdicts by class tree, coverage by method, descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantflow.functions import mapping
from plantflow.operators import graph, verify
from plantflow.plans.domain_queries import UP_SQL, WORDS_SQL, part_words
from plantflow.plans.history_queries import r6
from plantflow.registry import register
from plantflow.session import table
from plantflow.sources.adapter import containment


def named(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


@register(
    "vote_by_scope",
    f"""WITH {WORDS_SQL}, x AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(tokens) AS token FROM t) GROUP BY ALL), d AS (SELECT token, count(*) AS df FROM x GROUP BY 1),
    r AS (SELECT id, token, tf * (ln((1.0 + (SELECT count(*) FROM t)) / (1 + df)) + 1) AS w FROM x JOIN d USING (token)),
    n AS (SELECT id, token, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w, p_brand AS site FROM r JOIN part ON p_partkey = id),
    s AS (SELECT a.id AS q, b.id, min(a.site) = min(b.site) AS same, sum(a.w * b.w) AS sim FROM n a JOIN n b ON a.token = b.token AND a.id <> b.id WHERE a.id % 50 = 0 GROUP BY ALL HAVING sum(a.w * b.w) >= 0.6),
    k AS (SELECT q, id, 'site' AS scope FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(sim, 9) DESC, id) <= 5
      UNION ALL SELECT q, id, 'all' FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(sim, 9) DESC, id) <= 5),
    v AS (SELECT q, scope, min(p_type) AS label FROM k JOIN part ON p_partkey = id GROUP BY 1, 2 HAVING count(*) >= 2 AND min(p_type) = max(p_type))
    SELECT q, label, scope FROM v QUALIFY row_number() OVER (PARTITION BY q ORDER BY scope DESC) = 1""",
)
def vote_by_scope(spark, sf_dir):
    """Every fiftieth part against all: its own brand's parts vote first, then all parts."""
    parts = table(spark, sf_dir, "part")
    weights = mapping.tfidf(part_words(spark, sf_dir)).join(parts.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("site")), "id")
    labels = parts.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("label"))
    return mapping.vote_by_scope(weights.where("id % 50 = 0"), weights, labels, "site")


@register(
    "question_patterns",
    """SELECT 'point|' || regexp_replace(p_brand, '[0-9]+', '{n}', 'g') || '|' || array_to_string(list_sort(string_split(p_name, ' ')), ',') || '|' || CASE WHEN p_size % 3 = 0 THEN 'in' ELSE '' END AS pattern, count(*) AS n FROM part GROUP BY 1""",
)
def question_patterns(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    pattern = mapping.question_pattern(F.lit("point"), F.col("p_brand"), F.split("p_name", " "), F.when(F.col("p_size") % 3 == 0, "in"))
    return p.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n"))


@register(
    "class_verdicts",
    f"""WITH RECURSIVE {UP_SQL}, r AS (SELECT 'urn:nation:' || c_nationkey AS truth, CASE c_custkey % 4 WHEN 0 THEN 'urn:region:' || n_regionkey WHEN 1 THEN 'urn:nation:' || ((c_nationkey + 1) % 25) ELSE 'urn:nation:' || c_nationkey END AS predicted,
      CASE WHEN c_acctbal > 5000 THEN 'rule' WHEN c_acctbal > 0 THEN 'vote' ELSE 'review' END AS step FROM customer JOIN nation ON n_nationkey = c_nationkey),
    v AS (SELECT step, CASE WHEN predicted = truth THEN 'correct' WHEN EXISTS (SELECT 1 FROM up WHERE node = truth AND ancestor = predicted) THEN 'partial' ELSE 'wrong' END AS verdict FROM r)
    SELECT step, count(*) AS points, round(100.0 * count(*) / (SELECT count(*) FROM v), 4) AS pct, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'partial') AS partial, count(*) FILTER (verdict = 'wrong') AS wrong,
    round(CASE WHEN step IS NULL OR step <> 'review' THEN count(*) FILTER (verdict = 'correct') / count(*) END, 6) AS accuracy FROM v GROUP BY ROLLUP (step)""",
)
def class_verdicts(spark, sf_dir):
    """Predicted places of customers against true ones: a region is part of the truth for its nations."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    c = table(spark, sf_dir, "customer").join(nations, "c_nationkey").withColumn("other", (F.col("c_nationkey") + 1) % 25)
    truth, turn = named("urn:nation:", "c_nationkey"), F.col("c_custkey") % 4
    guess = F.when(turn == 0, named("urn:region:", "n_regionkey")).when(turn == 1, named("urn:nation:", "other")).otherwise(truth)
    step = F.when(F.col("c_acctbal") > 5000, "rule").when(F.col("c_acctbal") > 0, "vote").otherwise("review")
    results = c.select(truth.alias("truth"), guess.alias("predicted"), step.alias("step"))
    judged = mapping.verdicts(results, graph.closure(containment(spark, sf_dir), reflexive=False))
    found = mapping.step_summary(judged, ("rule", "vote"))
    return found.select("step", "points", F.round("pct", 4).alias("pct"), "correct", "partial", "wrong", r6("accuracy"))


@register(
    "coverage_by_method",
    """WITH s AS (SELECT l_partkey AS equip, CASE l_returnflag WHEN 'A' THEN 'fail' WHEN 'N' THEN 'pass' ELSE 'inconclusive' END AS status, CASE WHEN l_linenumber % 3 = 0 THEN 'passive' WHEN l_linestatus = 'O' THEN 'active' ELSE 'manual' END AS method FROM lineitem WHERE l_quantity > 45),
    f AS (SELECT p_type AS class, p_partkey AS equip, p_size <= 40 AS sampled, (SELECT list(DISTINCT status) FROM s WHERE s.equip = p_partkey) AS st, (SELECT list(DISTINCT method) FROM s WHERE s.equip = p_partkey AND status <> 'inconclusive') AS me FROM part),
    g AS (SELECT *, coalesce(len(me), 0) > 0 AS tested, coalesce(list_contains(st, 'fail'), false) AS failed, coalesce(list_contains(st, 'inconclusive'), false) AS incomplete FROM f)
    SELECT class, count(*) AS in_class, count(*) FILTER (sampled) AS sampled, count(*) FILTER (tested) AS tested, count(*) FILTER (tested AND NOT failed AND NOT incomplete) AS passed, count(*) FILTER (failed) AS failed,
    count(*) FILTER (sampled AND NOT tested) AS untested, count(*) FILTER (list_contains(me, 'passive')) AS by_passive, count(*) FILTER (list_contains(me, 'active')) AS by_active, count(*) FILTER (list_contains(me, 'manual')) AS by_manual FROM g GROUP BY 1""",
)
def coverage_by_method(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "A", "fail").when(F.col("l_returnflag") == "N", "pass").otherwise("inconclusive")
    method = F.when(F.col("l_linenumber") % 3 == 0, None).when(F.col("l_linestatus") == "O", "active").otherwise("manual")
    steps = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("equip"), status.alias("status"), method.alias("method"))
    equipment = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("equip"), F.col("p_type").alias("class"), (F.col("p_size") <= 40).alias("sampled"))
    return verify.coverage_by_method(equipment, steps, ("passive", "active", "manual"))


@register(
    "describe_with_class",
    """WITH p AS (SELECT *, 'urn:point:' || p_partkey || '/' || lower(p_type) AS point FROM part),
    l AS (SELECT l_partkey AS k, min('urn:equip:' || l_suppkey) AS equip, min(CASE WHEN l_returnflag = 'A' THEN 'P_' || l_linestatus END) AS project, min(CASE WHEN l_returnflag = 'R' THEN 'X_' || l_linestatus END) AS extension FROM lineitem GROUP BY 1)
    SELECT point, coalesce(CASE WHEN p_size % 3 <> 0 THEN p_name END, lower(p_type)) AS dis, CASE WHEN p_size % 2 = 0 THEN 'in' END AS unit, CASE WHEN p_size > 25 THEN 'Number' ELSE 'Bool' END AS kind,
    coalesce(CASE WHEN p_size % 5 = 0 THEN p_type END, extension, project) AS class, equip FROM p LEFT JOIN l ON k = p_partkey""",
)
def describe_with_class(spark, sf_dir):
    """Parts as points: names, units and kinds of the part, equipment and lesser classes of its lines."""
    p = table(spark, sf_dir, "part").withColumn("point", F.concat(F.lit("urn:point:"), F.col("p_partkey").cast("string"), F.lit("/"), F.lower("p_type")))
    li = table(spark, sf_dir, "lineitem").join(p.select(F.col("p_partkey").alias("l_partkey"), "point"), "l_partkey")
    size = F.col("p_size")
    own = {"dis": F.when(size % 3 != 0, F.col("p_name")), "unit": F.when(size % 2 == 0, "in"), "kind": F.when(size > 25, "Number").otherwise("Bool")}
    listed = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in own.items()])).alias("f")
    facts = p.select("point", listed).select("point", "f.*").unionByName(li.select("point", F.lit("equip").alias("field"), named("urn:equip:", "l_suppkey").alias("value")))
    brick = p.where(size % 5 == 0).select("point", F.col("p_type").alias("class"), F.lit("brick").alias("source"))
    flag = F.col("l_returnflag")
    lesser = li.where(flag.isin("A", "R")).select("point", F.concat(F.when(flag == "A", "P_").otherwise("X_"), "l_linestatus").alias("class"), F.when(flag == "A", "project").otherwise("extension").alias("source"))
    return graph.described(p, facts, brick.unionByName(lesser))
