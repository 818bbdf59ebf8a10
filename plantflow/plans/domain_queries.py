"""Registered queries: graph, tag filters, mapping and search, performance models."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantflow.functions import mapping
from plantflow.operators import graph, performance, windows
from plantflow.operators.components import components
from plantflow.operators.graph import Tag
from plantflow.plans.history_queries import H, r6
from plantflow.registry import register
from plantflow.session import table
from plantflow.sources.adapter import CONTAINMENT_SQL, TAGS_SQL, containment, history, tags

UP_SQL = f"""{CONTAINMENT_SQL}, up AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM edges
  UNION ALL SELECT up.node, e.parent, up.depth + 1 FROM up JOIN edges e ON e.child = up.ancestor)"""


@register("graph_closure", f"WITH RECURSIVE {UP_SQL} SELECT node, ancestor, CAST(depth AS INTEGER) AS depth FROM up")
def graph_closure(spark, sf_dir):
    return graph.closure(containment(spark, sf_dir), reflexive=False)


@register(
    "symmetric_components",
    """WITH RECURSIVE e AS (SELECT l_suppkey AS a, l_suppkey + 1 AS b FROM lineitem UNION SELECT l_suppkey + 1, l_suppkey FROM lineitem),
    c AS (SELECT a AS n, a AS r FROM e UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.n) SELECT n AS node, min(r) AS root FROM c GROUP BY 1""",
)
def symmetric_components(spark, sf_dir):
    """Equivalent equipment: groups of symmetric pairs, here one chain through all suppliers, smallest member as name."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") + 1).alias("b")).distinct()
    return components(pairs)


@register(
    "effective_tags",
    f"""WITH RECURSIVE {UP_SQL}, ct AS (SELECT 'urn:region:' || r_regionkey AS class, lower(r_name) AS tag FROM region UNION ALL SELECT 'urn:nation:' || n_nationkey, 'nation' FROM nation),
    al AS (SELECT node, ancestor FROM up UNION SELECT node, node FROM up UNION SELECT ancestor, ancestor FROM up)
    SELECT DISTINCT node AS class, tag FROM al JOIN ct ON ct.class = al.ancestor""",
)
def effective_tags(spark, sf_dir):
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("urn:region:"), F.col("r_regionkey").cast("string")).alias("class"), F.lower("r_name").alias("tag"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("urn:nation:"), F.col("n_nationkey").cast("string")).alias("class"), F.lit("nation").alias("tag"))
    return graph.effective_tags(graph.closure(containment(spark, sf_dir)), region.unionByName(nation))


LEAVES_SQL = "leaves AS (SELECT 'urn:customer:' || c_custkey AS node, c_acctbal AS value FROM customer)"


def leaves(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("urn:customer:"), F.col("c_custkey").cast("string")).alias("node"), F.col("c_acctbal").alias("value"))


@register("tree_rollup", f"WITH RECURSIVE {UP_SQL}, {LEAVES_SQL} SELECT ancestor, round(sum(value), 4) AS value FROM up JOIN leaves USING (node) GROUP BY 1")
def tree_rollup(spark, sf_dir):
    up = graph.closure(containment(spark, sf_dir), reflexive=False)
    return graph.tree_rollup(up, leaves(spark, sf_dir)).select("ancestor", F.round("value", 4).alias("value"))


@register(
    "tree_rollup_by_level",
    f"""WITH {LEAVES_SQL}, n AS (SELECT c_nationkey AS k, max(c_acctbal) / 2 AS value FROM customer GROUP BY 1), r AS (SELECT n_regionkey AS k, max(value) / 2 AS value FROM n JOIN nation ON n_nationkey = k GROUP BY 1)
    SELECT node, round(value / 2, 6) AS value FROM leaves UNION ALL SELECT 'urn:nation:' || k, round(value / 2, 6) FROM n UNION ALL SELECT 'urn:region:' || k, round(value / 2, 6) FROM r""",
)
def tree_rollup_by_level(spark, sf_dir):
    """A fold that isn't associative: half of the largest child, level by level."""
    edges = containment(spark, sf_dir).where(~F.col("child").startswith("urn:supplier"))
    return graph.tree_rollup_by_level(edges, leaves(spark, sf_dir), lambda v: F.max(v) / 2).select("node", r6("value"))


@register("serving_chain", f"WITH RECURSIVE {UP_SQL} SELECT node AS start, ancestor AS node, CAST(min(depth) AS INTEGER) AS level FROM up WHERE node LIKE 'urn:supplier:%' GROUP BY 1, 2")
def serving_chain(spark, sf_dir):
    start = table(spark, sf_dir, "supplier").select(F.concat(F.lit("urn:supplier:"), F.col("s_suppkey").cast("string")).alias("node"))
    return graph.chain(containment(spark, sf_dir), start, 6)


@register("navigation", f"WITH {CONTAINMENT_SQL} SELECT parent, count(*) AS n, min(child) AS first_child FROM edges GROUP BY 1")
def navigation(spark, sf_dir):
    return containment(spark, sf_dir).groupBy("parent").agg(F.count("*").alias("n"), F.min("child").alias("first_child"))


@register("orphan_points", f"WITH {H} SELECT DISTINCT point_uri FROM h WHERE CAST(regexp_extract(point_uri, 'u([0-9]+)', 1) AS BIGINT) NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def orphan_points(spark, sf_dir):
    points = history(spark, sf_dir).select("point_uri").distinct().withColumn("k", F.regexp_extract("point_uri", "u([0-9]+)", 1).cast("long"))
    owned = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")).join(points, "k").select("point_uri")
    return graph.orphans(points.select("point_uri"), owned)


@register("point_groups", f"WITH {H} SELECT regexp_replace(point_uri, '/[^/]*$', '') AS parent, count(DISTINCT point_uri) AS n FROM h GROUP BY 1 HAVING count(DISTINCT point_uri) >= 2")
def point_groups(spark, sf_dir):
    return graph.point_groups(history(spark, sf_dir).select("point_uri").distinct())


@register(
    "tag_filter",
    "SELECT 'urn:equip:p' || p_partkey AS s FROM part WHERE p_size % 2 = 0 AND NOT (p_size % 3 = 0 AND p_size > 20) AND (p_brand = 'Brand#1' OR p_brand = 'Brand#2' OR (p_size % 3 <> 0 AND p_size <= 5))",
)
def tag_filter(spark, sf_dir):
    """even and not (size > 20in) and (brand == "Brand#1" or brand == "Brand#2" or size <= 5)."""
    wanted = Tag.has("even") & ~Tag.number("size", ">", 20, "in") & (Tag.text("brand", "Brand#1") | Tag.text("brand", "Brand#2") | Tag.number("size", "<=", 5))
    return wanted.match(tags(spark, sf_dir))


@register("tag_not_equal", "SELECT 'urn:equip:p' || p_partkey AS s FROM part WHERE NOT (p_size % 3 = 0 AND p_size = 12)")
def tag_not_equal(spark, sf_dir):
    """!= holds where the tag is there and not equal; another unit is not equal."""
    return Tag.number("size", "!=", 12, "in").match(tags(spark, sf_dir))


@register(
    "tag_path",
    "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' AND o_totalprice > 200000",
)
def tag_path(spark, sf_dir):
    """custRef->nationRef->regionRef->name == "ASIA": reference hops as joins."""
    o, c = table(spark, sf_dir, "orders").where("o_totalprice > 200000"), table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").where("r_name = 'ASIA'")
    hops = n.join(r, n["n_regionkey"] == r["r_regionkey"], "left_semi")
    owners = c.join(hops, c["c_nationkey"] == hops["n_nationkey"], "left_semi")
    return o.join(owners, o["o_custkey"] == owners["c_custkey"], "left_semi").select("o_orderkey")


@register(
    "records",
    f"WITH {TAGS_SQL} SELECT s, count(*) AS n_tags, max(num) AS size, bool_or(p = 'even') AS even, max(o) FILTER (p = 'dis') AS dis FROM tags GROUP BY 1",
)
def records(spark, sf_dir):
    """One record per subject, its tags as a map read back by name."""
    as_text = F.coalesce("o", F.col("num").cast("string"), F.lit("✓"))
    rows = tags(spark, sf_dir).groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("p", as_text))).alias("tags"))
    get = lambda k: F.try_element_at("tags", F.lit(k))
    return rows.select("s", F.size("tags").cast("long").alias("n_tags"), get("size").cast("double").alias("size"), get("even").isNotNull().alias("even"), get("dis").alias("dis"))


@register(
    "sort_missing_last",
    "SELECT p_partkey, row_number() OVER (ORDER BY lower(CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_name END) DESC NULLS LAST, p_partkey) AS place FROM part",
)
def sort_missing_last(spark, sf_dir):
    """Reverse sort by a tag: missing last in both directions, all rows numbered in order."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.when(F.col("p_size") % 4 != 0, F.col("p_name"))).alias("tag"))
    return windows.numbered(p, "place", F.col("tag").desc_nulls_last(), F.col("p_partkey").asc()).select("p_partkey", F.col("place").cast("long").alias("place"))


WORDS_SQL = "t AS (SELECT p_partkey AS id, list_filter(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]+'), lambda w: len(w) > 0) AS tokens FROM part)"


def part_words(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), mapping.tokens(F.concat_ws(" ", "p_name", "p_type")).alias("tokens"))


@register(
    "tfidf",
    f"""WITH {WORDS_SQL}, x AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(tokens) AS token FROM t) GROUP BY ALL), d AS (SELECT token, count(*) AS df FROM x GROUP BY 1),
    r AS (SELECT id, token, tf * (ln((1.0 + (SELECT count(*) FROM t)) / (1 + df)) + 1) AS w FROM x JOIN d USING (token))
    SELECT id, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS w FROM r""",
)
def tfidf(spark, sf_dir):
    return mapping.tfidf(part_words(spark, sf_dir)).select("id", "token", r6("w"))


@register(
    "vote_by_neighbours",
    f"""WITH {WORDS_SQL}, x AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(tokens) AS token FROM t) GROUP BY ALL), d AS (SELECT token, count(*) AS df FROM x GROUP BY 1),
    r AS (SELECT id, token, tf * (ln((1.0 + (SELECT count(*) FROM t)) / (1 + df)) + 1) AS w FROM x JOIN d USING (token)),
    n AS (SELECT id, token, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM r),
    s AS (SELECT a.id AS q, b.id, sum(a.w * b.w) AS sim FROM n a JOIN n b ON a.token = b.token AND a.id <> b.id GROUP BY ALL HAVING sum(a.w * b.w) >= 0.6),
    k AS (SELECT q, id FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(sim, 9) DESC, id) <= 5)
    SELECT q, min(p_type) AS label FROM k JOIN part ON p_partkey = id GROUP BY 1 HAVING count(*) >= 2 AND min(p_type) = max(p_type)""",
)
def vote_by_neighbours(spark, sf_dir):
    weights = mapping.tfidf(part_words(spark, sf_dir))
    near = mapping.nearest(weights, weights, 5, 0.6)
    labels = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("label"))
    return mapping.vote(near, labels)


@register(
    "best_rule",
    """WITH e AS (SELECT p_partkey AS id, list_distinct(string_split(p_name, ' ') || [lower(p_type)]) AS tags FROM part),
    r AS (SELECT * FROM (VALUES (1, 'Ring', ['ring']), (2, 'SmallRing', ['small', 'ring']), (3, 'Widget', ['widget']), (4, 'EcoWidget', ['widget', 'economy']), (5, 'RedThing', ['red', 'thing'])) v(ord, class, rt)),
    p AS (SELECT id, class, ord, len(list_intersect(tags, rt)) AS n, len(list_intersect(tags, rt)) = len(rt) AS direct FROM e JOIN r ON len(list_intersect(tags, rt)) > 0),
    b AS (SELECT id, class, direct FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY direct DESC, n DESC, ord) = 1)
    SELECT e.id, class, direct FROM e LEFT JOIN b USING (id)""",
)
def best_rule(spark, sf_dir):
    """Most specific rule whose tags all occur, else the largest overlap; ties to the first in the file."""
    listed = [(1, "Ring", ["ring"]), (2, "SmallRing", ["small", "ring"]), (3, "Widget", ["widget"]), (4, "EcoWidget", ["widget", "economy"]), (5, "RedThing", ["red", "thing"])]
    rules = spark.createDataFrame(listed, "ord int, class string, tags array<string>")
    p = table(spark, sf_dir, "part")
    entities = p.select(F.col("p_partkey").alias("id"), F.array_distinct(F.concat(F.split("p_name", " "), F.array(F.lower("p_type")))).alias("tags"))
    return mapping.best_rule(entities, rules)


@register("naming_patterns", "SELECT regexp_replace(c_name, '[0-9]+', '{n}', 'g') || '/' || c_mktsegment AS pattern, count(*) AS n FROM customer GROUP BY 1")
def naming_patterns(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.groupBy(F.concat_ws("/", mapping.naming_pattern(F.col("c_name")), "c_mktsegment").alias("pattern")).agg(F.count("*").alias("n"))


@register(
    "text_search",
    """SELECT doc_id, score FROM (SELECT doc_id, CAST((len(lower(text)) - len(replace(lower(text), 'the', ''))) / 3 + (len(lower(text)) - len(replace(lower(text), 'and', ''))) / 3 AS BIGINT) AS score
    FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and') AND NOT contains(lower(text), 'der')) ORDER BY score DESC, doc_id LIMIT 100""",
)
def text_search(spark, sf_dir):
    found = mapping.search(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["the", "and"], ("der",), 100)
    return found.select("doc_id", "score")


@register("content_hash", "SELECT sha256(coalesce(text, '')) AS sha, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1")
def content_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


@register(
    "class_scores",
    """WITH p AS (SELECT quality AS class, count(*) AS n_pred, count(*) FILTER (quality = toxic) AS tp FROM labels GROUP BY 1), t AS (SELECT toxic AS class, count(*) AS n_true FROM labels GROUP BY 1),
    b AS (SELECT class, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS n_pred, coalesce(n_true, 0) AS n_true FROM p FULL JOIN t USING (class)), s AS (SELECT *, tp / nullif(n_pred, 0) AS p, tp / nullif(n_true, 0) AS r FROM b)
    SELECT class, tp, n_pred, n_true, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1 FROM s""",
)
def class_scores(spark, sf_dir):
    out = mapping.scores(table(spark, sf_dir, "labels"), "quality", "toxic")
    return out.select("class", "tp", "n_pred", "n_true", r6("precision"), r6("recall"), r6("f1"))


@register(
    "vector_cosine",
    "SELECT a.vec_id AS q, b.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id",
)
def vector_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    a = e.select(F.col("vec_id").alias("q"), "label", F.col("embedding").alias("x"))
    b = e.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("y"))
    return mapping.cosine_pairs(a, b).select("q", "id", F.round("sim", 5).alias("sim"))


@register(
    "equipment_scores",
    """WITH h AS (SELECT DISTINCT user_id AS equip, event_type AS class FROM events), s(type, class, weight) AS (VALUES ('AHU', 'click', 2.0), ('AHU', 'view', 1.0), ('VAV', 'view', 1.0), ('VAV', 'error', 1.0), ('PUMP', 'purchase', 3.0), ('PUMP', 'signup', 1.0)),
    m AS (SELECT equip, type, sum(weight) AS met, count(*) AS ex FROM h JOIN s USING (class) GROUP BY ALL), t AS (SELECT type, sum(weight) AS a FROM s GROUP BY 1), p AS (SELECT equip, count(*) AS n FROM h GROUP BY 1),
    r AS (SELECT equip, type, CAST(0.6 AS DOUBLE) * CAST(met AS DOUBLE) / CAST(a AS DOUBLE) + CAST(0.4 AS DOUBLE) * ex / n AS score FROM m JOIN t USING (type) JOIN p USING (equip))
    SELECT equip, type, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY equip ORDER BY round(score, 9) DESC, type) AS rank FROM r) WHERE rank <= 3""",
)
def equipment_scores(spark, sf_dir):
    found = table(spark, sf_dir, "events").select(F.col("user_id").alias("equip"), F.col("event_type").alias("class"))
    listed = [("AHU", "click", 2.0), ("AHU", "view", 1.0), ("VAV", "view", 1.0), ("VAV", "error", 1.0), ("PUMP", "purchase", 3.0), ("PUMP", "signup", 1.0)]
    return mapping.equipment_scores(found, spark.createDataFrame(listed, "type string, class string, weight double")).select("equip", "type", r6("score"), "rank")


HOURS_SQL = """x AS (SELECT date_trunc('hour', ts) AS ts, avg(value) FILTER (event_type = 'view') AS kw, avg(value) FILTER (event_type = 'click') AS tons, avg(value) FILTER (event_type = 'purchase') AS ecwt FROM events GROUP BY 1),
    u AS (SELECT ts, CAST(kw AS DOUBLE) AS kw, tons, ecwt FROM x WHERE kw IS NOT NULL AND tons IS NOT NULL AND ecwt IS NOT NULL AND kw >= 0 AND tons > (SELECT 0.1 * max(tons) FROM x WHERE kw IS NOT NULL AND ecwt IS NOT NULL)),
    f AS (SELECT *, kw / tons AS y, tons * tons AS tons2 FROM u)"""


def hours(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    series = lambda kind: e.where(F.col("event_type") == kind).groupBy(hour).agg(F.avg("value").alias("v"))
    return performance.usable_hours(series("view"), series("click"), series("purchase"))


@register(
    "regression_sums",
    f"WITH {HOURS_SQL} SELECT count(*) AS n, round(sum(tons), 4) AS one_tons, round(sum(tons2) / 1e3, 4) AS tons_tons, round(sum(ecwt * tons) / 1e3, 4) AS tons_ecwt, round(sum(y), 4) AS one_y FROM f",
)
def regression_sums(spark, sf_dir):
    sums = performance.normal_sums(hours(spark, sf_dir))
    return sums.select("n", F.round("one_tons", 4).alias("one_tons"), F.round(F.col("tons_tons") / 1e3, 4).alias("tons_tons"), F.round(F.col("tons_ecwt") / 1e3, 4).alias("tons_ecwt"), F.round("one_y", 4).alias("one_y"))


def solved(rows: str) -> str:
    """SQL steps that eliminate the 4 x 4 normal equations of `rows`; g4.c04 to c34 are the coefficients."""
    x = ("1.0", "tons", "tons2", "ecwt")
    cells = [(i, j) for i in range(4) for j in range(5)]
    steps = ["g0 AS (SELECT " + ", ".join(f"sum({x[i]} * {(*x, 'y')[j]}) AS c{i}{j}" for i, j in cells) + f" FROM {rows})"]
    for k in range(4):
        row = [f"c{i}{j} / c{k}{k} AS c{i}{j}" if i == k else f"c{i}{j} - c{i}{k} * c{k}{j} / c{k}{k} AS c{i}{j}" for i, j in cells]
        steps.append(f"g{k + 1} AS (SELECT {', '.join(row)} FROM g{k})")
    return ", ".join(steps)


FITTED_SQL = "c04 + c14 * tons + c24 * tons2 + c34 * ecwt AS fitted"


@register(
    "regression_quality",
    f"""WITH {HOURS_SQL}, {solved("f")}, r AS (SELECT y, {FITTED_SQL} FROM f, g4)
    SELECT count(*) AS n, round(100 * sqrt(sum((y - fitted) * (y - fitted)) / greatest(count(*) - 4, 1)) / avg(y), 4) AS cvrmse, round(100 * sum(y - fitted) / (greatest(count(*) - 4, 1) * avg(y)), 4) + 0.0 AS nmbe FROM r""",
)
def regression_quality(spark, sf_dir):
    """Fit by normal equations, then CV(RMSE) and NMBE."""
    rows = hours(spark, sf_dir)
    found = performance.fit_quality(rows, performance.fit(rows))
    return found.select("n", F.round("cvrmse", 4).alias("cvrmse"), (F.round("nmbe", 4) + F.lit(0.0)).alias("nmbe"))


@register(
    "degradation",
    f"""WITH {HOURS_SQL}, b AS (SELECT * FROM f WHERE ts < '2024-01-16'), {solved("b")}, l AS (SELECT min(tons) AS t0, max(tons) AS t1, min(ecwt) AS e0, max(ecwt) AS e1 FROM b),
    r AS (SELECT date_trunc('week', ts) AS bucket, y, {FITTED_SQL} FROM f, g4, l WHERE ts >= '2024-01-16' AND tons BETWEEN t0 AND t1 AND ecwt BETWEEN e0 AND e1)
    SELECT CAST(bucket AS TIMESTAMP) AS bucket, count(*) AS n, round(100 * (avg(y) - avg(fitted)) / avg(fitted), 4) AS gap_pct FROM r GROUP BY ROLLUP (bucket)""",
)
def degradation(spark, sf_dir):
    """Hours of the second half against a model of the first half, where the conditions match."""
    rows, middle = hours(spark, sf_dir), F.lit("2024-01-16").cast("timestamp_ntz")
    base, later = rows.where(F.col("ts") < middle), rows.where(F.col("ts") >= middle)
    found = performance.degradation(performance.in_range(later, base), performance.fit(base), "week")
    return found.select("bucket", "n", F.round("gap_pct", 4).alias("gap_pct"))


@register(
    "feeds",
    """WITH b AS (SELECT event_type, user_id % 8 AS g, epoch_us(ts) // 7200000000 AS b, avg(value) AS v FROM events GROUP BY ALL),
    u AS (SELECT 'ahu' || g AS u, g % 2 AS site, b, v FROM b WHERE event_type = 'click'),
    l AS (SELECT 'vav' || x.g || '-' || k AS l, x.g % 2 AS site, b, x.v + k * 0.3::DOUBLE * coalesce(y.v, 0) AS v FROM b x LEFT JOIN (SELECT g, b, v FROM b WHERE event_type = 'view') y USING (g, b), (SELECT unnest([0, 1, 4]) AS k) WHERE x.event_type = 'click'),
    s AS (SELECT u, l, count(*) AS n, CASE WHEN stddev_pop(u.v) > 0 AND stddev_pop(l.v) > 0 THEN corr(u.v, l.v) END AS r FROM u JOIN l USING (site, b) GROUP BY 1, 2 HAVING count(*) >= 24),
    k AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY round(r, 9) DESC, u) AS rn, lead(r) OVER (PARTITION BY l ORDER BY round(r, 9) DESC, u) AS nx FROM s WHERE r IS NOT NULL)
    SELECT l, u, round(r, 6) AS r, n FROM k WHERE rn = 1 AND r >= 0.8::DOUBLE AND r - coalesce(nx, -1) >= 0.1::DOUBLE""",
)
def feeds(spark, sf_dir):
    """Terminal units that follow their air handler more or less closely; the least close don't pass."""
    e = table(spark, sf_dir, "events").withColumn("g", F.col("user_id") % 8)
    b = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(7200000000))
    mean = lambda kind: e.where(F.col("event_type") == kind).groupBy("g", b.alias("b")).agg(F.avg("value").alias("v"))
    site = (F.col("g") % 2).alias("site")
    upper = mean("click").select(F.concat(F.lit("ahu"), F.col("g").cast("string")).alias("id"), site, "b", "v")
    own = mean("view").withColumnRenamed("v", "own")
    follow = mean("click").join(own, ["g", "b"], "left").withColumn("k", F.explode(F.array(*map(F.lit, (0, 1, 4)))))
    name = F.concat(F.lit("vav"), F.col("g").cast("string"), F.lit("-"), F.col("k").cast("string"))
    lower = follow.select(name.alias("id"), site, "b", (F.col("v") + F.col("k") * 0.3 * F.coalesce("own", F.lit(0.0))).alias("v"))
    return performance.feeds(upper, lower).select("l", "u", r6("r"), "n")


@register(
    "savings",
    """WITH c AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) / 10 + 1 AS now, 1.5 AS new, p_retailprice * 100 AS th, 0.12 AS tariff, 8.0 AS demand, 50.0 AS peak, p_retailprice * 10 AS cost FROM part),
    g AS (SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b FROM (VALUES (0.8), (1.0), (1.2)) x(a), (VALUES (0.8), (1.0), (1.2)) y(b)),
    m AS (SELECT id, a, b, th * b * (now - CAST(new AS DOUBLE)) AS kwh, cost, th * b * (now - CAST(new AS DOUBLE)) * CAST(tariff AS DOUBLE) * a + 12 * CAST(demand AS DOUBLE) * CAST(peak AS DOUBLE) * (now - CAST(new AS DOUBLE)) AS money FROM c, g)
    SELECT id, a AS tariff_x, b AS load_x, round(kwh, 3) AS kwh, round(money, 3) AS money, round(CASE WHEN round(money, 3) > 0 THEN cost / money END, 4) AS payback FROM m""",
)
def savings(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    d = lambda x: F.lit(x).cast("double")
    cases = p.select(
        F.col("p_partkey").alias("id"), (F.col("p_size") / 10 + 1).alias("now"), d(1.5).alias("new"), (F.col("p_retailprice") * 100).alias("ton_hours"),
        d(0.12).alias("tariff"), d(8).alias("demand"), d(50).alias("peak"), (F.col("p_retailprice") * 10).alias("cost"),
    )
    out = performance.savings(cases)
    return out.select("id", "tariff_x", "load_x", F.round("kwh", 3).alias("kwh"), F.round("money", 3).alias("money"), F.when(F.round("money", 3) > 0, F.round("payback", 4)).alias("payback"))
