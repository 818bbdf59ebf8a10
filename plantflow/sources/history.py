"""History scans, writes and sinks.

Bounds differ by operator on purpose: `read_range` and `read_range_bulk` include both ends,
`read_range_many` is half-open. `good_only` keeps samples whose quality is null or `ok`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HAS_VALUE = "value is not null or value_text is not null or value_bool is not null"
VALUES = ("value", "value_text", "value_bool")


def good(quality: str = "quality") -> Column:
    return F.col(quality).isNull() | (F.col(quality) == "ok")


def fold_value() -> Column:
    """The number a fold sees: numbers as they are, booleans as 0 and 1, texts never."""
    return F.coalesce("value", F.col("value_bool").cast("int").cast("double"))


def read_range(history: DataFrame, point_uri: str, start, end, good_only: bool = False) -> DataFrame:
    """Samples of one point in [start, end], oldest first."""
    rows = history.where((F.col("point_uri") == point_uri) & F.col("ts").between(start, end))
    return (rows.where(good()) if good_only else rows).orderBy("ts")


def read_range_bulk(history: DataFrame, points: DataFrame, start, end) -> DataFrame:
    """Samples in [start, end] of every requested point; a point without any has one empty row."""
    rows = history.where(F.col("ts").between(start, end))
    return points.select("point_uri").distinct().join(rows, "point_uri", "left")


def read_range_many(history: DataFrame, points: DataFrame, start, end, limit: int, good_only: bool = False) -> DataFrame:
    """The oldest `limit` samples in [start, end) of each point, with a flag where there were more."""
    rows = history.join(points.select("point_uri").distinct(), "point_uri", "left_semi").where((F.col("ts") >= start) & (F.col("ts") < end))
    if good_only:
        rows = rows.where(good())
    by_point = Window.partitionBy("point_uri")
    ranked = rows.withColumn("rn", F.row_number().over(by_point.orderBy("ts")))
    # One sample beyond the limit is enough to know that there are more.
    probed = ranked.where(F.col("rn") <= limit + 1).withColumn("truncated", F.max("rn").over(by_point) > limit)
    return probed.where(F.col("rn") <= limit).drop("rn")


def latest(history: DataFrame, before=None, since=None, with_value: bool = False, good_only: bool = False, newest: bool = True) -> DataFrame:
    """The newest (or oldest) sample of each point that meets the conditions; a combinable aggregate."""
    rows = history
    if before is not None:
        rows = rows.where(F.col("ts") <= before)
    if since is not None:
        rows = rows.where(F.col("ts") >= since)
    if with_value:
        rows = rows.where(HAS_VALUE)
    if good_only:
        rows = rows.where(good())
    columns = F.struct(*[c for c in history.columns if c not in ("point_uri",)])
    pick = F.max_by if newest else F.min_by
    return rows.groupBy("point_uri").agg(pick(columns, "ts").alias("s")).select("point_uri", "s.*")


def first_seen(history: DataFrame) -> DataFrame:
    return history.groupBy("point_uri").agg(F.min("ts").alias("first_ts"))


def point_labels(history: DataFrame) -> DataFrame:
    """The newest (unit, label) of each point where either is set."""
    rows = history.where("unit is not null or label is not null")
    return rows.groupBy("point_uri").agg(F.max_by(F.struct("unit", "label"), "ts").alias("s")).select("point_uri", "s.*")


def list_points(history: DataFrame) -> DataFrame:
    return history.select("point_uri").distinct()


def upsert(history: DataFrame, rows: DataFrame, order: str = "seq") -> DataFrame:
    """History after writing `rows`: per (point, ts) the write with the largest `order` replaces all columns."""
    old = history.withColumn(order, F.lit(-1).cast("long"))
    both = old.unionByName(rows.select(*history.columns, F.col(order).cast("long").alias(order)))
    rest = [c for c in history.columns if c not in ("point_uri", "ts")]
    last = both.groupBy("point_uri", "ts").agg(F.max_by(F.struct(*rest), order).alias("s"))
    return last.select("point_uri", "ts", *(F.col(f"s.{c}").alias(c) for c in rest))


def registry(history: DataFrame) -> DataFrame:
    """Every point with its newest time."""
    return history.groupBy("point_uri").agg(F.max("ts").alias("newest_ts"))


def advance_registry(known: DataFrame, batch: DataFrame) -> DataFrame:
    """The registry after a batch; times only move forward."""
    return known.unionByName(registry(batch)).groupBy("point_uri").agg(F.max("newest_ts").alias("newest_ts"))


def delete(history: DataFrame, keys: DataFrame) -> DataFrame:
    return history.join(keys.select("point_uri", "ts").distinct(), ["point_uri", "ts"], "left_anti")


def new_points(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Points of a batch that are not registered yet."""
    return batch.select("point_uri").distinct().join(known, "point_uri", "left_anti")


def import_new(history: DataFrame, rows: DataFrame) -> DataFrame:
    """Insert only: keys that exist are kept as they are."""
    return history.unionByName(rows.join(history.select("point_uri", "ts"), ["point_uri", "ts"], "left_anti"))


def binary_state(state: Column) -> Column:
    return F.when(F.lower(state) == "active", True).when(F.lower(state) == "inactive", False)


def expand_batch(messages: DataFrame) -> DataFrame:
    """Readings of batched envelopes (prefix, ts, points map): one row per label that is a valid path segment."""
    rows = messages.select("prefix", "ts", F.explode("points").alias("label", "value"))
    valid = F.col("label").rlike(r"^[^/\s]+$")
    return rows.where(valid).select(F.concat(F.lit("urn:point:"), "prefix", F.lit("/"), "label").alias("point_uri"), "ts", "value")


def expand_list(messages: DataFrame) -> DataFrame:
    """Readings of batched envelopes whose points are a list: (prefix, ts, points array of (point, value, ts, quality)).

    A point's own time goes before the envelope's; items without a valid label are dropped, tags don't ride a batch.
    """
    rows = messages.select("prefix", F.col("ts").alias("sent"), F.inline("points"))
    valid = F.col("point").rlike(r"^[^/\s]+$") & ~F.col("point").endswith("/tags")
    named = F.concat(F.lit("urn:point:"), "prefix", F.lit("/"), "point")
    return rows.where(valid).select(named.alias("point_uri"), F.coalesce("ts", "sent").alias("ts"), "value", "quality")


def overlay(described: DataFrame, labels: DataFrame) -> DataFrame:
    """Descriptions (point_uri, dis, dis_from_tag, unit) with the unit and label of the history (point_uri, unit, label) where the graph lacks them."""
    known = labels.select("point_uri", F.col("unit").alias("__unit"), F.nullif(F.col("label"), F.lit("")).alias("__label"))
    rows = described.join(known, "point_uri", "left")
    dis = F.when(F.col("dis_from_tag") | F.col("__label").isNull(), F.col("dis")).otherwise(F.col("__label"))
    return rows.select("point_uri", dis.alias("dis"), F.coalesce(F.nullif(F.col("unit"), F.lit("")), "__unit").alias("unit"))


def read_one(matched: DataFrame, column: str = "point_uri") -> DataFrame:
    """The first of what a filter matched, in the order of ids; an error where it matched nothing."""
    first = matched.orderBy(column).limit(1)
    if first.isEmpty():
        raise LookupError("the filter matches nothing")
    return first


def export_history(history: DataFrame, path: str) -> None:
    """Parquet by point and UTC month, sorted by time inside each file."""
    rows = history.withColumn("point", F.col("point_uri")).withColumn("month", F.date_format("ts", "yyyy-MM"))
    dealt = rows.repartition("point", "month").sortWithinPartitions("point", "month", "ts")
    dealt.write.option("compression", "zstd").option("parquet.block.size", str(16 << 20)).partitionBy("point", "month").parquet(path)


def export_files(spark, path: str) -> DataFrame:
    """(point_uri, month, path, rows, fields) of every file of an export; fields are its schema as names and types.

    Rows are counted by Spark. Schemas are read from the files themselves, since a scan would bring all to one.
    """
    import pyarrow as pa
    import pyarrow.parquet as pq

    def footers(batches):
        for batch in batches:
            fields = [",".join(f"{f.name} {f.type}" for f in pq.read_schema(pa.BufferReader(x.as_py()))) for x in batch["content"]]
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(fields, pa.string())], ["path", "fields"])

    stored = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    schemas = stored.select("path", "content").mapInArrow(footers, "path string, fields string")
    rows = spark.read.parquet(path).select(F.col("point").alias("point_uri"), F.col("month").cast("string").alias("month"), F.col("_metadata.file_path").alias("path"))
    counts = rows.groupBy("point_uri", "month", "path").agg(F.count("*").alias("rows"))
    # The two sources write a path with more or less percent-encoding.
    plain = F.regexp_replace(F.coalesce(F.try_url_decode(F.coalesce(F.try_url_decode("path"), "path")), "path"), "^file:/+", "file:/")
    both = counts.withColumn("plain", plain).join(schemas.select(plain.alias("plain"), "fields"), "plain")
    return both.select("point_uri", "month", "path", "rows", "fields")


def check_export(files: DataFrame, listed: DataFrame, totals: DataFrame, fields: str) -> DataFrame:
    """(point_uri, month, error) of an export whose files (`export_files`) don't agree with its lists or the schema `fields`.

    `listed` is (point_uri, month, rows), `totals` (point_uri, rows, files). Errors of a point's total have no month.
    """
    found = files.groupBy("point_uri", "month").agg(F.count("*").alias("files"), F.sum("rows").alias("n"), F.bool_and(F.col("fields") == fields).alias("same"))
    both = found.join(listed.select("point_uri", "month", F.col("rows").alias("want")), ["point_uri", "month"], "full_outer")
    error = (
        F.when(F.col("n").isNull(), "missing").when(F.col("want").isNull(), "not listed").when(F.col("files") > 1, "more than one file")
        .when(~F.col("same"), "schema differs").when(F.col("n") != F.col("want"), "rows differ")
    )
    months = both.select("point_uri", "month", error.alias("error")).where("error is not null")
    sums = listed.groupBy("point_uri").agg(F.sum("rows").alias("n"), F.count("*").alias("f")).join(totals, "point_uri", "full_outer")
    wrong = sums.where(~(F.col("n").eqNullSafe(F.col("rows")) & F.col("f").eqNullSafe(F.col("files"))))
    return months.unionByName(wrong.select("point_uri", F.lit(None).cast("string").alias("month"), F.lit("totals differ").alias("error")))


def live_facts(history: DataFrame) -> DataFrame:
    """Live tags of every point with history, as triples (s, p, o_kind, o, num, unit): his, curStatus and curVal in the unit that the history named last."""
    newest = latest(history, with_value=True).select("point_uri", *VALUES).join(point_labels(history).select("point_uri", "unit"), "point_uri", "left")
    none = F.lit(None)
    fact = lambda p, kind, o=none, num=none, unit=none: F.struct(F.lit(p).alias("p"), kind.alias("o_kind"), o.cast("string").alias("o"), num.cast("double").alias("num"), unit.cast("string").alias("unit"))
    boolean, number = F.col("value_bool").isNotNull(), F.col("value").isNotNull()
    kind = F.when(boolean, "bool").when(number, "num").otherwise("str")
    text = F.when(boolean, F.col("value_bool").cast("string")).when(~number, F.col("value_text"))
    value = fact("curVal", kind, text, F.when(~boolean, F.col("value")), F.when(~boolean & number, F.col("unit")))
    facts = F.array(fact("his", F.lit("marker")), fact("curStatus", F.lit("str"), F.lit("ok")), value)
    return newest.select(F.col("point_uri").alias("s"), F.inline(facts))


def month_counts(history: DataFrame) -> DataFrame:
    return history.groupBy("point_uri", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def reconcile(exported: DataFrame, source: DataFrame) -> DataFrame:
    """Months whose row counts differ or that only one side has."""
    a, b = exported.withColumnRenamed("n", "n_export"), source.withColumnRenamed("n", "n_source")
    both = a.join(b, ["point_uri", "month"], "full_outer")
    return both.where(~F.col("n_export").eqNullSafe(F.col("n_source")))


def manifest(spark, path: str) -> DataFrame:
    """Relative file names with sizes and sha256 sums of an export."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def check_manifest(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, error) of files (path, sha256) that are missing, not listed, or changed since they were listed."""
    both = listed.select("path", F.col("sha256").alias("was")).join(found.select("path", F.col("sha256").alias("now")), "path", "full_outer")
    error = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "not listed").when(F.col("was") != F.col("now"), "sha256 differs")
    return both.select("path", error.alias("error")).where("error is not null")


def missed(consumers: DataFrame, batches: DataFrame) -> DataFrame:
    """(consumer, missed): batches (at) beyond each consumer's offset (consumer, at); those that missed none are left out.

    Batches and offsets are put in one order by ranges, and each range starts with the
    batches of the ranges after it, so neither side is collected and no pairs are made.
    """
    from plantflow.session import cut

    rows = consumers.select("at", "consumer", F.lit(0).alias("batch")).unionByName(batches.select("at", F.lit(None).cast(consumers.schema["consumer"].dataType).alias("consumer"), F.lit(1).alias("batch")))
    dealt = cut(rows.repartitionByRange(F.desc("at")).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.sum("batch").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("batch").over(Window.partitionBy("part").orderBy(F.desc("at"), "batch").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = dealt.withColumn("inside", inside).join(F.broadcast(before), "part")
    out = counted.where("batch = 0").select("consumer", (F.col("inside") + F.col("before")).alias("missed"))
    return out.where("missed > 0")
