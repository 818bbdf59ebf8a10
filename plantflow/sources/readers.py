"""Readers for readings and records in files, tables and streams. Schemas are explicit, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READING = "topic string, ts timestamp, value string, unit string, label string, flags array<string>, reliability string"


def _typed(raw: DataFrame) -> DataFrame:
    """Typed value columns of raw readings: booleans and binary states before numbers, then text."""
    word = F.lower("value")
    boolean = F.when(word.isin("true", "active"), True).when(word.isin("false", "inactive"), False)
    number = F.when(boolean.isNull(), F.col("value").try_cast("double"))
    from plantflow.operators.quality import from_envelope

    return raw.where("topic is not null").select(
        F.concat(F.lit("urn:point:"), "topic").alias("point_uri"),
        F.coalesce("ts", F.current_timestamp()).cast("timestamp_ntz").alias("ts"),
        number.alias("value"),
        F.when(boolean.isNull() & number.isNull(), F.col("value")).alias("value_text"),
        boolean.alias("value_bool"),
        "unit",
        "label",
        from_envelope(F.col("flags"), F.col("reliability")).alias("quality"),
    )


def readings_json(spark: SparkSession, path: str) -> DataFrame:
    """Pushed readings, one JSON object a line; lines that aren't objects with a topic are dropped."""
    return _typed(spark.read.schema(READING).option("mode", "PERMISSIVE").json(path))


def readings_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The same as a stream of files, bounded per micro-batch."""
    return _typed(spark.readStream.schema(READING).option("maxFilesPerTrigger", files_per_batch).json(path))


def readings_kafka(spark: SparkSession, servers: str, topic: str, per_batch: int = 100_000) -> DataFrame:
    """The same from a log of messages; needs Spark's connector package on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", per_batch).load()
    return _typed(raw.select(F.from_json(F.col("value").cast("string"), READING).alias("r")).select("r.*"))


def sql_pull(spark: SparkSession, url: str, query: str, since: str, until: str, **options: str) -> DataFrame:
    """Rows of an external query in [since, until); the caller keeps the checkpoint."""
    text = query.replace(":since", f"'{since}'").replace(":until", f"'{until}'")
    return spark.read.format("jdbc").options(url=url, query=text, **options).load()


def records_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records with one column a tag; blanks are missing tags."""
    rows = spark.read.schema(schema).option("header", "true").option("nullValue", "").csv(path)
    return rows


def record_triples(records: DataFrame, id_col: str = "id") -> DataFrame:
    """(s, p, o) of wide records; missing tags give no row, a check mark is a marker."""
    names = [c for c in records.columns if c != id_col]
    pairs = F.array(*(F.struct(F.lit(c).alias("p"), F.col(c).cast("string").alias("o")) for c in names))
    return records.select(F.col(id_col).alias("s"), F.inline(pairs)).where("o is not null")


def write_records(records: DataFrame, path: str, kind: str = "json") -> None:
    records.write.option("compression", "gzip").format(kind).save(path)


TASK = """UID string, ID string, WBS string, Name string, Start string, Finish string, ActualStart string, ActualFinish string,
    PercentComplete double, Milestone string, Summary string, IsNull string, PredecessorLink array<struct<PredecessorUID: string>>"""


def tasks_xml(spark: SparkSession, path: str) -> DataFrame:
    """Activities of project files in XML: (file, code, name, wbs, dates, percent, milestone, summary, predecessors).

    Predecessors are given by code. Blank tasks and each project's own summary task, number 0, are left out.
    """
    raw = spark.read.format("xml").option("rowTag", "Task").schema(TASK).load(path)
    tasks = raw.withColumn("file", F.col("_metadata.file_path")).withColumn("code", F.coalesce("WBS", "ID", "UID"))
    links = tasks.select("file", F.col("UID").alias("uid"), F.posexplode("PredecessorLink").alias("at", "link"))
    codes = tasks.select("file", F.col("UID").alias("before"), F.col("code").alias("before_code"))
    found = links.select("file", "uid", "at", F.col("link.PredecessorUID").alias("before")).join(codes, ["file", "before"])
    before = found.groupBy("file", "uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "before_code"))), lambda x: x["before_code"]).alias("predecessors"))
    day = lambda c: F.to_date(F.substring(c, 1, 10)).alias(f"{c[0].lower()}{c[1:]}")
    real = tasks.where("coalesce(IsNull, '0') <> '1' and coalesce(UID, '') <> '0'").withColumn("uid", F.col("UID"))
    return real.join(before, ["file", "uid"], "left").select(
        "file", "code", F.trim(F.coalesce("Name", F.lit(""))).alias("name"), F.col("WBS").alias("wbs"), day("Start"), day("Finish"), day("ActualStart"), day("ActualFinish"),
        F.col("PercentComplete").alias("percent"), (F.coalesce("Milestone", F.lit("0")) == "1").alias("milestone"), (F.coalesce("Summary", F.lit("0")) == "1").alias("summary"),
        F.coalesce("predecessors", F.array().cast("array<string>")).alias("predecessors"),
    )
