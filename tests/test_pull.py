"""Pulls resume where the last commit ended, through a real JDBC database where there is one."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantflow.sources.pull import checkpoint, jdbc_reader, pull
from plantflow.sources.upsert import UpsertTable

T0 = datetime(2024, 1, 1)
SCHEMA = "point_uri string, ts timestamp_ntz, seq long, value double"
HOUR = timedelta(hours=1)


@pytest.fixture
def source(spark):
    rows = [(f"p{i % 3}", T0 + timedelta(minutes=10 * i), float(i)) for i in range(60)] + [(None, T0, 1.0)]
    return spark.createDataFrame(rows, "point string, ts timestamp_ntz, value double")


def test_pull_resumes_after_a_failure(spark, source, tmp_path):
    table, asked = UpsertTable(spark, str(tmp_path / "t"), SCHEMA), []

    def read(since, until):
        asked.append((since, until))
        if len(asked) == 4:
            raise RuntimeError("source is down")
        return source.where((F.col("ts") >= F.lit(since)) & (F.col("ts") < F.lit(until)))

    with pytest.raises(RuntimeError):
        pull(table, "db", read, T0 + 5 * HOUR, backfill_s=5 * 3600)
    assert checkpoint(table, "db") == T0 + 3 * HOUR and checkpoint(table, "other") is None
    assert pull(table, "db", read, T0 + 5.5 * HOUR) == 15
    assert asked[4:] == [(T0 + 3 * HOUR, T0 + 4 * HOUR), (T0 + 4 * HOUR, T0 + 5 * HOUR), (T0 + 5 * HOUR, T0 + 5.5 * HOUR)]
    assert pull(table, "db", read, T0 + 5.5 * HOUR) == 0 and len(asked) == 7
    got = {(r.point_uri, r.ts): r.value for r in table.snapshot().collect()}
    assert got == {(f"urn:point:sql/db/p{i % 3}", T0 + timedelta(minutes=10 * i)): float(i) for i in range(33)}
    assert pull(table, "second", read, T0 + HOUR, backfill_s=3600) == 6


def test_jdbc_reads_ranges_in_the_database(spark, source, tmp_path):
    url, driver = "jdbc:derby:memory:pull;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    source.where("point is not null").withColumn("ts", F.col("ts").cast("timestamp")).write.jdbc(url, "readings", mode="overwrite", properties={"driver": driver})
    read = jdbc_reader(spark, url, 'SELECT "point", "ts" AS ts, "value" FROM readings', parts=3, driver=driver)
    some = read(T0 + HOUR, T0 + 3 * HOUR)
    assert some.rdd.getNumPartitions() == 3 and some.count() == 12
    table = UpsertTable(spark, str(tmp_path / "t"), SCHEMA)
    assert pull(table, "derby", read, T0 + 10 * HOUR, backfill_s=10 * 3600, window_s=4 * 3600) == 60
    assert table.snapshot().agg(F.sum("value")).first()[0] == sum(range(60)) and table.log().count() == 3
