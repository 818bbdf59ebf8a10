"""Resumable pulls of readings from an external SQL database into a transactional table.

The checkpoint of a source is what its commits say: each window [since, until) is one transaction, named after the source and the
window, and the newest name tells where to go on. So the checkpoint moves with the rows or not at all: a pull
that dies between two windows, or inside one, goes on without loss or repeat.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantflow.sources.upsert import UpsertTable


def checkpoint(table: UpsertTable, source: str) -> datetime | None:
    """End of the last window that was committed for `source`."""
    names = table.log().where(F.col("batch").startswith(f"pull/{source}/"))
    last = names.agg(F.max(F.regexp_extract("batch", "([^/]*)$", 1))).first()[0]
    return datetime.fromisoformat(last) if last else None


def pull(table: UpsertTable, source: str, read: Callable[[datetime, datetime], DataFrame], now: datetime, backfill_s: float = 86_400, window_s: float = 3_600) -> int:
    """Take all windows up to `now`; returns how many distinct readings were written.

    `read(since, until)` gives rows (point, ts, value) of the half-open window, in any number of partitions. Without a
    checkpoint the pull begins `backfill_s` before `now`. A window holds at most `window_s`, so that what one
    transaction merges is bounded however long the source was away. Later reads of a row replace earlier ones.
    """
    since, written = checkpoint(table, source) or now - timedelta(seconds=backfill_s), 0
    while since < now:
        until = min(since + timedelta(seconds=window_s), now)
        point = F.concat(F.lit(f"urn:point:sql/{source}/"), F.col("point").cast("string"))
        order = F.lit(int((until - datetime(1970, 1, 1)).total_seconds())).cast("long")
        rows = read(since, until).where("point is not null and ts is not null")
        commit = table.merge(rows.select(point.alias("point_uri"), F.col("ts").cast("timestamp_ntz").alias("ts"), order.alias("seq"), F.col("value").cast("double").alias("value")), f"pull/{source}/{since.isoformat()}/{until.isoformat()}")
        written += commit.written if commit.applied else 0
        since = until
    return written


def jdbc_reader(spark: SparkSession, url: str, query: str, parts: int = 8, stamp: Callable[[datetime], str] = lambda t: f"TIMESTAMP('{t:%Y-%m-%d %H:%M:%S.%f}')", **properties: str) -> Callable[[datetime, datetime], DataFrame]:
    """A `read` for `pull`: `query` (point, ts, value) runs in the database once a partition, each for its own range of ts.

    Ranges are equal shares of the window, so the database does the cutting and no task reads another's rows.
    """

    def read(since: datetime, until: datetime) -> DataFrame:
        edges = [since + (until - since) * i / parts for i in range(parts)] + [until]
        ranges = [f"ts >= {stamp(a)} AND ts < {stamp(b)}" for a, b in zip(edges, edges[1:]) if a < b]
        return spark.read.jdbc(url, f"({query}) source_rows", predicates=ranges, properties=properties)

    return read
