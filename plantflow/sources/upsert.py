"""Keyed upserts into Parquet, one transaction a batch.

A table is a folder: `data/version=N/day=D/bucket=B` holds what commit N wrote, `log/N.json` names
its parts. A commit rewrites only the parts (day and bucket of the key) that its rows fall in,
and becomes visible as a whole when its log entry is created; files of a writer that died
before are no part of any entry and are replaced when the batch runs again. An entry carries the
batch's name: a batch that has one is not applied twice, so a stream that replays is exactly once.

Rows are (key columns, order, others). Of rows with one key the largest order wins, inside a batch and
against what is stored, so late and repeated batches converge; equal orders are settled by the
largest row. A commit counts the distinct keys it wrote.

At scale: a batch reads and writes the parts it touches, never the table; parts are dealt to
tasks by hour as well, so a hot day is many files; without days, by a hash of the key. The driver handles part names only. Parts that
later commits replaced are removed by `vacuum`.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = ["day", "bucket"]
#: A part of a table without days is dealt to so many tasks at most.
SHARES = 32


@dataclass(frozen=True)
class Commit:
    version: int
    batch: str
    written: int
    applied: bool


class UpsertTable:
    """A table of `schema` (DDL) with the key columns `keys`; days come from the timestamp column `ts_col`, if any."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = ("point_uri", "ts"), order: str = "seq", ts_col: str | None = "ts", buckets: int = 16):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.order, self.ts_col, self.buckets = list(keys), order, ts_col, buckets

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def log(self) -> DataFrame:
        """(version, batch, written, parts) of all commits."""
        schema = "version long, batch string, written long, parts array<struct<day string, bucket int>>"
        fs, where = self._fs(f"{self.path}/log")
        if not fs.exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.path}/log")

    def _live(self) -> DataFrame:
        """(day, bucket, version): the newest committed version of each part."""
        parts = self.log().select("version", F.explode("parts").alias("p")).select("version", "p.*")
        return parts.groupBy(*PART).agg(F.max("version").alias("version"))

    def _read(self, live: list) -> DataFrame:
        if not live:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/data/version={r.version}/day={r.day}/bucket={r.bucket}" for r in live]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def snapshot(self) -> DataFrame:
        """All rows as of the last commit."""
        return self._read(self._live().collect())

    def _parted(self, rows: DataFrame) -> DataFrame:
        day = F.coalesce(F.date_format(self.ts_col, "yyyy-MM-dd"), F.lit("none")) if self.ts_col else F.lit("all")
        return rows.withColumns({"day": day, "bucket": F.pmod(F.xxhash64(self.keys[0]), F.lit(self.buckets)).cast("int")})

    def _newest(self, rows: DataFrame) -> DataFrame:
        """One row of each key: the largest order, then the largest row."""
        rest = [c for c in rows.columns if c not in self.keys]
        ranked = F.struct(self.order, *[c for c in rest if c != self.order])
        return rows.groupBy(*self.keys).agg(F.max(ranked).alias("r")).select(*self.keys, *(F.col(f"r.{c}").alias(c) for c in rest))

    def merge(self, rows: DataFrame, batch: str, then: Callable[[DataFrame, int], None] | None = None) -> Commit:
        """Apply a batch once. `then(rows, version)` may write more before the commit makes all visible."""
        log = self.log()
        done = log.where(F.col("batch") == batch).select("version", "written").first()
        if done is not None:
            return Commit(done.version, batch, done.written, False)
        version = (log.agg(F.max("version")).first()[0] or 0) + 1
        columns = self.spark.createDataFrame([], self.schema).columns
        fresh = self._parted(self._newest(rows.select(*columns))).persist()
        try:
            touched = fresh.groupBy(*PART).agg(F.count("*").alias("n")).collect()
            written = sum(r.n for r in touched)
            if touched:
                parts = self.spark.createDataFrame([(r.day, r.bucket) for r in touched], "day string, bucket int")
                stored = self._parted(self._read(self._live().join(parts, PART, "left_semi").collect()))
                merged = self._parted(self._newest(stored.unionByName(fresh).drop(*PART)))
                share = F.hour(self.ts_col) if self.ts_col else F.pmod(F.xxhash64(*self.keys, F.lit(1)), F.lit(SHARES))
                dealt = merged.repartition(*map(F.col, PART), share).sortWithinPartitions(*PART, *self.keys)
                dealt.write.mode("overwrite").partitionBy(*PART).parquet(f"{self.path}/data/version={version}")
            if then is not None:
                then(fresh.drop(*PART), version)
            self._commit(version, {"version": version, "batch": batch, "written": written, "parts": [{"day": r.day, "bucket": r.bucket} for r in touched]})
        finally:
            fresh.unpersist()
        return Commit(version, batch, written, True)

    def _commit(self, version: int, entry: dict) -> None:
        """Create the log entry; fails where another writer was faster, whose commit then stands."""
        fs, where = self._fs(f"{self.path}/log/{version:012d}.json")
        out = fs.create(where, False)
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()

    def vacuum(self) -> int:
        """Delete versions of parts that later commits replaced; returns how many."""
        fs, _ = self._fs(self.path)
        parts = self.log().select("version", F.explode("parts").alias("p")).select("version", "p.*")
        old = parts.join(self._live().withColumnRenamed("version", "newest"), PART).where("version < newest").collect()
        path = lambda r: self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/version={r.version}/day={r.day}/bucket={r.bucket}")
        return sum(bool(fs.delete(path(r), True)) for r in old)


def upsert_stream(rows: DataFrame, table: UpsertTable, name: str):
    """A stream writer that applies each micro-batch of `rows` to `table` once, also when it is replayed."""
    return rows.writeStream.foreachBatch(lambda batch, number: table.merge(batch, f"{name}/{number}") and None)
