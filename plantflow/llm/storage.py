"""Shared scratch tables: lineage cuts that survive the loss of an executor.

Everything goes below `spark.checkpoint.dir`, which a cluster points at a folder
that the driver and all executors share. Where it is unset (tests, notebooks) a
temporary folder takes its place, which is right only for a local master.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_written: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name below the checkpoint folder that the cluster names."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-plantflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/plantflow-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write `df` as Parquet in shared scratch space and read it back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete what this session has materialized, once the results that read it are written."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        where = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unused(df: DataFrame, stem: str) -> str:
    """A column name like `stem` that no column of `df` has, whatever the case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of plans that Python no longer holds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
