"""Session defaults and table access shared by every query."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "plantflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, read through Spark so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint `df` in the shared folder that the cluster names, so that loops don't replay their past."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-plantflow-"))
    return df.checkpoint()


def ship(spark: SparkSession) -> None:
    """Make this library importable in the executors' Python, once per context.

    Nothing is sent where the workers find it anyway: on the PYTHONPATH that they inherit.
    """
    root, context = Path(__file__).resolve().parent.parent, spark.sparkContext
    paths = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(root) in paths or getattr(context, "_plantflow_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="plantflow-code-")) / "plantflow_code.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted((root / "plantflow").rglob("*.py")):
            out.write(file, file.relative_to(root))
    context.addPyFile(str(target))
    context._plantflow_shipped = True
