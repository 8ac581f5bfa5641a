"""The folder that driver and executors share: paths in it, and tables that are written once and read often."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not on their path, as when a script elsewhere imported it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a session on one machine (master ``local``) that has none gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


KEPT: dict[tuple[str, str, str], str] = {}


def kept(source: DataFrame, name: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``build(source)``, written once for a session and the files of ``source`` as they are, by path, length and time of change.

    Another query over the same files reads what the first has written; changed files are built anew.
    """
    spark, files = source.sparkSession, sorted(source.inputFiles())
    known = spark.read.format("binaryFile").load(files).select("path", "length", "modificationTime").collect() if files else []
    state = hashlib.sha256(repr((sorted(map(tuple, known)), source.schema.simpleString())).encode()).hexdigest()
    key = (spark.sparkContext.applicationId, name, state)
    if key not in KEPT:
        path = scratch(spark, name)
        build(source).write.option("compression", "zstd").parquet(path)
        KEPT[key] = path
    return spark.read.parquet(KEPT[key])
