"""Session helpers: the shared folder, cutting lineage in driver loops."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir; sets a folder of our own only where none is set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, spark.checkpoint.dir; where it is unset, one of our own if all run on this machine, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="fathomgrid-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder: the lineage ends there, and a lost executor costs nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def session(name: str = "fathomgrid", **conf: str) -> SparkSession:
    """A session as the engine likes it: adaptive execution, UTC."""
    b = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
