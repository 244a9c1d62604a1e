"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(app: str = "roadlake", **extra: str) -> SparkSession:
    """A session with the settings above; master and memory come from the launcher."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_shared_dir(spark: SparkSession) -> None:
    """Name a folder of its own where a local session has none.

    All of a local session runs on this machine. A cluster has to name the folder
    that its executors share.
    """
    if spark.conf.get("spark.checkpoint.dir", None):
        return
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="roadlake-"))


def _shared_base(spark: SparkSession) -> str:
    """The folder that every executor can reach, named in ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return base.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{_shared_base(spark)}/roadlake/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as a table scan.

    Used where several later jobs read the same costly frame: the copy survives
    lost executors, and its parquet columns are pruned per reader.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
