"""Parquet tables the operators write, and the raw message sources they read.

Every table has one layout for batch jobs and streams: below the day, if it has one, stands
the *write* that its rows came with, so a write that is repeated replaces its own rows and
nobody else's, and any number of writers append at once.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlake.operators.summary import newest_of_log
from roadlake.schemas import DAILY_SUMMARY, RAW_MESSAGE, SUMMARY_COLUMNS
from roadlake.session import pin

#: Partition column that names the write.
WRITE = "write"
QUERY_ID = "sql.streaming.queryId"


def one_write() -> str:
    """The identity of a write of its own."""
    return f"w-{uuid.uuid4().hex}"


def write_of_batch(batch: DataFrame, batch_id: int) -> str:
    """The identity of a micro-batch: the same when it is repeated.

    A query keeps its id as long as its checkpoint; one with a new checkpoint has another.
    """
    query = batch.sparkSession.sparkContext.getLocalProperty(QUERY_ID)
    if query is None:
        raise RuntimeError("this is no micro-batch of a running query")
    return f"q-{query}-{batch_id}"


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Raw messages, one JSON object per line."""
    return spark.read.schema(RAW_MESSAGE).json(path)


def stream_messages(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(RAW_MESSAGE)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
    )


def append(
    df: DataFrame,
    path: str,
    day: str | None = None,
    name: str = "event_date",
    write: str | None = None,
    order: tuple[str, ...] = (),
) -> None:
    """Append, partitioned by the day of column ``day`` if given, then by the write.

    Rebalancing gathers each day into files of a sensible size and splits days
    that are too large for one task. Files are sorted by ``order``, so that the
    statistics of their row groups rule most of them out for one key.
    """
    rows, parts = df.withColumn(WRITE, F.lit(write or one_write())), [WRITE]
    if day is None:
        rows = rows.hint("rebalance")
    else:
        rows = rows.withColumn(name, F.to_date(day)).hint("rebalance", name)
        parts = [name, WRITE]
    if order:
        rows = rows.sortWithinPartitions(*parts, *order)
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*parts)
        .parquet(path)
    )


def append_gps_events(events: DataFrame, path: str, write: str | None = None) -> None:
    append(events, path, day="timestamp", write=write, order=("device_id", "timestamp"))


def append_faults(faults: DataFrame, path: str, write: str | None = None) -> None:
    append(faults, path, day="timestamp", write=write, order=("device_id", "timestamp"))


def append_idling(episodes: DataFrame, path: str, write: str | None = None) -> None:
    append(episodes.drop("date"), path, day="start_time", name="date", write=write)


def append_notifications(notifications: DataFrame, path: str, write: str | None = None) -> None:
    append(notifications, path, write=write)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(WRITE)


def read_days(path: str, like: DataFrame) -> DataFrame:
    """A table appended by day, with the columns of ``like``; it may have no rows yet."""
    schema = T.StructType([*like.schema.fields, T.StructField("event_date", T.DateType())])
    return like.sparkSession.read.schema(schema).parquet(path).drop(WRITE)


def read_writes(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A table with the columns of ``like`` and the write of each row; it need not be there yet."""
    return _stored(spark, path, T.StructType([*like.schema.fields, T.StructField(WRITE, T.StringType())]))


# Daily summaries: a log of versions, and days into which it is folded now and then.

LOG = T.StructType(
    [*DAILY_SUMMARY.fields, T.StructField("version", T.LongType()), T.StructField("hour", T.LongType())]
)
BASE = T.StructType(LOG.fields[:-1])
FOLDED = T.StructType([T.StructField("upto", T.LongType())])
HOUR_NANOS = 3600 * 10**9


def upsert_summary(fresh: DataFrame, path: str, write: str | None = None) -> None:
    """Upsert (vehicle, day) rows into the table at ``path``.

    Rows are appended with a version, nothing is read or rewritten, so a flush writes as much
    as has changed and writers need not know of each other. The newest version counts.
    """
    version = time.time_ns()
    rows = fresh.select(
        *SUMMARY_COLUMNS, F.lit(version).alias("version"), F.lit(version // HOUR_NANOS).alias("hour")
    ).withColumn(WRITE, F.lit(write or one_write()))
    (
        rows.hint("rebalance", "summary_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("hour", "summary_date", WRITE)
        .parquet(f"{path}/log")
    )


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a table, which need not be there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _folded_upto(spark: SparkSession, path: str) -> int:
    upto = _stored(spark, f"{path}/folded", FOLDED).agg(F.max("upto")).first()[0]
    return -1 if upto is None else upto


def _versions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The folded days, and the log since."""
    log = _stored(spark, f"{path}/log", LOG).where(F.col("hour") > _folded_upto(spark, path))
    return _stored(spark, f"{path}/base", BASE).select(*BASE.names), log.select(*LOG.names)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """One row per vehicle and day: its newest version, with the place it first started at."""
    base, log = _versions(spark, path)
    return newest_of_log(base.unionByName(log.drop("hour"))).select(*SUMMARY_COLUMNS)


def fold_summary(spark: SparkSession, path: str, before: dt.datetime | None = None) -> None:
    """Fold the log of all hours before ``before`` (an hour ago if not given) into days.

    Only days that the log touches are rewritten. Readers take what they see: as long as the
    last step is not done they have versions twice, which changes no result. So a fold that
    was lost is run again. Writers must not be slower than ``before`` allows. Folded hours of
    the log are not read again; the folder's retention may remove them.
    """
    moment = time.time_ns() - HOUR_NANOS if before is None else int(before.timestamp()) * 10**9
    upto = moment // HOUR_NANOS - 1
    base, log = _versions(spark, path)
    log = pin(log.where(F.col("hour") <= upto).drop("hour"), "log")
    if log.isEmpty():
        return
    days = log.select("summary_date").distinct()
    held = base.join(days, "summary_date", "left_semi")
    fresh = pin(newest_of_log(held.unionByName(log)).select(*BASE.names), "folded-days")
    (
        fresh.hint("rebalance", "summary_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("summary_date")
        .parquet(f"{path}/base")
    )
    spark.createDataFrame([(upto,)], FOLDED).coalesce(1).write.mode("append").parquet(f"{path}/folded")
