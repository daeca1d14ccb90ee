"""Flat event streams in shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, subject_ids: Sequence | None = None) -> DataFrame:
    """All shards of ``folder/data``, of the given subjects only, ordered by subject and time.

    Ids are compared in the column's own type, so the list is pushed into the scan.  A missing folder or one without
    shards is an error.
    """
    path = f"{folder.rstrip('/')}/data"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        raise FileNotFoundError(path)
    if not fs.globStatus(jvm.org.apache.hadoop.fs.Path(path + "/*.parquet")):
        raise FileNotFoundError(f"no shards in {path}")
    return select_subjects(spark.read.parquet(f"{path}/*.parquet"), subject_ids).orderBy("subject_id", "time")


def select_subjects(events: DataFrame, subject_ids: Sequence | None) -> DataFrame:
    if subject_ids is None:
        return events
    kind = dict(events.dtypes)["subject_id"]
    wanted = [str(s) if kind == "string" else int(s) for s in subject_ids]
    return events.where(F.col("subject_id").isin(wanted)) if wanted else events.where(F.lit(False))


def write_events(events: DataFrame, folder: str, shards: int = 16, mode: str = "errorifexists") -> None:
    """Shards by hash of the subject, each ordered by subject and time."""
    events.repartition(shards, "subject_id").sortWithinPartitions("subject_id", "time").write.mode(mode).parquet(f"{folder.rstrip('/')}/data")
