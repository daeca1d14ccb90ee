"""Mergeable percentiles with a guaranteed relative error, from signed logarithmic buckets."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.npx import usable_group, usable_npx, with_protein
from ..session import cut

#: Magnitudes below this share the bucket of zero; their error is this much instead of relative.
SMALLEST = 1e-9


def _shape(error: float) -> tuple[float, int]:
    """log(gamma), and the offset that makes bucket numbers of positive values positive."""
    if not 0 < error < 1:
        raise ValueError("the relative error lies between 0 and 1")
    width = math.log((1 + error) / (1 - error))
    return width, 1 - math.ceil(math.log(SMALLEST) / width)


def bucket_of(value: Column, error: float) -> Column:
    """The bucket number, ordered like the values: negative, 0 (for magnitudes under SMALLEST) or positive."""
    width, offset = _shape(error)
    number = (F.ceil(F.log(F.abs(value)) / F.lit(width)) + offset).cast("int")
    return F.when(F.abs(value) < SMALLEST, 0).otherwise(F.signum(value).cast("int") * number)


def value_of(bucket: Column, error: float) -> Column:
    """The value that differs from each value of the bucket by at most ``error`` of that value."""
    width, offset = _shape(error)
    middle = F.exp((F.abs(bucket) - offset) * F.lit(width)) * F.lit(1 - error)
    return F.when(bucket == 0, 0.0).otherwise(F.signum(bucket.cast("double")) * middle)


def sketch(df: DataFrame, by: Sequence[str], value: str, error: float = 0.005) -> DataFrame:
    """(by..., bucket, n): the sketch of each group, as rows.

    NULL, NaN and infinite values are not counted.  A hot group is combined before the shuffle: what leaves a task is
    one count per bucket, and there are at most ``2 * log(largest / SMALLEST) / log(gamma)`` of them.
    """
    usable = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf"))
    return df.where(usable).groupBy(*by, bucket_of(F.col(value), error).alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """Sketches of days or partitions added up into those of ``by``; exact, in any order."""
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, by: Sequence[str], points: Sequence[float], error: float = 0.005) -> DataFrame:
    """One row per group: n_values and p05-like columns, the value of rank floor(q * (n - 1)), off by ``error`` at most.

    The running count goes over the buckets of a group, whose number is bounded, never over its values.
    """
    w = Window.partitionBy(*by).orderBy("bucket")
    running = sketches.withColumn("upto", F.sum("n").over(w)).withColumn("whole", F.sum("n").over(Window.partitionBy(*by)))
    picks = [
        value_of(F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("whole") - 1)), F.col("bucket"))), error).alias(name_of(q))
        for q in points
    ]
    return running.groupBy(*by).agg(F.max("whole").alias("n_values"), *picks)


def name_of(q: float) -> str:
    """p05, p50, p99_9."""
    return "p" + f"{round(q * 100, 6):g}".replace(".", "_").zfill(2)


def npx_days(npx: DataFrame, panels: DataFrame, error: float = 0.005) -> DataFrame:
    """(protein_id, arm, day, bucket, n): the usable readings of single days of ``measured_at``.

    A reading whose own protein is missing counts for the protein of its panel position.  ``arm`` is the plain group
    and NULL where it is missing.  Every delivered row counts.
    """
    needed = npx.select("protein_id", "panel", "assay_no", "group", "measured_at", "npx")
    rows = with_protein(needed, panels).select(
        F.coalesce("protein_own", "protein_at").alias("protein_id"),
        usable_group(F.col("group")).alias("arm"),
        F.to_date("measured_at").alias("day"),
        usable_npx(F.col("npx")).alias("npx"),
    )
    return sketch(rows.where("protein_id is not null"), ["protein_id", "arm", "day"], "npx", error)


DAYS = "protein_id string, arm string, day date, bucket int, n long"


def keep_days(path: str, npx: DataFrame, panels: DataFrame, error: float = 0.005, batch: int = 0) -> DataFrame:
    """Take delivered readings into the kept day sketches of a path in the shared file system, and read all of them back.

    Every delivery has a number and a folder; as counts add up, earlier deliveries are not read again, and a delivery that
    failed or is repeated replaces its own folder.  The error is part of the path, as sketches of another one do not add up.
    """
    folder = f"{path}/error-{error:g}"
    npx_days(npx, panels, error).select(*[c.split()[0] for c in DAYS.split(", ")]).write.mode("overwrite").parquet(f"{folder}/batch-{batch:08d}")
    return npx.sparkSession.read.schema(DAYS).option("recursiveFileLookup", True).parquet(folder)


def npx_percentiles(days: DataFrame, period: Column | None = None, points: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95), error: float = 0.005) -> DataFrame:
    """Percentiles per protein (scope ``protein``) and per protein and arm (scope ``protein_group``), over ``period``.

    Both come from one merge of the day sketches; rows with a missing arm count for the protein only.
    """
    period = F.lit("all") if period is None else period
    arms = cut(merge(days.withColumn("period", period), ["protein_id", "arm", "period"]))  # read by both scopes
    whole = merge(arms, ["protein_id", "period"]).withColumn("arm", F.lit(None).cast("string")).withColumn("scope", F.lit("protein"))
    parts = arms.where("arm is not null").withColumn("scope", F.lit("protein_group"))
    made = percentiles(whole.unionByName(parts), ["scope", "protein_id", "arm", "period"], points, error)
    return made.withColumnRenamed("arm", "group").withColumn("relative_error", F.lit(error))
