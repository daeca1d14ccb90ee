"""Per-entity feature tables from events, kept as time-bucketed partial aggregates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import canonical_id
from ..session import cut, drop_cut, file_system, state_folder
from .pivot import attribute_list, block_pivot

#: Days outside these are typing errors, not history.
FIRST_DAY, LAST_DAY = date(1901, 1, 1), date(2098, 12, 31)
#: Length of a time bucket, as date_trunc names it; there are at most 198 of a year.
BUCKET = "year"


def plain_code(value: Column) -> Column:
    """A code without ``system:`` prefix and white space; NULL where nothing is left."""
    bare = F.regexp_replace(F.upper(value), r"^\s*[A-Z]+:|\s", "")
    return F.when(F.length(bare) > 0, bare)


def entries(conditions: DataFrame) -> DataFrame:
    """(patient, code, start, stop, encounter): each entry once, however often and in whatever spelling it was delivered.

    ``encounter`` is a hash that tells entries apart.  An entry is its patient, encounter, code, START and STOP.  Rows without a patient id, a code or a START between
    FIRST_DAY and LAST_DAY are no events.  A STOP that is absurd counts as open, one before START as START.
    """
    return _delivered(conditions).distinct()


def _delivered(conditions: DataFrame) -> DataFrame:
    """The rows of entries as often as they were delivered."""
    start, stop = F.col("START").cast("date"), F.col("STOP").cast("date")
    sane = lambda c: c.between(F.lit(FIRST_DAY), F.lit(LAST_DAY))
    return (
        conditions.select(
            F.unhex(canonical_id("PATIENT")).alias("patient"),
            F.coalesce(canonical_id("ENCOUNTER"), F.lower(F.trim("ENCOUNTER")), F.lit("")).alias("encounter"),
            plain_code(F.col("CODE")).alias("code"),
            start.alias("start"),
            F.when(sane(stop), F.greatest(stop, start)).alias("stop"),
        )
        .where(F.col("patient").isNotNull() & F.col("code").isNotNull() & sane(F.col("start")))
        .select("patient", "code", "start", "stop", F.xxhash64("encounter").alias("encounter"))
    )


def _bucket(day: Column) -> Column:
    return F.date_trunc(BUCKET, day).cast("date")


def bucket_partials(events: DataFrame) -> DataFrame:
    """Mergeable partials per patient, code, bucket of START and bucket of STOP.

    Counts and sums of days (since 1970) add up over any set of buckets, so the features of a later day need the
    partials only, but for the entries that begin or end in that day's own bucket.
    """
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date")).cast("bigint")
    return (
        events.groupBy("patient", "code", _bucket(F.col("start")).alias("start_bucket"), _bucket(F.col("stop")).alias("stop_bucket"))
        .agg(
            F.count("*").alias("n"),
            F.max("start").alias("last_start"),
            F.sum(day("start")).alias("start_days"),
            F.sum(day("stop")).alias("stop_days"),
        )
    )


def long_features(partials: DataFrame, events: DataFrame, as_of: date) -> DataFrame:
    """(patient, code, n, recency_days, total_days) as of the end of a day.

    Whole buckets before that day's come from the partials; entries that begin or end in it are boundary events and
    looked at one by one.  An entry open on the day counts up to it.
    """
    today, bucket = F.lit(as_of), _bucket(F.lit(as_of))
    today_number = F.datediff(today, F.lit("1970-01-01").cast("date")).cast("bigint")
    boundary_stop = F.coalesce(F.col("stop_bucket") == bucket, F.lit(False))
    whole = partials.where((F.col("start_bucket") < bucket) & ~boundary_stop).select(
        "patient",
        "code",
        "n",
        "last_start",
        (F.when(F.coalesce(F.col("stop_bucket") < bucket, F.lit(False)), F.col("stop_days")).otherwise(F.col("n") * today_number) - F.col("start_days")).alias("days"),
    )
    edge = events.where(
        (F.col("start") <= today)
        & ((_bucket(F.col("start")) == bucket) | F.coalesce(_bucket(F.col("stop")) == bucket, F.lit(False)))
    ).select(
        "patient",
        "code",
        F.lit(1).cast("bigint").alias("n"),
        F.col("start").alias("last_start"),
        F.datediff(F.least(F.col("stop"), today), F.col("start")).cast("bigint").alias("days"),
    )
    return (
        whole.unionByName(edge)
        .groupBy("patient", "code")
        .agg(
            F.sum("n").alias("n"),
            F.datediff(today, F.max("last_start")).cast("bigint").alias("recency_days"),
            F.sum("days").alias("total_days"),
        )
    )


def feature_table(conditions: DataFrame, as_of: date, block: int = 96, store: str | None = None) -> DataFrame:
    """One row per patient: n_CODE, recency_CODE and days_CODE for every code of the table.

    The rows are taken into the store first (a new one where none is named), and the features come from there.  Counts
    and days of a code that a patient never had are 0, the recency NULL.  The patient is the plain 32-digit id.  Codes
    are those of the entries, whatever their day.
    """
    partials, events = update_store(store or state_folder(conditions.sparkSession, "features"), conditions)
    codes = attribute_list(partials, "code")
    cells = long_features(partials, events, as_of)
    wide = block_pivot(cells, "patient", "code", {"n": "n_{}", "recency_days": "recency_{}", "total_days": "days_{}"}, codes, block)
    zeros = [c for c in wide.columns[1:] if not c.startswith("recency_")]
    named = wide.na.fill(0, subset=[f"`{c}`" if "." in c else c for c in zeros]) if zeros else wide
    return named.withColumn("patient", F.lower(F.hex("patient"))).withColumnRenamed("patient", "PATIENT")


ENTRIES = "patient binary, code string, start date, stop date, encounter long, start_bucket date"
PARTIALS = "patient binary, code string, stop_bucket date, n long, last_start date, start_days long, stop_days long, start_bucket date"


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(partials, entries) of a store."""
    return spark.read.schema(PARTIALS).parquet(f"{path}/partials"), _stored_entries(spark, path)


def _stored_entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRIES).parquet(f"{path}/entries")


def update_store(path: str, conditions: DataFrame, rows_a_file: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """Take delivered rows into the store of a path in the shared file system; (partials, entries) as they are then.

    Entries and partials lie in a folder per bucket of START.  Only the buckets that the new rows touch are read, put
    together with the new rows, computed and replaced; late copies of known entries change nothing, and a delivery that
    failed half-way is simply repeated.  Within a bucket rows are dealt out by their hash, so neither a hot patient nor
    a hot bucket is one task's.
    """
    spark = conditions.sparkSession
    fs, folder = file_system(spark, f"{path}/partials")
    there = fs.exists(folder)
    parts = max(1, conditions.count() // rows_a_file)

    def placed(df: DataFrame) -> DataFrame:
        made = df.withColumn("start_bucket", _bucket(F.col("start"))) if "start_bucket" not in df.columns else df
        return made.withColumn("part", F.pmod(F.xxhash64("patient", "code", "start"), F.lit(parts)))

    new = placed(_delivered(conditions))
    if there:
        new = cut(new)
        changed = [r[0] for r in new.select("start_bucket").distinct().collect()]  # at most LAST_DAY - FIRST_DAY
        known = _stored_entries(spark, path).where(F.col("start_bucket").isin(changed) if changed else F.lit(False))
        both = new.unionByName(placed(known))
    else:
        changed, both = None, new
    merged = both.repartition("start_bucket", "part").dropDuplicates(["start_bucket", "part", "patient", "code", "start", "stop", "encounter"]).drop("part")

    def write(df: DataFrame, name: str) -> None:
        df.write.partitionBy("start_bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{name}")

    if there:
        merged = cut(merged)
    write(merged, "entries")
    source = _stored_entries(spark, path) if changed is None else merged
    counted = bucket_partials(source).withColumn("part", F.pmod(F.xxhash64("patient"), F.lit(parts)))
    write(counted.repartition("start_bucket", "part").drop("part"), "partials")
    if there:
        drop_cut(new)
        drop_cut(merged)
    return read_store(spark, path)
