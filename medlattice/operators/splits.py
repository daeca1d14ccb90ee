"""Deterministic patient splits and balanced cohort selection."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The first 16 digits of the digest at which 60 and 80 per cent of the unit interval are reached.
VALIDATION_FROM, TEST_FROM = "9999999999999401", "cccccccccccccc00"
#: Ids that a driver-side shuffle may hold.
MAX_DRIVER_IDS = 1_000_000


def hash_split(patient: Column, seed: int = 0) -> Column:
    """train, validation or test (60/20/20) from the digest of ``seed:patient``."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), patient), 256), 1, 16)
    return F.when(patient.isNull(), None).when(digits < VALIDATION_FROM, "train").when(digits < TEST_FROM, "validation").otherwise("test")


def shuffled_split(ids: Sequence[str], positives: Mapping[str, set[str]], seed: int, least: int = 3, attempts: int = 1000) -> dict[str, str]:
    """60/20/20 by shuffling the sorted ids, tried again until each concept has enough cases and controls per split."""
    if len(ids) > MAX_DRIVER_IDS:
        raise ValueError("too many patients for a shuffled split; use hash_split")
    ordered = sorted(set(ids))
    a, b = int(0.6 * len(ordered)), int(0.8 * len(ordered))
    for attempt in range(attempts):
        mixed = ordered.copy()
        random.Random(seed + attempt).shuffle(mixed)
        parts = {"train": set(mixed[:a]), "validation": set(mixed[a:b]), "test": set(mixed[b:])}
        if all(len(part & case) >= least and len(part - case) >= least for case in positives.values() for part in parts.values()):
            return {p: name for name, part in parts.items() for p in part}
    raise ValueError("no split gives every concept enough cases and controls")


def ranked(df: DataFrame, groups: Sequence[str], digest: Column, *ties: str) -> DataFrame:
    """``rank`` from 1 by digest within the groups, without sorting a group in one task.

    The first digits of the digest cut a group into 4096 parts in order; a part's offset is the size of those before
    it, and rows are ranked within their part.
    """
    placed = df.withColumn("_digest", digest).withColumn("_part", F.substring("_digest", 1, 3))
    sizes = placed.groupBy(*groups, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*groups, "_part", F.coalesce(before, F.lit(0)).alias("_offset"))
    inner = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy("_digest", *ties))
    return placed.withColumn("_inner", inner).join(offsets, [*groups, "_part"]).withColumn("rank", F.col("_inner") + F.col("_offset")).drop("_digest", "_part", "_inner", "_offset")


def stratified_split(df: DataFrame, stratum: str, key: str, seed: int = 0) -> DataFrame:
    """60/20/20 within every stratum, at least one train and one validation id each; in the order of a hash."""
    ids = df.select(stratum, key).distinct()
    sizes = ids.groupBy(stratum).agg(F.count("*").alias("_size"))
    made = ranked(ids, [stratum], F.sha2(F.concat_ws(":", F.lit(str(seed)), key), 256), key).join(sizes, stratum)
    train, validation = F.greatest(F.lit(1), F.floor(F.col("_size") * 0.6)), F.greatest(F.lit(1), F.floor(F.col("_size") * 0.2))
    split = F.when(F.col("rank") <= train, "train").when(F.col("rank") <= train + validation, "validation").otherwise("test")
    return made.select(stratum, key, split.alias("split"))


def balanced_cohort(labels: DataFrame, controls_per_case: float = 1.0, fraction: float = 1.0, least: int = 3, seed: int = 0) -> DataFrame:
    """(concept_id, split, patient_id, positive): as many cases as controls per concept and split.

    Of the n rarer ones max(least, n * fraction) are taken at most, in the order of a hash.
    """
    who = ["concept_id", "split"]
    counts = labels.groupBy(*who).agg(F.count_if("positive").alias("cases"), F.count_if(~F.col("positive")).alias("controls"))
    take = F.least("cases", F.floor(F.col("controls") / controls_per_case), F.greatest(F.lit(least), F.floor(F.least("cases", "controls") * fraction)))
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit("cohort"), "concept_id", "patient_id"), 256)
    placed = ranked(labels, [*who, "positive"], digest, "patient_id").join(counts.withColumn("take", take).select(*who, "take"), who)
    return placed.where("rank <= take").select(*who, "patient_id", "positive")
