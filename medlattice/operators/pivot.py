"""Attribute-value rows into wide tables, by blocks of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.npx import usable_npx, with_protein
from ..session import cut, tasks_for

#: Attributes a wide table may have; their names travel in the plan.
MAX_ATTRIBUTES = 20_000


def attribute_list(df: DataFrame, column: str, limit: int = MAX_ATTRIBUTES) -> list[str]:
    """The distinct values that become columns, sorted; an error beyond ``limit`` rather than a cut list."""
    names = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"more than {limit} attributes in {column}: keep the table long or raise the limit")
    return sorted(names)


def block_pivot(
    cells: DataFrame,
    entity: str,
    attribute: str,
    values: dict[str, str],
    attributes: Sequence[str],
    block: int = 64,
    buckets: int | None = None,
) -> DataFrame:
    """One row per entity with a column per attribute and value, from cells that are unique per (entity, attribute).

    ``values`` maps a value column to the pattern of its wide columns (``"{}"`` is the attribute).  The cells are
    written once in a folder per block of attributes; each block is hashed by entity into the same buckets and pivoted
    in them, and the blocks are joined bucket by bucket, so every cell is moved once and no block again.  An entity
    keeps at most one cell per attribute, which bounds what any task gathers for it.  Entities without a listed
    attribute stay, with NULLs; a NULL entity is left out.
    """
    spark = cells.sparkSession
    n = buckets or tasks_for(spark)
    place = spark.createDataFrame([(a, i // block) for i, a in enumerate(attributes)], f"{attribute} string, _block int")
    given = cells.select(entity, attribute, *values).where(F.col(entity).isNotNull())
    placed = cut(given.join(F.broadcast(place), attribute, "left"), "_block")
    wide = placed.select(entity).repartition(n, entity).dropDuplicates()
    for k in range(-(-len(attributes) // block)):
        names = list(attributes[k * block : (k + 1) * block])
        bucketed = placed.where(F.col("_block") == k).drop("_block").repartition(n, entity)
        made = bucketed.groupBy(entity).pivot(attribute, names).agg(*[F.max(value).alias(value) for value in values])
        made = made.toDF(entity, *[pattern.format(name) for name in names for pattern in values.values()])
        wide = wide.join(made, entity, "left")
    return wide


def melt(wide: DataFrame, entity: str, columns: dict[str, str], attribute: str, value: str) -> DataFrame:
    """The non-null cells of a wide table as rows; ``columns`` maps a column to the attribute's name."""
    pairs = F.array(*[F.struct(F.lit(name).alias(attribute), F.col(f"`{column}`").alias(value)) for column, name in columns.items()])
    kept = F.filter(pairs, lambda x: x[value].isNotNull())
    return wide.select(entity, F.inline(kept))


def _spread_beyond(tolerance: float) -> Column:
    return F.round(F.col("high") - F.col("low"), 6) > tolerance


def agreed_cells(npx: DataFrame, panels: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(sample_id, protein_id, npx, n_readings, spread): one reading per cell of the assay table.

    The agreed reading is the usable one without a QC warning before those with one, then the last measured, the last
    loaded and the highest ``row_id``.  ``spread`` is largest less smallest usable reading where that exceeds
    ``tolerance``, else NULL.  A row whose own protein is missing counts for the protein of its panel position; rows
    with no usable reading, protein or sample are left out.
    """
    read = (
        with_protein(npx.select("sample_id", "protein_id", "panel", "assay_no", "npx", "qc_warning", "measured_at", "loaded_at", "row_id"), panels)
        .select(
            "sample_id",
            F.coalesce("protein_own", "protein_at").alias("protein_id"),
            usable_npx(F.col("npx")).alias("npx"),
            F.struct(
                (~F.coalesce(F.col("qc_warning"), F.lit(False))).alias("clean"), "measured_at", "loaded_at", "row_id"
            ).alias("rank"),
        )
        .where("npx is not null and protein_id is not null and sample_id is not null")
    )
    return (
        read.groupBy("sample_id", "protein_id")
        .agg(F.max_by("npx", "rank").alias("npx"), F.count("*").alias("n_readings"), F.min("npx").alias("low"), F.max("npx").alias("high"))
        .select("sample_id", "protein_id", "npx", "n_readings", F.when(_spread_beyond(tolerance), F.col("high") - F.col("low")).alias("spread"))
    )


def wide_npx(npx: DataFrame, panels: DataFrame, block: int = 64) -> DataFrame:
    """One row per sample with a double column per protein of the catalogue."""
    return block_pivot(agreed_cells(npx, panels), "sample_id", "protein_id", {"npx": "{}"}, attribute_list(panels, "protein_id"), block)


def conflicting_cells(npx: DataFrame, panels: DataFrame, tolerance: float = 0.01, block: int = 64) -> DataFrame:
    """(sample_id, protein_id) of the cells whose readings disagree, read off a block pivot of the spreads."""
    names = attribute_list(panels, "protein_id")
    wide = block_pivot(agreed_cells(npx, panels, tolerance), "sample_id", "protein_id", {"spread": "{}"}, names, block)
    return melt(wide, "sample_id", {n: n for n in names}, "protein_id", "spread").select("sample_id", "protein_id")
