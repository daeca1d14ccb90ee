"""Normal forms of the assay table's fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The arms a sample can belong to.
GROUPS = ("baseline", "case", "control", "treated", "relapse")
#: All real readings lie between these.
NPX_LOW, NPX_HIGH = -10.0, 25.0


def usable_npx(value: Column) -> Column:
    """The reading, or NULL for a missing one, NaN, an infinity or a sentinel outside the physical range."""
    return F.when(~F.isnan(value) & value.between(NPX_LOW, NPX_HIGH), value)


def usable_group(value: Column) -> Column:
    bare = F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))
    return F.when(bare.isin(*GROUPS), bare)


def protein_key(value: Column) -> Column:
    """Upper-case letters and digits, without a ``prefix:``; looked up in the panel table afterwards."""
    return F.regexp_replace(F.upper(value), r"(?U)^\s*[A-Z]+:|[^A-Z0-9]", "")


def with_protein(df: DataFrame, panels: DataFrame, own: str = "protein_own", at: str = "protein_at") -> DataFrame:
    """Add the protein a row names itself (``own``) and the one its panel position fixes (``at``); NULL if none.

    ``panels`` is a catalogue of unique keys after the grouping; where it is small Spark broadcasts it, else it is shuffled.
    """
    names = panels.select(F.col("protein_id").alias(own), protein_key(F.col("protein_id")).alias("_key")).dropDuplicates(["_key"])
    places = panels.groupBy("panel", "assay_no").agg(F.min("protein_id").alias(at))
    return (
        df.withColumn("_key", protein_key(F.col("protein_id")))
        .join(names, "_key", "left")
        .drop("_key")
        .join(places, ["panel", "assay_no"], "left")
    )
