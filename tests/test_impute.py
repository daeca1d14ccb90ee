"""Filling missing assay fields."""

import dataclasses

import numpy as np
from pyspark.sql import functions as F

from medlattice.functions.npx import GROUPS, usable_group, usable_npx
from medlattice.operators import impute

from .conftest import rows
from .test_core_problems import NPX, PANEL, PANELS, reading


def _frames(spark, data):
    return spark.createDataFrame(data, NPX), spark.createDataFrame(PANELS, PANEL)


def test_marks_and_valid_values(spark):
    data = [
        reading(1, "S1", "X1A", None), reading(2, "S1", "X2B", 6.0, assay=1, group=" CASE "), reading(3, "S1", "?", 5.0, group="n/a"), reading(4, "S2", None, float("nan"), "zz", 9, group=None),
        reading(5, None, "X1A", 9999.0, group=""), reading(6, "S3", "x1a", 4.0, group="Control"), reading(6, "S3", "x1a", 4.0, group="Control"), reading(7, "S4", None, 4.0, None, None),
    ]
    npx, panels = _frames(spark, data)
    filled = impute.fill(npx, panels)
    assert filled.columns == [*npx.columns, "npx_filled", "group_filled", "protein_filled"]
    got = filled.collect()
    assert len(got) == len(data)
    for r in got:
        assert -10 <= r["npx"] <= 25 and r["group"] in GROUPS and r["protein_id"] in ("X1A", "X2B") and r["own"] == "own"
    by = {r["row_id"]: r for r in got}
    assert by[3]["group"] == "case" and by[3]["protein_id"] == "X1A" and by[6]["group"] == "control" and not by[6]["npx_filled"]
    assert rows(impute.filled_fields(filled)) == sorted(
        [(1, "npx"), (3, "group"), (3, "protein_id"), (4, "group"), (4, "npx"), (4, "protein_id"), (5, "group"), (5, "npx"), (7, "protein_id")], key=repr
    )


def test_empty_tables(spark):
    npx, panels = _frames(spark, [reading(1, "S1", "X1A", None)])
    assert impute.fill(npx.where("false"), panels).count() == 0
    bare = impute.fill(npx, panels.where("false")).first()
    assert bare["npx"] is None and bare["protein_id"] is None and bare["npx_filled"] and bare["protein_filled"]


def test_held_out_readings(spark):
    """Filled readings come nearer to hidden ones than the mean of protein and arm: 0.81 against 0.84; arms are found again."""
    npx, panels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("olink_npx", "olink_panels"))
    turn = F.pmod(F.xxhash64("row_id"), F.lit(20))
    held = npx.select("*", F.when(turn == 0, usable_npx(F.col("npx"))).alias("_x"), F.when(turn == 1, usable_group(F.col("group"))).alias("_g"))
    held = held.withColumn("npx", F.when(F.col("_x").isNull(), F.col("npx"))).withColumn("group", F.when(F.col("_g").isNull(), F.col("group")))
    filled = impute.fill(held, panels).select("protein_id", "group", "npx", "npx_filled", "_x", "_g").toPandas()
    hidden = filled[filled["_x"].notna()]
    mean = filled[~filled["npx_filled"]].groupby(["protein_id", "group"])["npx"].mean().rename("mean")
    hidden = hidden.join(mean, on=["protein_id", "group"])
    root_of = lambda v: float(np.sqrt(((v - hidden["_x"]) ** 2).mean()))
    assert root_of(hidden["npx"]) < 0.82 < 0.83 < root_of(hidden["mean"])
    arms = filled[filled["_g"].notna()]
    assert (arms["group"] == arms["_g"]).mean() > 0.99


def test_hidden_error(spark):
    npx, panels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("olink_npx", "olink_panels"))
    got = {r["field_name"]: r for r in impute.hidden_error(npx, panels).collect()}
    assert set(got) == {"npx", "group"} and all(r["better"] and r["n_hidden"] > 100 for r in got.values())


def test_solve_samples_is_ridge_regression():
    rng = np.random.default_rng(1)
    rule = dataclasses.replace(impute.Rule(), rank=6, arm_weight=2.0)
    protein, arm = rng.normal(size=(4, 6)), rng.normal(size=(5, 6))
    f, z, w = np.array([[0, 2, 3]]), rng.normal(size=(1, 3)), np.array([[1.0, 1.0, 0.0]])
    arms = np.array([[0, 1.0, 0, 0, 0]])
    x = np.concatenate([protein[[0, 2]], np.sqrt(2.0) * arm, np.sqrt(rule.ridge_sample) * np.eye(6)])
    y = np.concatenate([z[0, :2], np.sqrt(2.0) * arms[0], np.zeros(6)])
    assert np.allclose(impute.solve_samples(f, z, w, arms, protein, arm, rule)[0][0], np.linalg.lstsq(x, y, rcond=None)[0])
