"""Missing assay fields filled from similar records by low-rank alternating least squares.

A record is a sample; its cells are the standardised readings of its proteins and the arms it was recorded under, as
0/1 cells.  Alternating ridge regressions give every sample and every protein or arm a short vector whose products
reproduce the cells.  Missing readings and arms are decoded from them to valid values, a missing protein from the
panel position, and every filled field is marked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.npx import GROUPS, NPX_HIGH, NPX_LOW, protein_key, usable_group, usable_npx
from ..session import cut, dimension

#: Proteins a catalogue may have: their vectors are solved on the driver and broadcast.
MAX_PROTEINS = 100_000


@dataclass(frozen=True)
class Rule:
    rank: int = len(GROUPS) + 1  #: length of the vectors; a dimension per arm and one for a sample's offset
    sweeps: int = 4  #: alternations
    ridge_sample: float = 0.85  #: pull of sample vectors towards 0: the noise of a standardised reading
    ridge_feature: float = 10.0  #: pull of protein and arm vectors towards 0, in cells
    own_weight: float = 0.75  #: how far a filled reading follows another reading of the same sample and protein
    arm_weight: float = 400.0  #: weight of an arm's cell against a reading's


@dataclass(frozen=True)
class Catalogue:
    """Proteins in order with location and scale, and the frames to look them up."""

    proteins: list[str]
    mean: np.ndarray
    sd: np.ndarray
    names: DataFrame
    places: DataFrame


def read_catalogue(panels: DataFrame) -> Catalogue:
    rows = (
        panels.where("protein_id is not null")
        .groupBy("protein_id")
        .agg(F.avg("mean").alias("m"), F.avg("sd").alias("s"))
        .orderBy("protein_id")
        .limit(MAX_PROTEINS + 1)
        .collect()
    )
    if len(rows) > MAX_PROTEINS:
        raise ValueError(f"more than {MAX_PROTEINS} proteins")
    spark = panels.sparkSession
    proteins = [r[0] for r in rows]
    number = spark.createDataFrame([(p, i) for i, p in enumerate(proteins)], "protein_id string, number int")
    names = number.select(protein_key(F.col("protein_id")).alias("_key"), F.col("number").alias("_own")).dropDuplicates(["_key"])
    places = (
        panels.join(dimension(number), "protein_id")
        .groupBy(F.col("panel").alias("_panel"), F.col("assay_no").alias("_assay"))
        .agg(F.min("number").alias("_at"))
    )
    middle = np.array([5.0 if r[1] is None else r[1] for r in rows] or [5.0], float)
    spread = np.array([r[2] if r[2] and r[2] > 0 else 1.0 for r in rows] or [1.0], float)
    return Catalogue(proteins, middle, spread, dimension(names), dimension(places))


def _literal(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def marked(npx: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Rows as a struct ``_row`` beside the usable content of their fields."""
    inner = npx.select(
        F.struct(*[F.col(f"`{c}`") for c in npx.columns]).alias("_row"),
        F.col("sample_id").alias("_sample"),
        F.col("panel").alias("_panel"),
        F.col("assay_no").alias("_assay"),
        usable_npx(F.col("npx")).alias("_npx"),
        usable_group(F.col("group")).alias("_group"),
        protein_key(F.col("protein_id")).alias("_key"),
    )
    found = inner.join(catalogue.names, "_key", "left").join(catalogue.places, ["_panel", "_assay"], "left").drop("_key")
    return found.withColumn("_p", F.coalesce("_own", "_at"))


def record_cells(rows: DataFrame, catalogue: Catalogue) -> DataFrame:
    """(sample, f, z, arms): one row per sample with its cells, at most one per protein.

    Readings are averaged per sample and protein before anything is gathered for a sample.
    """
    arms = [F.count_if(F.col("_group") == g).alias(f"_g{i}") for i, g in enumerate(GROUPS)]
    cells = rows.where("_sample is not null").groupBy(F.col("_sample").alias("sample"), F.col("_p").alias("p")).agg(F.avg("_npx").alias("x"), *arms)
    cell = F.when(F.col("p").isNotNull() & F.col("x").isNotNull(), F.struct("p", F.col("x").cast("float").alias("x")))
    return (
        cells.groupBy("sample")
        .agg(F.collect_list(cell).alias("c"), F.array(*[F.sum(f"_g{i}").cast("float") for i in range(len(GROUPS))]).alias("arms"))
        .select("sample", F.col("c.p").alias("f"), F.col("c.x").alias("x"), "arms")
    )


def _padded(batch: pa.RecordBatch, mean: np.ndarray, sd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Protein numbers, standardised readings and weights as matrices, and the share of each arm."""
    lists = batch.column("f")
    length = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(int)
    width = max(1, length.max(initial=0))
    f, z, w = np.zeros((len(length), width), int), np.zeros((len(length), width)), np.zeros((len(length), width))
    row = np.repeat(np.arange(len(length)), length)
    column = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    numbers = lists.flatten().to_numpy(zero_copy_only=False).astype(int)
    f[row, column] = numbers
    z[row, column] = np.clip((batch.column("x").flatten().to_numpy(zero_copy_only=False) - mean[numbers]) / sd[numbers], -6, 6)
    w[row, column] = 1.0
    arms = batch.column("arms").flatten().to_numpy(zero_copy_only=False).reshape(len(length), len(GROUPS)).astype(float)
    total = arms.sum(axis=1, keepdims=True)
    return f, z, w, np.where(total > 0, arms / np.maximum(total, 1), 0.0)


def solve_samples(f, z, w, arms, protein: np.ndarray, arm: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Ridge regression of every sample on the vectors of its cells, a batch at a time; and how sure each is."""
    v = protein[f] * w[:, :, None]
    gram = v.transpose(0, 2, 1) @ v + rule.ridge_sample * np.eye(rule.rank)
    right = np.einsum("nki,nk->ni", v, z)
    given = (arms.sum(axis=1) > 0) * rule.arm_weight
    gram += given[:, None, None] * (arm.T @ arm)
    right += given[:, None] * (arms @ arm)
    inverse = np.linalg.inv(gram)
    return np.einsum("nij,nj->ni", inverse, right), rule.ridge_sample * inverse


def factorise(cells: DataFrame, catalogue: Catalogue, rule: Rule = Rule()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of the proteins and of the arms, and the mean vector of the samples.

    A sweep solves the samples where they are and sends home one small Gram matrix per protein and task.
    """
    p, a, r = len(catalogue.mean), len(GROUPS), rule.rank  # an empty catalogue has one stand-in
    protein, arm = np.zeros((p, r)), np.zeros((a, r))
    protein[:, r - 1] = 0.15
    arm[:, :a] = np.eye(a)[:, : min(a, r)] if r >= a else np.eye(a, r)
    average = np.zeros(r)
    mean, sd = catalogue.mean, catalogue.sd
    size = r * r + r
    context = cells.sparkSession.sparkContext
    for _ in range(rule.sweeps):
        shared = context.broadcast((protein, arm))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vp, va = shared.value
            sums = np.zeros((p + a + 1, size))
            for batch in batches:
                if not batch.num_rows:
                    continue
                f, z, w, arms = _padded(batch, mean, sd)
                u, unsure = solve_samples(f, z, w, arms, vp, va, rule)
                # what the samples' vectors leave open counts too, else few cells a sample make the vectors too long
                outer = np.concatenate([(u[:, :, None] * u[:, None, :] + unsure).reshape(len(u), r * r), u], axis=1)
                row, column = np.nonzero(w)
                at = f[row, column]
                part = outer[row]
                part[:, r * r :] *= z[row, column][:, None]
                order = np.argsort(at, kind="stable")
                at, part = at[order], part[order]
                if len(at):
                    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                    sums[at[start]] += np.add.reduceat(part, start, axis=0)
                given = arms.sum(axis=1) > 0
                if given.any():
                    gram = outer[given, : r * r].sum(axis=0)
                    for k in range(a):
                        sums[p + k, : r * r] += gram
                        sums[p + k, r * r :] += (u[given] * arms[given, k : k + 1]).sum(axis=0)
                sums[p + a, : r] += u.sum(axis=0)
                sums[p + a, r] += len(u)
            used = np.flatnonzero(np.abs(sums).sum(axis=1))
            if len(used):
                lists = pa.FixedSizeListArray.from_arrays(pa.array(sums[used].ravel()), size).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(used.astype("int32")), lists], names=["f", "v"])

        got = np.zeros((p + a + 1, size))
        summed = cells.mapInArrow(work, "f int, v array<double>").groupBy("f").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(size)]).alias("v")).toArrow()
        got[summed.column("f").to_numpy()] = pa.compute.list_flatten(summed.column("v")).to_numpy().reshape(-1, size)
        gram = got[: p + a, : r * r].reshape(p + a, r, r) + rule.ridge_feature * np.eye(r)
        solved = np.linalg.solve(gram, got[: p + a, r * r :, None])[:, :, 0]
        protein, arm = solved[:p], solved[p:]
        average = got[p + a, :r] / max(1.0, got[p + a, r])
    return protein, arm, average


def _dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def fill(npx: DataFrame, panels: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of ``npx`` with npx, group and protein_id filled, and npx_filled, group_filled and protein_filled.

    An empty catalogue leaves proteins and readings NULL.  Usable fields keep their content (group in plain lower case, protein_id as the catalogue writes it).  A filled
    reading lies between NPX_LOW and NPX_HIGH.  A filled arm is the best of those its sample shows elsewhere, or of
    all where it shows none.  A filled protein is that of the panel position; without one it is the protein of the
    panel (or of the catalogue) whose expected reading comes nearest.  Rows without a sample are filled from the mean
    sample.  Repeated rows are filled alike; extra columns stay as they are.
    """
    panels = panels.select("panel", "assay_no", "protein_id", "mean", "sd")
    catalogue = read_catalogue(panels)
    rows = marked(npx, catalogue)
    cells = cut(record_cells(rows, catalogue))
    protein, arm, average = factorise(cells, catalogue, rule)
    context = npx.sparkSession.sparkContext
    shared = context.broadcast((protein, arm))
    mean, sd = catalogue.mean, catalogue.sd

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, z, w, arms = _padded(batch, mean, sd)
            u, _ = solve_samples(f, z, w, arms, *shared.value, rule)
            yield pa.RecordBatch.from_arrays([batch.column("sample"), pa.array(list(u), pa.list_(pa.float64())), pa.array(list(arms > 0), pa.list_(pa.bool_())), batch.column("f"), batch.column("x")], names=["sample", "_u", "_shown", "_f", "_x"])

    kind = dict(cells.dtypes)["sample"]
    samples = cells.mapInArrow(vectors, f"sample {kind}, _u array<double>, _shown array<boolean>, _f array<int>, _x array<float>")
    expected = npx.sparkSession.createDataFrame(
        [(i, n, float(m), float(s), [float(x) for x in v]) for i, (n, m, s, v) in enumerate(zip(catalogue.proteins, catalogue.mean, catalogue.sd, protein))],
        "_p int, _name string, _m double, _s double, _v array<double>",
    )
    arms = F.array(*[F.struct(F.lit(g).alias("name"), F.lit(i).alias("i"), _literal([float(x) for x in v]).alias("v")) for i, (g, v) in enumerate(zip(GROUPS, arm))])
    complete = F.col("_npx").isNotNull() & F.col("_group").isNotNull() & F.col("_p").isNotNull()
    whole = rows.where(complete)
    part = rows.where(~complete).join(samples, F.col("_sample") == F.col("sample"), "left")
    part = part.withColumn("_u", F.coalesce("_u", _literal([float(x) for x in average])))

    # a row without a protein chooses among those of its panel, or of the catalogue where that names no such panel
    near = F.array_sort(F.collect_set(F.struct("_p", "_m", "_s", "_v")))
    candidates = panels.join(dimension(expected), F.col("protein_id") == F.col("_name")).groupBy(F.col("panel").alias("_panel")).agg(near.alias("_choice"))
    every = expected.groupBy(F.lit(True).alias("_any")).agg(near.alias("_all"))
    lost = part.where("_p is null").drop("_p").join(dimension(candidates), "_panel", "left")
    lost = lost.withColumn("_any", F.col("_choice").isNull()).join(dimension(every), "_any", "left").withColumn("_choice", F.coalesce("_choice", "_all"))
    away = F.transform("_choice", lambda c: F.struct(F.abs(F.coalesce(F.col("_npx"), c["_m"]) - c["_m"] - c["_s"] * _dot(F.col("_u"), c["_v"])).alias("d"), c["_p"].alias("p")))
    lost = lost.withColumn("_p", F.array_min(away)["p"]).drop("_choice", "_all", "_any")
    found = part.where("_p is not null")
    part = found.unionByName(lost.select(*found.columns)).join(dimension(expected.select("_p", "_m", "_s", "_v")), "_p", "left")
    low_rank = F.col("_m") + F.col("_s") * _dot(F.col("_u"), F.col("_v"))
    other = F.try_element_at("_x", F.nullif(F.array_position("_f", F.col("_p")), F.lit(0).cast("bigint")).cast("int")).cast("double")
    raw = F.round(low_rank + F.coalesce(rule.own_weight * (other - low_rank), F.lit(0.0)), 4)
    guess = F.when(raw.isNotNull(), F.greatest(F.lit(NPX_LOW), F.least(F.lit(NPX_HIGH), raw)))
    shown = F.filter(arms, lambda a: F.coalesce(F.element_at("_shown", a["i"] + 1), F.lit(False)))
    choice = F.when(F.size(shown) > 0, shown).otherwise(arms)
    best = F.array_max(F.transform(choice, lambda a: F.struct(_dot(F.col("_u"), a["v"]).alias("s"), (-a["i"]).alias("o"), a["name"].alias("n"))))["n"]
    part = part.withColumn("_npx_new", F.coalesce("_npx", guess)).withColumn("_group_new", F.coalesce("_group", best))
    whole = whole.withColumn("_npx_new", F.col("_npx")).withColumn("_group_new", F.col("_group"))
    both = whole.unionByName(part.select(*whole.columns)).join(dimension(expected.select("_p", "_name")), "_p", "left")
    new = {"npx": F.col("_npx_new"), "group": F.col("_group_new"), "protein_id": F.col("_name")}
    return both.select(
        *[new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in npx.columns],
        F.col("_npx").isNull().alias("npx_filled"),
        F.col("_group").isNull().alias("group_filled"),
        F.col("_own").isNull().alias("protein_filled"),
    )


def filled_fields(filled: DataFrame) -> DataFrame:
    """(row_id, field_name): the fields that were filled with a valid value."""
    marks = F.array(
        F.when(F.col("npx_filled") & F.col("npx").isNotNull(), F.lit("npx")),
        F.when(F.col("group_filled") & F.col("group").isNotNull(), F.lit("group")),
        F.when(F.col("protein_filled") & F.col("protein_id").isNotNull(), F.lit("protein_id")),
    )
    return filled.where("npx_filled or group_filled or protein_filled").select("row_id", F.explode(F.array_compact(marks)).alias("field_name"))


def hidden_error(npx: DataFrame, panels: DataFrame, rule: Rule = Rule(), part: int = 20) -> DataFrame:
    """(field_name, n_hidden, better): how the filling fares where the truth is known.

    Of all rows one in ``part``, told by a hash of ``row_id``, has its usable reading or arm hidden before the filling.  ``better``
    tells whether the readings' root mean square error is under that of the mean of protein and arm over the other
    rows, and whether more arms are found again than the most frequent arm would hit.
    """
    turn = F.conv(F.substring(F.md5(F.col("row_id").cast("string")), 1, 8), 16, 10).cast("long") % (2 * part)
    truth = {"npx": usable_npx(F.col("npx")), "group": usable_group(F.col("group"))}
    hide = {"npx": (turn == 0) & truth["npx"].isNotNull(), "group": (turn == 1) & truth["group"].isNotNull()}
    held = npx.select("*", *[F.when(hide[f], truth[f]).alias(f"_true_{f}") for f in truth]).select(
        *[F.when(~F.coalesce(hide[c], F.lit(False)), F.col(c)).alias(c) if c in truth else F.col(f"`{c}`") for c in npx.columns], "_true_npx", "_true_group"
    )
    filled = cut(fill(held, panels, rule).select("protein_id", "group", "npx", "npx_filled", "group_filled", "_true_npx", "_true_group"))
    known = filled.where("not npx_filled and not group_filled").groupBy("protein_id", "group").agg(F.avg("npx").alias("_mean"))
    readings = (
        filled.where("_true_npx is not null")
        .join(dimension(known), ["protein_id", "group"], "left")
        .agg(F.count("*").alias("n"), F.sum(F.pow(F.col("_true_npx") - F.col("npx"), 2)).alias("e"), F.sum(F.pow(F.col("_true_npx") - F.coalesce("_mean", "npx"), 2)).alias("m"))
        .select(F.lit("npx").alias("field_name"), F.col("n").alias("n_hidden"), (F.col("e") < F.col("m")).alias("better"))
    )
    hit = filled.where("_true_group is not null").groupBy("_true_group").agg(F.count("*").alias("n"), F.count_if(F.col("group") == F.col("_true_group")).alias("k"))
    arms = hit.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_hidden"), (F.sum("k") > F.max("n")).alias("better")).select(F.lit("group").alias("field_name"), "n_hidden", "better")
    return readings.unionByName(arms)
