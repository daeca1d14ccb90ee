"""Simulation and analytics of long-form protein readings."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rng
from ..functions.npx import usable_group, usable_npx, with_protein
from ..session import cut

#: Fixed value: columns of a long table, in order.
NPX_SCHEMA = "sample_id string, protein_id string, npx double, qc_warning boolean, group string, plate_id string"
MODES = ("mnar_lod", "mcar", "mar")
PLATE_SIZE = 96
LOD_DROP = 0.8
EFFECT_COLUMNS = ("disease", "protein_uniprot", "delta_npx", "se_delta", "source", "doi", "evidence_strength")


@dataclass(frozen=True)
class PanelConfig:
    """Proteins with location, scale and limit of detection."""

    proteins: tuple[str, ...]
    mean: Mapping[str, float]
    sd: Mapping[str, float]
    lod: Mapping[str, float]

    def __post_init__(self) -> None:
        if len(set(self.proteins)) != len(self.proteins):
            raise ValueError("proteins repeat")
        for name, values in (("mean", self.mean), ("sd", self.sd), ("lod", self.lod)):
            if set(values) != set(self.proteins):
                raise ValueError(f"{name} does not cover the proteins")
        if any(not v > 0 for v in self.sd.values()):
            raise ValueError("sd must be positive")


def default_panel(size: int = 50, proteins: Sequence[str] = (), mean: float = 5.0, sd: float = 0.6, lod: float = 3.0) -> PanelConfig:
    """``size`` proteins: the given ones without repetition, cut or filled up with numbered names."""
    names = list(dict.fromkeys(proteins))[:size]
    k = 0
    while len(names) < size:
        k += 1
        if (name := f"PROT{k:04d}") not in names:
            names.append(name)
    return PanelConfig(tuple(names), dict.fromkeys(names, mean), dict.fromkeys(names, sd), dict.fromkeys(names, lod))


@dataclass(frozen=True)
class SimulationConfig:
    n_samples: int
    panel: PanelConfig
    groups: tuple[str, ...] = ()
    effects: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    missing_rate: float = 0.05
    qc_rate: float = 0.01
    plate_sd: float = 0.15
    mode: str = "mnar_lod"
    seed: int = 0

    def __post_init__(self) -> None:
        if self.n_samples < 0:
            raise ValueError("n_samples is negative")
        if not (0 <= self.missing_rate <= 1 and 0 <= self.qc_rate <= 1):
            raise ValueError("rates lie between 0 and 1")
        if self.plate_sd < 0 or self.mode not in MODES:
            raise ValueError("plate_sd is negative or the mode unknown")
        if self.groups and len(self.groups) != self.n_samples:
            raise ValueError("as many groups as samples are needed")


def simulate(spark: SparkSession, config: SimulationConfig) -> DataFrame:
    """Readings of every sample and protein: location, plate effect, group effect and noise, then missing cells.

    All draws are functions of (seed, sample, protein), so rows do not depend on partitioning; samples are made where
    they are needed by ``range`` and the panel is exploded from a literal.
    """
    p = config.panel
    if not config.n_samples or not p.proteins:
        return spark.createDataFrame([], NPX_SCHEMA)
    proteins = F.array(*[F.struct(F.lit(n).alias("protein_id"), F.lit(float(p.mean[n])).alias("m"), F.lit(float(p.sd[n])).alias("s"), F.lit(float(p.lod[n])).alias("l")) for n in p.proteins])
    n, seed = F.col("id"), config.seed
    if config.groups:
        arms = spark.createDataFrame(list(enumerate(config.groups)), "id long, group string")
        rows = spark.range(config.n_samples).join(arms, "id")
    else:
        rows = spark.range(config.n_samples).withColumn("group", F.lit("baseline"))
    plate = F.floor(n / PLATE_SIZE)
    rows = rows.select("id", "group", plate.alias("plate"), F.inline(proteins))
    shifts = [(g, pr, float(d)) for g, of in config.effects.items() for pr, d in of.items()]
    if shifts:
        rows = rows.join(spark.createDataFrame(shifts, "group string, protein_id string, shift double"), ["group", "protein_id"], "left").withColumn("shift", F.coalesce("shift", F.lit(0.0)))
    else:
        rows = rows.withColumn("shift", F.lit(0.0))
    plate_effect = F.lit(config.plate_sd) * rng.normal(seed, "plate", F.col("plate"))
    rows = rows.withColumn("npx", F.col("m") + plate_effect + F.col("shift") + F.col("s") * rng.normal(seed, "eps", n, F.col("protein_id")))
    if config.mode == "mnar_lod":
        rows = rows.where((F.col("npx") >= F.col("l")) | (rng.uniform(seed, "lod", n, F.col("protein_id")) >= LOD_DROP))
    if config.missing_rate > 0:
        rows = rows.where(rng.uniform(seed, "miss", n, F.col("protein_id")) >= config.missing_rate)
    return rows.select(
        F.concat(F.lit("S"), F.lpad(n.cast("string"), 4, "0") if config.n_samples <= 10_000 else n.cast("string")).alias("sample_id"),
        "protein_id", "npx",
        (rng.uniform(seed, "qc", n, F.col("protein_id")) < config.qc_rate).alias("qc_warning"),
        "group",
        F.concat(F.lit("plate_"), F.col("plate").cast("string")).alias("plate_id"),
    )


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The frame itself, or an error that names the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def usable(npx: DataFrame, panels: DataFrame) -> DataFrame:
    """(sample_id, protein_id, npx, arm, plate_id, qc_warning): the assay rows that hold a reading of a known protein."""
    picked = npx.select("sample_id", "protein_id", "panel", "assay_no", "npx", "group", "plate_id", "qc_warning")
    return (
        with_protein(picked, panels)
        .select("sample_id", F.coalesce("protein_own", "protein_at").alias("protein_id"), usable_npx(F.col("npx")).alias("npx"), usable_group(F.col("group")).alias("arm"), "plate_id", "qc_warning")
        .where("npx is not null and protein_id is not null")
    )


def protein_stats(readings: DataFrame, samples: Column | None = None, top: int | None = None) -> DataFrame:
    """Mean, readings and the share of samples without one, by mean from the highest."""
    n = readings.agg(F.countDistinct("sample_id").alias("_n"))
    made = readings.groupBy("protein_id").agg(F.avg("npx").alias("mean_npx"), F.count("*").alias("n"), F.countDistinct("sample_id").alias("n_samples"))
    made = made.join(F.broadcast(n)).withColumn("drop_rate", 1 - F.col("n_samples") / F.col("_n")).drop("_n").orderBy(F.desc("mean_npx"), "protein_id")
    return made if top is None else made.limit(top)


def group_deltas(readings: DataFrame, case: str = "case", control: str = "baseline") -> DataFrame:
    """Mean of each arm per protein and their difference."""
    mean = lambda g: F.avg(F.when(F.col("arm") == g, F.col("npx")))
    return readings.groupBy("protein_id").agg(mean(case).alias("case_mean"), mean(control).alias("control_mean")).withColumn("delta", F.col("case_mean") - F.col("control_mean"))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    made = d.copy()
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            made *= c * d
    return made


def student_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) of Student's distribution."""
    x = df / (df + t * t)
    a, b = df / 2, np.full_like(df, 0.5)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(gamma(a + b) - gamma(a) - gamma(b) + a * np.log(np.maximum(x, 1e-300)) + b * np.log(np.maximum(1 - x, 1e-300)))
    direct = x < (a + 1) / (a + b + 2)
    low = front * _beta_fraction(a, b, np.where(direct, x, 0.5)) / a
    high = 1 - front * _beta_fraction(b, a, np.where(direct, 0.5, 1 - x)) / b
    return np.clip(np.where(direct, low, high), 0.0, 1.0)


@F.pandas_udf(T.DoubleType())
def _p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    good = t.notna() & df.notna() & (df > 0)
    made = pd.Series(np.nan, index=t.index)
    if good.any():
        made[good] = student_two_sided(t[good].to_numpy(float), df[good].to_numpy(float))
    return made


def welch(readings: DataFrame, case: str = "case", control: str = "baseline", least: int = 3, p_values: bool = True) -> DataFrame:
    """Welch's test per protein: moments in one aggregation, the distribution in one Arrow call per protein row."""
    made = readings.where(F.col("arm").isin(case, control)).groupBy("protein_id")
    of = lambda f, g: f(F.when(F.col("arm") == g, F.col("npx")))
    cols = {f"{n}_{k}": of(f, g) for k, g in (("case", case), ("control", control)) for n, f in (("mean", F.avg), ("var", F.var_samp), ("n", F.count))}
    made = made.agg(*[c.alias(n) for n, c in cols.items()]).where((F.col("n_case") >= least) & (F.col("n_control") >= least))
    a, b = F.col("var_case") / F.col("n_case"), F.col("var_control") / F.col("n_control")
    made = made.withColumn("delta", F.col("mean_case") - F.col("mean_control")).withColumn("t", F.try_divide(F.col("delta"), F.sqrt(a + b)))
    made = made.withColumn("df", F.try_divide((a + b) * (a + b), a * a / (F.col("n_case") - 1) + b * b / (F.col("n_control") - 1)))
    if not p_values:
        return made
    p = F.greatest(_p_value("t", "df"), F.lit(1e-300))
    return made.withColumn("p_value", p).withColumn("neg_log10_p", -F.log10(F.col("p_value")))


def correlations(cells: DataFrame, top: int = 25) -> DataFrame:
    """(protein_a, protein_b, r, n): Pearson correlations of the ``top`` proteins by mean, over shared samples.

    A self-join on the sample of at most ``top`` cells each.
    """
    chosen = cells.groupBy("protein_id").agg(F.avg("npx").alias("m")).orderBy(F.desc("m"), "protein_id").limit(top).select("protein_id")
    kept = cells.join(chosen, "protein_id").select("sample_id", "protein_id", "npx")
    left, right = kept.select("sample_id", F.col("protein_id").alias("protein_a"), F.col("npx").alias("x")), kept.select("sample_id", F.col("protein_id").alias("protein_b"), F.col("npx").alias("y"))
    return left.join(right, "sample_id").where("protein_a <= protein_b").groupBy("protein_a", "protein_b").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n"))


def exact_median(df: DataFrame, by: str, value: str, width: float = 0.02) -> DataFrame:
    """(by, m): the exact median of each group, without holding a group's values in one place.

    Values are counted, the counts added up over bins of ``width``, and only the bins that hold the middle ranks are
    looked into.
    """
    counted = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(by, F.col(value).alias("_x")).agg(F.count("*").alias("_n"))
    counted = cut(counted.withColumn("_bin", F.floor(F.col("_x") / width)))
    bins = counted.groupBy(by, "_bin").agg(F.sum("_n").alias("_n"))
    w = Window.partitionBy(by).orderBy("_bin")
    total = F.sum("_n").over(Window.partitionBy(by))
    placed = bins.select(by, "_bin", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.col("_n").alias("_held"), F.floor((total - 1) / 2).alias("_low"), F.floor(total / 2).alias("_high"))
    holds = lambda rank: (F.col(rank) >= F.col("_before")) & (F.col(rank) < F.col("_before") + F.col("_held"))
    middle = placed.where(holds("_low") | holds("_high")).drop("_held")
    inner = counted.join(middle, [by, "_bin"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy(by, "_bin").orderBy("_x")))
    at = lambda rank: F.min(F.when(F.col("_upto") > F.col(rank), F.col("_x")))
    return inner.groupBy(by).agg(((at("_low") + at("_high")) / 2).alias("m"))


def median_filled(cells: DataFrame, proteins: Sequence[str]) -> DataFrame:
    """(sample_id, protein_id, npx, filled): the complete grid of samples and listed proteins, gaps by the protein's median.

    A sample gathers its cells, at most one per protein, and is exploded with those that it lacks: the grid is not shuffled.
    """
    names = F.array(*[F.lit(p) for p in proteins])
    listed = cells.where(F.col("protein_id").isin(list(proteins)))
    middle = exact_median(listed, "protein_id", "npx")
    held = F.when(F.col("sample_id").isNotNull() & F.col("protein_id").isin(list(proteins)), F.struct("protein_id", "npx"))
    rows = cells.groupBy("sample_id").agg(F.collect_list(held).alias("c"))
    gaps = F.transform(F.array_except(names, F.col("c.protein_id")), lambda p: F.struct(p.alias("protein_id"), F.lit(None).cast("double").alias("npx")))
    grid = rows.select("sample_id", F.inline(F.concat("c", gaps)))
    made = grid.join(middle, "protein_id", "left")
    return made.select("sample_id", "protein_id", F.coalesce("npx", "m").alias("npx"), F.col("npx").isNull().alias("filled"))


def principal_components(cells: DataFrame, proteins: Sequence[str], k: int = 2) -> DataFrame:
    """(sample_id, pc1..pck) of the standardised grid of samples and listed proteins, gaps filled by the protein's median.

    The grid is made a batch of samples at a time and never stands in a table: a sample sends its cells once, and its
    products with itself are summed where it is.  The k vectors are found on the driver, from one matrix of proteins.
    """
    if len(proteins) > 2000:
        raise ValueError("too many proteins for a dense covariance")
    spark, p = cells.sparkSession, len(proteins)
    number = spark.createDataFrame([(name, i) for i, name in enumerate(proteins)], "protein_id string, i int")
    listed = cells.join(number, "protein_id", "left")
    gathered = F.collect_list(F.when(F.col("i").isNotNull() & F.col("npx").isNotNull(), F.struct("i", "npx")))
    rows = cut(listed.groupBy("sample_id").agg(gathered.alias("c")).select("sample_id", F.col("c.i").alias("i"), F.col("c.npx").alias("x")))
    sums = rows.select(F.inline(F.arrays_zip("i", "x"))).groupBy("i").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    medians = exact_median(listed.where("i is not null"), "i", "npx")
    n_rows = rows.count()
    gap, mean, spread = np.zeros(p), np.zeros(p), np.zeros(p)
    for r in sums.join(medians, "i").collect():  # as many as proteins
        missing = n_rows - r["n"]
        m = (r["s"] + missing * r["m"]) / n_rows
        gap[r["i"]], mean[r["i"]] = r["m"], m
        spread[r["i"]] = math.sqrt(max(0.0, (r["q"] + missing * r["m"] ** 2) / n_rows - m * m))
    scale = np.where(spread > 1e-12, 1.0 / np.where(spread > 1e-12, spread, 1.0), 0.0)
    filler = (gap - mean) * scale

    def grid(batch: pa.RecordBatch) -> np.ndarray:
        z = np.tile(filler, (batch.num_rows, 1))
        row = pa.compute.list_parent_indices(batch.column("i")).to_numpy(zero_copy_only=False)
        at = batch.column("i").flatten().to_numpy(zero_copy_only=False)
        z[row, at] = (batch.column("x").flatten().to_numpy(zero_copy_only=False) - mean[at]) * scale[at]
        return z

    def gram(batches):
        total = np.zeros((p, p))
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                z = grid(batch.slice(a, 2000))
                total += z.T @ z
        i, j = np.triu_indices(p)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype("int32")), pa.array(j.astype("int32")), pa.array(total[i, j])], names=["i", "j", "s"])

    got = rows.mapInArrow(gram, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    matrix = np.zeros((p, p))
    i, j, v = (got.column(c).to_numpy() for c in ("i", "j", "s"))
    matrix[i, j] = matrix[j, i] = v
    values, vectors = np.linalg.eigh(matrix)
    best = vectors[:, np.argsort(values)[::-1][:k]].T
    best = best * np.sign(best[np.arange(len(best)), np.abs(best).argmax(axis=1)])[:, None]

    def placed(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                y = grid(part) @ best.T
                yield pa.RecordBatch.from_arrays([part.column("sample_id"), *[pa.array(y[:, c]) for c in range(len(best))]], names=["sample_id", *[f"pc{c + 1}" for c in range(len(best))]])

    return rows.mapInArrow(placed, ", ".join([f"sample_id {dict(rows.dtypes)['sample_id']}", *[f"pc{c + 1} double" for c in range(len(best))]]))


def effects(spark: SparkSession, path: str) -> DataFrame:
    """An effect catalogue from CSV: required columns, numbers where numbers belong, others kept as they are."""
    raw = require(spark.read.option("header", True).csv(path), EFFECT_COLUMNS[:4])
    number = lambda c: F.when(F.col(c).isNull() | F.col(c).try_cast("double").isNotNull(), F.col(c).try_cast("double")).otherwise(F.raise_error(F.concat(F.lit(f"{c} is no number: "), F.col(c))).cast("double"))
    return raw.withColumn("delta_npx", number("delta_npx")).withColumn("se_delta", number("se_delta"))


def effect_map(catalogue: DataFrame, diseases: Sequence[str], noise_sd: float = 0.0, seed: int = 0) -> DataFrame:
    """(protein_uniprot, effects): non-zero effects by disease, with noise in units of their standard error if asked."""
    chosen = catalogue.where(F.col("disease").isin(list(diseases)) & (F.abs("delta_npx") > 0))
    delta = F.col("delta_npx") + (F.lit(noise_sd) * F.coalesce("se_delta", F.lit(0.0)) * rng.normal(seed, "effect", F.col("disease"), F.col("protein_uniprot")) if noise_sd else F.lit(0.0))
    return chosen.groupBy("protein_uniprot").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("disease", delta.alias("d"))))).alias("effects"))
