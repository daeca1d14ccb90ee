"""Genotypes in long form, the phenotypes they make, and relatedness along trees."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..session import dimension

GENOTYPE = "person_id string, variant_id string, homologue int, allele_index int"


def random_genotypes(spark: SparkSession, people: int, variants: int, maf: tuple[float, float] = (0.05, 0.5), seed: int = 0) -> DataFrame:
    """Dosages 0, 1, 2 under Hardy-Weinberg: (person_id, variant_id, maf, dosage), each a function of its key."""
    if people < 0 or variants < 0 or not 0 <= maf[0] <= maf[1] <= 1:
        raise ValueError("counts are negative or the frequencies out of order")
    v = F.explode(F.sequence(F.lit(0), F.lit(variants - 1))) if variants else F.explode(F.array().cast("array<int>"))
    grid = spark.range(people).select(F.col("id").alias("p"), v.alias("v"))
    f = F.lit(maf[0]) + F.lit(maf[1] - maf[0]) * rng.uniform(seed, "maf", F.col("v"))
    u = rng.uniform(seed, "geno", F.col("p"), F.col("v"))
    q = F.col("maf")
    dosage = F.when(u < (1 - q) * (1 - q), 0).when(u < (1 - q) * (1 - q) + 2 * q * (1 - q), 1).otherwise(2)
    return grid.withColumn("maf", f).select(F.concat(F.lit("P"), "p").alias("person_id"), F.concat(F.lit("V"), "v").alias("variant_id"), "maf", dosage.alias("dosage"))


def _large(df: DataFrame) -> DataFrame:
    """A table with rows for every person: sorted and merged in a join unless the other side is broadcast.

    The planner takes a table that explodes for as small as what it explodes and rows from the driver for endless, so it
    would send everybody's genotypes or exposures to the driver; what is broadcast is counted (``dimension``) instead.
    """
    return df.hint("merge")


def dosages(genotypes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(person_id, variant_id, allele_index, dosage, on_first): copies of the wanted alleles, zeros kept.

    ``wanted`` (variant_id, allele_index) is the small side; a person without the allele counts 0.
    """
    keys = dimension(wanted.select("variant_id", F.col("allele_index").alias("allele")).distinct())
    hit = F.col("allele_index") == F.col("allele")
    return (
        _large(genotypes).join(keys, "variant_id")
        .groupBy("person_id", "variant_id", F.col("allele").alias("allele_index"))
        .agg(F.count_if(hit).cast("int").alias("dosage"), F.bool_or(hit & (F.col("homologue") == 0)).alias("on_first"))
    )


def _sum_of(made: DataFrame, effect: Column) -> DataFrame:
    return made.groupBy("person_id", "trait_id").agg(F.sum(effect).alias("value"))


def _effects_of(genotypes: DataFrame, effects: DataFrame) -> DataFrame:
    return _large(dosages(genotypes, effects)).join(dimension(effects), ["variant_id", "allele_index"])


def additive(genotypes: DataFrame, effects: DataFrame) -> DataFrame:
    """Copies of the allele times beta; effects are (variant_id, allele_index, trait_id, beta)."""
    return _sum_of(_effects_of(genotypes, effects), F.col("dosage") * F.col("beta"))


def dominance(genotypes: DataFrame, effects: DataFrame) -> DataFrame:
    """Beta where there is exactly one copy."""
    return _sum_of(_effects_of(genotypes, effects), (F.col("dosage") == 1).cast("int") * F.col("beta"))


def context(genotypes: DataFrame, effects: DataFrame, exposures: DataFrame) -> DataFrame:
    """Copies times the centred exposure; effects have also (context_id, centre), exposures (person_id, context_id, z)."""
    joined = _large(_effects_of(genotypes, effects)).join(_large(exposures), ["person_id", "context_id"])
    return _sum_of(joined, F.col("dosage") * (F.col("z") - F.col("centre")) * F.col("beta"))


def _pairs(genotypes: DataFrame, effects: DataFrame) -> DataFrame:
    """Each effect's two alleles side by side per person, by one grouping instead of a self-join."""
    e = effects.withColumn("effect_no", F.xxhash64(*effects.columns))
    ends = e.select("effect_no", F.col("variant_1").alias("variant_id"), F.col("allele_1").alias("allele_index"), F.lit(1).alias("end")).unionByName(
        e.select("effect_no", F.col("variant_2").alias("variant_id"), F.col("allele_2").alias("allele_index"), F.lit(2).alias("end"))
    )
    found = _effects_of(genotypes, ends)
    of = lambda c, k: F.max(F.when(F.col("end") == k, F.col(c)))
    sides = found.groupBy("person_id", "effect_no").agg(of("dosage", 1).alias("d1"), of("dosage", 2).alias("d2"), of("on_first", 1).alias("f1"), of("on_first", 2).alias("f2"))
    return _large(sides).join(dimension(e), "effect_no")


def interaction(genotypes: DataFrame, effects: DataFrame) -> DataFrame:
    """(d1 - c1)(d2 - c2) beta over pairs of alleles: (variant_1, allele_1, variant_2, allele_2, centre_1, centre_2, trait_id, beta)."""
    return _sum_of(_pairs(genotypes, effects), (F.col("d1") - F.col("centre_1")) * (F.col("d2") - F.col("centre_2")) * F.col("beta"))


def compound_het(genotypes: DataFrame, effects: DataFrame) -> DataFrame:
    """Beta where both alleles are there once and on opposite homologues."""
    trans = (F.col("d1") == 1) & (F.col("d2") == 1) & (F.col("f1") != F.col("f2"))
    return _sum_of(_pairs(genotypes, effects), trans.cast("int") * F.col("beta"))


def phenotypes(people: DataFrame, traits: DataFrame, parts: Mapping[str, DataFrame], fixed: DataFrame | None = None, residual: DataFrame | None = None) -> DataFrame:
    """(person_id, trait_id, one column per part, genetic, fixed, residual, complete): zeros where a part says nothing."""
    made = people.select("person_id").join(F.broadcast(traits.select("trait_id")))
    for name, df in [*parts.items(), ("fixed", fixed), ("residual", residual)]:
        if df is None:
            made = made.withColumn(name, F.lit(0.0))
        else:
            made = _large(made).join(_large(df.withColumnRenamed("value", name)), ["person_id", "trait_id"], "left").withColumn(name, F.coalesce(F.col(name).cast("double"), F.lit(0.0)))
    genetic = sum((F.col(n) for n in parts), F.lit(0.0))
    return made.withColumn("genetic", genetic).withColumn("complete", F.col("genetic") + F.col("fixed") + F.col("residual"))


def fixed_effects(covariates: DataFrame, effects: DataFrame) -> DataFrame:
    """X B in long form: covariates (person_id, covariate_id, x), effects (covariate_id, trait_id, beta)."""
    return _sum_of(_large(covariates).join(dimension(effects), "covariate_id"), F.col("x") * F.col("beta"))


def covariance_factor(covariance: np.ndarray, tolerance: float = 64 * np.finfo(float).eps) -> np.ndarray:
    """A with A A' = covariance: Cholesky of the correlations, eigenvectors where they are singular; no jitter."""
    c = np.asarray(covariance, float)
    if c.ndim != 2 or c.shape[0] != c.shape[1] or not np.isfinite(c).all() or not np.allclose(c, c.T):
        raise ValueError("a covariance is square, finite and symmetric")
    scale = np.sqrt(np.maximum(np.diag(c), 0))
    if (np.diag(c) < 0).any() or np.abs(c[scale == 0]).any():
        raise ValueError("a zero variance has no covariance")
    safe = np.where(scale > 0, scale, 1.0)
    corr = c / np.outer(safe, safe)
    try:
        if (scale > 0).all():
            return scale[:, None] * np.linalg.cholesky(corr)
    except np.linalg.LinAlgError:
        pass
    values, vectors = np.linalg.eigh(corr)
    if values.min(initial=0.0) < -tolerance * len(c):
        raise ValueError("the covariance is not positive semi-definite")
    return scale[:, None] * vectors * np.sqrt(np.maximum(values, 0))


def residuals(people: DataFrame, traits: Sequence[str], covariance: np.ndarray, seed: int = 0) -> DataFrame:
    """(person_id, trait_id, value): correlated normal draws, each a function of person and dimension."""
    a = covariance_factor(covariance)
    draw = lambda k: rng.normal(seed, "residual", F.col("person_id"), k)
    parts = people.select("person_id", *[draw(k).alias(f"_z{k}") for k in range(a.shape[1])])
    of = [F.struct(F.lit(t).alias("trait_id"), sum((F.lit(float(a[i, k])) * F.col(f"_z{k}") for k in range(a.shape[1])), F.lit(0.0)).alias("value")) for i, t in enumerate(traits)]
    return parts.select("person_id", F.inline(F.array(*of)))


def observe(complete: DataFrame, probability: Column, seed: int = 0) -> DataFrame:
    """``observed`` and ``observed_value``: NULL where a draw is not under the probability; ``complete`` stays."""
    seen = rng.uniform(seed, "observe", F.col("person_id"), F.col("trait_id")) < probability
    return complete.withColumn("observed", seen).withColumn("observed_value", F.when(F.col("observed"), F.col("complete")))


def first_common_site(genotypes: DataFrame, sites: DataFrame, least: int) -> DataFrame:
    """The first site in order of position with two alleles whose rarer one has ``least`` copies or more."""
    counts = genotypes.groupBy("variant_id").agg(F.countDistinct("allele_index").alias("alleles"), F.count_if(F.col("allele_index") == 1).alias("copies"), F.count("*").alias("n"))
    rare = F.least("copies", F.col("n") - F.col("copies"))
    fit = counts.where((F.col("alleles") == 2) & (rare >= least)).join(sites, "variant_id")
    return fit.agg(F.min_by(F.struct("variant_id", "position", rare.alias("copies")), F.struct("position", "variant_id")).alias("s")).where("s is not null").select("s.*")


def branch_features(edges: DataFrame, node_times: DataFrame, trees: DataFrame, owners: DataFrame, band: tuple[float, float] | None = None, most_depth: int = 10_000) -> DataFrame:
    """(branch, person_id, carrier, weight): who carries each branch of each tree, and its clipped length times span.

    ``edges`` (tree_id, parent, child), ``node_times`` (node, time), ``trees`` (tree_id, span), ``owners`` (person_id,
    node) with two sample nodes each.  Samples are carried upwards level by level with an equi-join on the child.
    """
    from ..session import cut

    up = edges.select("tree_id", F.col("child").alias("node"), F.col("parent").alias("above"))
    # a sample that no edge of a tree names carries nothing there
    front = cut(up.join(owners.select("person_id", "node").distinct(), "node").join(trees.select("tree_id"), "tree_id", "left_semi").select("tree_id", "person_id", F.col("node").alias("sample"), "node").distinct())
    carried = front
    for _ in range(most_depth):
        front = cut(front.join(up, ["tree_id", "node"]).select("tree_id", "person_id", "sample", F.col("above").alias("node")))
        if front.isEmpty():
            break
        carried = carried.unionByName(front)
    low, high = band if band else (float("-inf"), float("inf"))
    t = node_times.select(F.col("node").alias("n"), "time")
    length = edges.join(t.select(F.col("n").alias("parent"), F.col("time").alias("top")), "parent").join(t.select(F.col("n").alias("child"), F.col("time").alias("bottom")), "child")
    clipped = F.greatest(F.lit(0.0), F.least(F.col("top"), F.lit(high)) - F.greatest(F.col("bottom"), F.lit(low)))
    whole = trees.agg(F.sum("span").alias("whole"))
    length = length.join(trees, "tree_id").join(F.broadcast(whole)).withColumn("weight", F.col("span") / F.col("whole") * clipped).where("weight > 0")
    share = carried.groupBy("tree_id", F.col("node").alias("child"), "person_id").agg((F.countDistinct("sample") / 2).alias("carrier"))
    return length.join(share, ["tree_id", "child"]).select("tree_id", "child", "person_id", "carrier", "weight")


def branch_covariance(features: DataFrame, people: Sequence[str], centre: bool = True, normalise: bool = True) -> np.ndarray:
    """The people's covariance: weighted products of their shares of each branch, summed where the branches are.

    People are few (a matrix of them is the result), so a branch's carriers are at most as many.
    """
    a = features.select("tree_id", "child", "weight", F.col("person_id").alias("p"), F.col("carrier").alias("x"))
    b = features.select("tree_id", "child", F.col("person_id").alias("q"), F.col("carrier").alias("y"))
    rows = a.join(b, ["tree_id", "child"]).groupBy("p", "q").agg(F.sum(F.col("weight") * F.col("x") * F.col("y")).alias("s")).collect()
    at = {p: i for i, p in enumerate(people)}
    m = np.zeros((len(people), len(people)))
    for r in rows:
        m[at[r["p"]], at[r["q"]]] = r["s"]
    if centre:
        h = np.eye(len(people)) - 1 / max(1, len(people))
        m = h @ m @ h
    mean = np.trace(m) / max(1, len(people))
    return m / mean if normalise and mean > 0 else m


#: Classes of significance in order of priority, and the priority of any other.
SIGNIFICANCE = ("pathogenic", "likely pathogenic", "risk factor", "drug response", "protective", "association", "affects", "uncertain significance", "likely benign", "benign", "conflicting")
OTHER_PRIORITY = 100


def gene_findings(variants: DataFrame, priorities: Sequence[tuple[str, int]] = tuple((s, i + 1) for i, s in enumerate(SIGNIFICANCE)), most: int = 10) -> DataFrame:
    """Per patient and significance at most ``most`` variants, one per id, without reference alleles, by priority.

    ``variants``: (patient_id, rsid, gene, significance, allele, ancestral_allele, variant, row_no).  A priority is the
    first listed text that the significance holds.
    """
    from pyspark.sql import Window

    called = F.lower(F.col("variant").cast("string")) == "true"
    kept = variants.where(F.coalesce(called, F.lit(False)) & (F.col("allele") != F.col("ancestral_allele")))
    first = kept.groupBy("patient_id", "rsid").agg(F.min_by(F.struct("gene", "significance", "allele", "row_no"), "row_no").alias("v")).select("patient_id", "rsid", "v.*")
    rank = F.lit(OTHER_PRIORITY)
    for text, value in reversed(priorities):
        rank = F.when(F.contains(F.lower("significance"), F.lit(text)), value).otherwise(rank)
    w = Window.partitionBy("patient_id", "significance").orderBy("row_no", "rsid")
    return first.withColumn("priority", rank).withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")


def stream_seed(name: str, *parts: object, bits: int = 128, taken: Iterable[int] = ()) -> int:
    """A non-zero seed for a named stream from a digest; on collision with ``taken`` a counter moves it on."""
    used = set(taken)
    for attempt in range(1_000_000):
        said = json.dumps([name, *map(str, parts), attempt], separators=(",", ":"))
        seed = int.from_bytes(hashlib.sha256(said.encode()).digest()[: bits // 8], "big")
        if seed and seed not in used:
            return seed
    raise RuntimeError("no free seed")


def table_signature(df: DataFrame, order: Sequence[str]) -> str:
    """A digest of a table's content: digests of the rows, summed so that order and partitions do not matter."""
    said = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(said, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)]
    row = df.agg(F.count("*").alias("n"), *parts).first()
    return hashlib.sha256(":".join(str(v) for v in row).encode()).hexdigest()


def verify_truth(genotypes: DataFrame, truth: DataFrame) -> DataFrame:
    """Cells that differ between a genotype table and its truth, or stand in one of them only; empty if all agree."""
    key = ["person_id", "variant_id", "homologue"]
    a, b = genotypes.select(*key, F.col("allele_index").alias("got")), truth.select(*key, F.col("allele_index").alias("want"))
    return a.join(b, key, "full_outer").where(~F.col("got").eqNullSafe(F.col("want")))


RECIPE_KEYS = ("genotypes", "sites", "traits", "effects", "effect_rules", "covariates", "covariate_effects", "residual_covariance", "observed_probability", "seed")
MECHANISMS = ("additive", "dominance", "interaction", "compound_het")


def run_recipe(spark: SparkSession, recipe: Mapping, folder: str) -> dict:
    """Phenotypes by a closed recipe, written as a bundle with its manifest; the manifest is returned.

    ``genotypes``, ``sites`` and ``covariates`` are paths of Parquet tables; ``effects`` maps a mechanism to rows of its
    table; an effect rule (trait_id, least, beta) gives its beta to the first common site.  Unknown keys, mechanisms and
    unmet rules are errors.
    """
    from ..sources.files import closed
    from ..sources.sinks import write_association_bundle

    recipe = closed(dict(recipe), RECIPE_KEYS, ("genotypes", "traits", "seed"))
    seed = int(recipe["seed"])
    genotypes = spark.read.parquet(recipe["genotypes"])
    people, traits = genotypes.select("person_id").distinct(), list(recipe["traits"])
    rows = {m: [tuple(r) for r in recipe.get("effects", {}).get(m, [])] for m in MECHANISMS}
    if set(recipe.get("effects", {})) - set(MECHANISMS):
        raise ValueError("unknown mechanism")
    for trait, least, beta in recipe.get("effect_rules", []):
        site = first_common_site(genotypes, spark.read.parquet(recipe["sites"]), int(least)).first()
        if site is None:
            raise ValueError(f"no site has {least} copies of its rarer allele")
        rows["additive"].append((site["variant_id"], 1, trait, float(beta)))
    single = "variant_id string, allele_index int, trait_id string, beta double"
    pair = "variant_1 string, allele_1 int, variant_2 string, allele_2 int, centre_1 double, centre_2 double, trait_id string, beta double"
    make = {"additive": (additive, single), "dominance": (dominance, single), "interaction": (interaction, pair), "compound_het": (compound_het, pair)}
    parts = {m: f(genotypes, spark.createDataFrame(rows[m], schema)) for m, (f, schema) in make.items() if rows[m]}
    fixed = None
    if "covariates" in recipe:
        betas = [tuple(r) for r in recipe.get("covariate_effects", [])]
        fixed = fixed_effects(spark.read.parquet(recipe["covariates"]), spark.createDataFrame(betas, "covariate_id string, trait_id string, beta double"))
    noise = residuals(people, traits, np.array(recipe["residual_covariance"], float), seed) if "residual_covariance" in recipe else None
    made = phenotypes(people, spark.createDataFrame([(t,) for t in traits], "trait_id string"), parts, fixed, noise)
    made = observe(made, F.lit(float(recipe.get("observed_probability", 1.0))), seed)
    return write_association_bundle({"phenotypes": made, "genotypes": genotypes}, folder, {"recipe": json.dumps(recipe, sort_keys=True), "genotype_signature": table_signature(genotypes, [])})
