"""Genotypes, phenotypes and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import uniform_sql
from ..operators import genetics
from .common import Registry, table

registry = Registry()
on = registry.on

SEED, N_VARIANTS = "5", 12
_U = lambda *k: uniform_sql(f"'{SEED}'", *k)


def _genotypes(spark: SparkSession, root: str) -> DataFrame:
    """Two homologues of twelve variants per customer; every third variant has three alleles."""
    from ..functions.rng import uniform

    people = table(spark, root, "customer").select(F.col("c_custkey").cast("string").alias("person_id"))
    grid = people.select("person_id", F.explode(F.sequence(F.lit(0), F.lit(N_VARIANTS - 1))).alias("v"), F.array(F.lit(0), F.lit(1)).alias("hs")).select("person_id", "v", F.explode("hs").alias("homologue"))
    u = uniform(SEED, F.col("person_id"), F.col("v"), F.col("homologue"))
    allele = F.when(u < 0.2, 1).when((u < 0.3) & (F.col("v") % 3 == 0), 2).otherwise(0)
    return grid.select("person_id", F.concat(F.lit("V"), "v").alias("variant_id"), "homologue", allele.alias("allele_index"))


_G = f"""g as (select person_id, 'V' || v as variant_id, h as homologue, case when u < 0.2 then 1 when u < 0.3 and v % 3 = 0 then 2 else 0 end as allele_index
  from (select c_custkey::varchar as person_id, v, h, {_U('c_custkey', 'v', 'h')} as u from customer, range({N_VARIANTS}) a(v), range(2) b(h)))"""
_EFFECTS = (("V0", 1, "height", 0.5), ("V0", 2, "height", -0.25), ("V3", 1, "expression", 1.5), ("V5", 1, "height", 2.0))
_PAIRS = (("V1", 1, "V2", 1, 0.5, 1.0, "height", 2.0), ("V3", 2, "V4", 1, 0.0, 0.0, "expression", 1.0))
_E = f"e(variant_id, allele_index, trait_id, beta) as (values {', '.join(map(str, _EFFECTS))})"
_P = f"p(v1, a1, v2, a2, c1, c2, trait_id, beta) as (values {', '.join(map(str, _PAIRS))})"
_D = "d as (select person_id, g.variant_id, a.allele_index, count_if(g.allele_index = a.allele_index) as dosage, bool_or(g.allele_index = a.allele_index and homologue = 0) as f from g join (select distinct variant_id, allele_index from {}) a on a.variant_id = g.variant_id group by 1, 2, 3)"


def _effects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(_EFFECTS), "variant_id string, allele_index int, trait_id string, beta double")


def _pair_effects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(_PAIRS), "variant_1 string, allele_1 int, variant_2 string, allele_2 int, centre_1 double, centre_2 double, trait_id string, beta double")


@on(f"with {_G}, {_E}, {_D.format('e')} select person_id, trait_id, sum(dosage * beta)::double as value from d join e using (variant_id, allele_index) group by 1, 2")
def sm05_additive(spark: SparkSession, root: str) -> DataFrame:
    """Also JN15: genotypes meet effects by variant and allele."""
    return genetics.additive(_genotypes(spark, root), _effects(spark))


@on(f"with {_G}, {_E}, {_D.format('e')} select person_id, trait_id, sum((dosage = 1)::int * beta)::double as value from d join e using (variant_id, allele_index) group by 1, 2")
def sm06_dominance(spark: SparkSession, root: str) -> DataFrame:
    return genetics.dominance(_genotypes(spark, root), _effects(spark))


_PD = f"with {_G}, {_P}, q as (select v1 as variant_id, a1 as allele_index from p union select v2, a2 from p), {_D.format('q')}, j as (select x.person_id, p.*, x.dosage as d1, y.dosage as d2, x.f as f1, y.f as f2 from p join d x on x.variant_id = v1 and x.allele_index = a1 join d y on y.variant_id = v2 and y.allele_index = a2 and y.person_id = x.person_id)"


@on(f"{_PD} select person_id, trait_id, sum((d1 - c1) * (d2 - c2) * beta)::double as value from j group by 1, 2")
def sm07_interaction(spark: SparkSession, root: str) -> DataFrame:
    return genetics.interaction(_genotypes(spark, root), _pair_effects(spark))


@on(f"{_PD} select person_id, trait_id, sum((d1 = 1 and d2 = 1 and f1 <> f2)::int * beta)::double as value from j group by 1, 2")
def sm09_compound_het(spark: SparkSession, root: str) -> DataFrame:
    return genetics.compound_het(_genotypes(spark, root), _pair_effects(spark))


def _exposures(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "customer").select(F.col("c_custkey").cast("string").alias("person_id"), F.lit("balance").alias("context_id"), (F.floor("c_acctbal") / 8).alias("z"))


@on(f"with {_G}, {_E}, {_D.format('e')} select person_id, trait_id, round(sum(dosage * (floor(c_acctbal) / 8 - 2.0) * beta), 4) as value from d join e using (variant_id, allele_index) join customer on c_custkey = person_id::bigint group by 1, 2")
def sm08_context(spark: SparkSession, root: str) -> DataFrame:
    effects = _effects(spark).withColumn("context_id", F.lit("balance")).withColumn("centre", F.lit(2.0))
    return genetics.context(_genotypes(spark, root), effects, _exposures(spark, root)).withColumn("value", F.round("value", 4))


@on(f"""with {_G}, {_E}, {_D.format('e')}, a as (select person_id, trait_id, sum(dosage * beta) as x from d join e using (variant_id, allele_index) group by 1, 2),
t as (select c_custkey::varchar as person_id, t.t as trait_id, c_acctbal from customer, (values ('height'), ('expression')) t(t))
select t.person_id, t.trait_id, coalesce(x, 0)::double as genetic, round(floor(c_acctbal) / 8 * case t.trait_id when 'height' then 5 else -2 end, 6) as fixed, round(coalesce(x, 0) + floor(c_acctbal) / 8 * case t.trait_id when 'height' then 5 else -2 end, 6) as complete
from t left join a on a.person_id = t.person_id and a.trait_id = t.trait_id""")
def sm10_phenotypes(spark: SparkSession, root: str) -> DataFrame:
    people = table(spark, root, "customer").select(F.col("c_custkey").cast("string").alias("person_id"))
    traits = spark.createDataFrame([("height",), ("expression",)], "trait_id string")
    covariates = _exposures(spark, root).select("person_id", F.lit("balance").alias("covariate_id"), F.col("z").alias("x"))
    fixed = genetics.fixed_effects(covariates, spark.createDataFrame([("balance", "height", 5.0), ("balance", "expression", -2.0)], "covariate_id string, trait_id string, beta double"))
    made = genetics.phenotypes(people, traits, {"additive": genetics.additive(_genotypes(spark, root), _effects(spark))}, fixed)
    return made.select("person_id", "trait_id", "genetic", F.round("fixed", 6).alias("fixed"), F.round("complete", 6).alias("complete"))


@on(f"""with t as (select c_custkey::varchar as person_id, 'height' as trait_id, c_acctbal as complete from customer), o as (select *, {uniform_sql("'3'", "'observe'", 'person_id', 'trait_id')} < 0.7 as observed from t)
select person_id, trait_id, observed, case when observed then complete end as observed_value from o""")
def sm13_observed(spark: SparkSession, root: str) -> DataFrame:
    complete = table(spark, root, "customer").select(F.col("c_custkey").cast("string").alias("person_id"), F.lit("height").alias("trait_id"), F.col("c_acctbal").alias("complete"))
    return genetics.observe(complete, F.lit(0.7), seed=3).drop("complete")


@on()
def sm12_residuals(spark: SparkSession, root: str) -> DataFrame:
    import numpy as np

    people = table(spark, root, "customer").select(F.col("c_custkey").cast("string").alias("person_id"))
    return genetics.residuals(people, ["height", "expression"], np.array([[1.0, 0.5], [0.5, 2.0]]), seed=4)


_MAF = f"(0.05 + 0.45 * {uniform_sql(chr(39) + '9' + chr(39), chr(39) + 'maf' + chr(39), 'v')})"


@on(f"""with x as (select p, v, {_MAF} as q, {uniform_sql("'9'", "'geno'", 'p', 'v')} as u from range(300) a(p), range(20) b(v))
select 'P' || p as person_id, 'V' || v as variant_id, cast(case when u < (1 - q) * (1 - q) then 0 when u < (1 - q) * (1 - q) + 2 * q * (1 - q) then 1 else 2 end as int) as dosage from x""")
def sm04_random_genotypes(spark: SparkSession, root: str) -> DataFrame:
    return genetics.random_genotypes(spark, 300, 20, seed=9).drop("maf")


@on(f"""with {_G}, c as (select variant_id, count(distinct allele_index) as a, count_if(allele_index = 1) as k, count(*) as n from g group by 1)
select variant_id, cast(substr(variant_id, 2) as int) * 100 as position, least(k, n - k) as copies from c where a = 2 and least(k, n - k) >= 5 order by 2 limit 1""")
def sm18_first_common_site(spark: SparkSession, root: str) -> DataFrame:
    sites = spark.range(N_VARIANTS).select(F.concat(F.lit("V"), "id").alias("variant_id"), (F.col("id") * 100).cast("int").alias("position"))
    return genetics.first_common_site(_genotypes(spark, root), sites, 5)


@on(f"with {_G} select person_id, variant_id, homologue::int as homologue, allele_index as got, (allele_index + 1) as want from g where variant_id = 'V7' and homologue = 1 and person_id::int % 10 = 0")
def sm20_verified_truth(spark: SparkSession, root: str) -> DataFrame:
    g = _genotypes(spark, root)
    wrong = (F.col("variant_id") == "V7") & (F.col("homologue") == 1) & (F.col("person_id").cast("int") % 10 == 0)
    return genetics.verify_truth(g, g.withColumn("allele_index", F.when(wrong, F.col("allele_index") + 1).otherwise(F.col("allele_index"))))


_SAID = [*[s.capitalize() for s in genetics.SIGNIFICANCE], "not provided"]
_SIGNIFICANCE = "case p_partkey % 12 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(_SAID)) + " end"
_PRIORITIES = "case " + " ".join(f"when contains(lower(significance), '{s}') then {i + 1}" for i, s in enumerate(genetics.SIGNIFICANCE)) + f" else {genetics.OTHER_PRIORITY} end"


@on(f"""with v as (select l_orderkey % 50 as patient_id, 'rs' || p_partkey as rsid, {_SIGNIFICANCE} as significance, p_partkey as row_no from lineitem join part on p_partkey = l_partkey where p_partkey % 3 <> 0 and l_linenumber <> 2),
d as (select patient_id, rsid, min(significance) as significance, min(row_no) as row_no from v group by 1, 2), k as (select *, row_number() over (partition by patient_id, significance order by row_no, rsid) as k from d)
select patient_id, rsid, significance, cast({_PRIORITIES} as int) as priority from k where k <= 10""")
def ag20_gene_findings(spark: SparkSession, root: str) -> DataFrame:
    j = table(spark, root, "lineitem").join(table(spark, root, "part"), F.col("l_partkey") == F.col("p_partkey"))
    said = F.element_at(F.array(*[F.lit(s) for s in _SAID]), (F.col("p_partkey") % 12 + 1).cast("int"))
    variants = j.select(
        (F.col("l_orderkey") % 50).alias("patient_id"), F.concat(F.lit("rs"), "p_partkey").alias("rsid"), F.lit("G").alias("gene"), said.alias("significance"),
        F.when(F.col("p_partkey") % 3 == 0, "A").otherwise("C").alias("allele"), F.lit("A").alias("ancestral_allele"), F.when(F.col("l_linenumber") == 2, "false").otherwise("True").alias("variant"), F.col("p_partkey").alias("row_no"),
    )
    return genetics.gene_findings(variants).select("patient_id", "rsid", "significance", "priority")


@on("""select * from (values ('a', 'a', 89), ('a', 'b', 19), ('a', 'c', -55), ('a', 'd', -53), ('b', 'a', 19), ('b', 'b', 85), ('b', 'c', -53), ('b', 'd', -51),
  ('c', 'a', -55), ('c', 'b', -53), ('c', 'c', 89), ('c', 'd', 19), ('d', 'a', -53), ('d', 'b', -51), ('d', 'c', 19), ('d', 'd', 85)) t(person_a, person_b, k)""".replace("select *", "select person_a, person_b, k / 87.0::double as covariance"))
def sm16_branch_covariance(spark: SparkSession, root: str) -> DataFrame:
    """The eight-tip tree of the fixtures."""
    pairs = ((8, 0), (8, 1), (9, 2), (9, 3), (10, 4), (10, 5), (11, 6), (11, 7), (12, 8), (12, 9), (13, 10), (13, 11), (14, 12), (14, 13))
    edges = spark.createDataFrame([(0, p, c) for p, c in pairs], "tree_id int, parent int, child int")
    times = spark.createDataFrame([*[(i, 0.0) for i in range(8)], *[(8 + i, t) for i, t in enumerate((1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 10.0))]], "node int, time double")
    owners = spark.createDataFrame([(p, n) for i, p in enumerate("abcd") for n in (2 * i, 2 * i + 1)], "person_id string, node int")
    features = genetics.branch_features(edges, times, spark.createDataFrame([(0, 10.0)], "tree_id int, span double"), owners)
    matrix = genetics.branch_covariance(features, list("abcd"))
    return spark.createDataFrame([(p, q, float(matrix[i, j])) for i, p in enumerate("abcd") for j, q in enumerate("abcd")], "person_a string, person_b string, covariance double")


QUERIES, ORACLES = registry.queries, registry.oracles
