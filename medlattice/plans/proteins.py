"""Simulation and analytics of protein readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import normal_sql, uniform_sql
from ..operators import npx, pivot
from .common import Registry, table
from .problems import _PROTEIN

registry = Registry()
on = registry.on

ARM = "case when lower(regexp_replace(\"group\", '^\\s+|\\s+$', '', 'g')) in ('baseline', 'case', 'control', 'treated', 'relapse') then lower(regexp_replace(\"group\", '^\\s+|\\s+$', '', 'g')) end"
_R = f"with {_PROTEIN}, r as (select *, {ARM} as arm from readings)"
_CELLS = f"""with {_PROTEIN}, cell as (select sample_id, protein_id, arg_max(npx, (not coalesce(qc_warning, false), measured_at, loaded_at, row_id)) as npx from readings group by 1, 2)"""


def _steady(value: Column, digits: int = 6) -> Column:
    """Rounded for comparison: means of short decimals often end in a 5, which sums in another order tip either way."""
    return F.round(value + 1e-9, digits)


def _readings(spark: SparkSession, root: str) -> DataFrame:
    return npx.usable(table(spark, root, "olink_npx"), table(spark, root, "olink_panels"))


def _cells(spark: SparkSession, root: str) -> DataFrame:
    return pivot.agreed_cells(table(spark, root, "olink_npx"), table(spark, root, "olink_panels"))


SIMULATED = npx.SimulationConfig(
    200, npx.default_panel(12), groups=tuple("case" if i % 2 else "baseline" for i in range(200)), effects={"case": {"PROT0001": 2.0, "PROT0002": -1.0}}, missing_rate=0.1, seed=11
)
_SIM = f"""
select 'S' || lpad(cast(i as varchar), 4, '0') as sample_id, p as protein_id, round(x, 6) as npx, {uniform_sql("'11'", "'qc'", 'i', 'p')} < 0.01 as qc_warning, g as "group", 'plate_' || cast(i // 96 as varchar) as plate_id
from (
  select i, 'PROT' || lpad(cast(k as varchar), 4, '0') as p, case when i % 2 = 1 then 'case' else 'baseline' end as g,
    5.0 + 0.15 * {normal_sql("'11'", "'plate'", 'i // 96')} + case when i % 2 = 1 and k = 1 then 2.0 when i % 2 = 1 and k = 2 then -1.0 else 0 end
      + 0.6 * {normal_sql("'11'", "'eps'", 'i', "'PROT' || lpad(cast(k as varchar), 4, '0')")} as x
  from range(200) a(i), range(1, 13) b(k)
) where (x >= 3.0 or {uniform_sql("'11'", "'lod'", 'i', 'p')} >= 0.8) and {uniform_sql("'11'", "'miss'", 'i', 'p')} >= 0.1"""


@on(_SIM)
def sm01_simulated_readings(spark: SparkSession, root: str) -> DataFrame:
    return npx.simulate(spark, SIMULATED).withColumn("npx", F.round("npx", 6))


@on(f"{_R} select protein_id, round(avg(npx) + 1e-9, 6) as mean_npx, count(*) as n, count(distinct sample_id) as n_samples, round(1 - count(distinct sample_id) / (select count(distinct sample_id) from r) + 1e-9, 6) as drop_rate from r group by 1")
def ag09_protein_stats(spark: SparkSession, root: str) -> DataFrame:
    """Also SO05 and AG18: ordered by mean, with the share of samples that lack the protein."""
    return npx.protein_stats(_readings(spark, root)).withColumns({c: _steady(F.col(c)) for c in ("mean_npx", "drop_rate")})


@on(f"{_R} select protein_id, round(avg(npx) + 1e-9, 6) as mean_npx, count(*) as n from r group by 1 order by avg(npx) desc, protein_id limit 10")
def so05_top_proteins(spark: SparkSession, root: str) -> DataFrame:
    return npx.protein_stats(_readings(spark, root), top=10).select("protein_id", _steady(F.col("mean_npx")).alias("mean_npx"), "n")


@on(f"{_R}, d as (select protein_id, avg(npx) filter (arm = 'case') as a, avg(npx) filter (arm = 'baseline') as b from r group by 1) select protein_id, round(a + 1e-9, 6) as case_mean, round(b + 1e-9, 6) as control_mean, round(a - b + 1e-9, 6) as delta from d")
def ag10_group_deltas(spark: SparkSession, root: str) -> DataFrame:
    return npx.group_deltas(_readings(spark, root)).select("protein_id", *[_steady(F.col(c)).alias(c) for c in ("case_mean", "control_mean", "delta")])


_W = f"""{_R}, w as (select protein_id, avg(npx) filter (arm = 'case') as ma, var_samp(npx) filter (arm = 'case') as va, count(*) filter (arm = 'case') as na,
  avg(npx) filter (arm = 'baseline') as mb, var_samp(npx) filter (arm = 'baseline') as vb, count(*) filter (arm = 'baseline') as nb from r group by 1)"""


@on(f"""{_W} select protein_id, na as n_case, nb as n_control, round((ma - mb) / sqrt(va / na + vb / nb), 5) as t, round((va / na + vb / nb)^2 / ((va / na)^2 / (na - 1) + (vb / nb)^2 / (nb - 1)), 3) as df from w where na >= 3 and nb >= 3""")
def ag11_welch_moments(spark: SparkSession, root: str) -> DataFrame:
    return npx.welch(_readings(spark, root), p_values=False).select("protein_id", "n_case", "n_control", F.round("t", 5).alias("t"), F.round("df", 3).alias("df"))


@on()
def ag11_welch_tests(spark: SparkSession, root: str) -> DataFrame:
    return npx.welch(_readings(spark, root))


@on(f"""{_CELLS}, top as (select protein_id from cell group by 1 order by avg(npx) desc, protein_id limit 25), k as (select cell.* from cell join top using (protein_id))
select a.protein_id as protein_a, b.protein_id as protein_b, round(case when count(*) > 1 then corr(a.npx, b.npx) end, 4) as r, count(*) as n from k a join k b using (sample_id) where a.protein_id <= b.protein_id and a.protein_id <> b.protein_id group by 1, 2 having count(*) > 2""")
def ag12_correlations(spark: SparkSession, root: str) -> DataFrame:
    return npx.correlations(_cells(spark, root)).where("protein_a <> protein_b and n > 2").withColumn("r", F.round("r", 4))


def _grid_proteins(spark: SparkSession, root: str) -> list[str]:
    return pivot.attribute_list(table(spark, root, "olink_panels"), "protein_id")


@on(f"""{_CELLS}, chosen as (select distinct protein_id from olink_panels), grid as (select distinct sample_id, n.protein_id from cell, chosen n), med as (select protein_id, median(npx) as m from cell group by 1)
select g.sample_id, g.protein_id, coalesce(c.npx, m.m) as npx, c.npx is null as filled from grid g left join cell c on c.sample_id = g.sample_id and c.protein_id = g.protein_id left join med m on m.protein_id = g.protein_id""")
def ag13_median_filled(spark: SparkSession, root: str) -> DataFrame:
    return npx.median_filled(_cells(spark, root), _grid_proteins(spark, root))


@on()
def ag14_principal_components(spark: SparkSession, root: str) -> DataFrame:
    return npx.principal_components(_cells(spark, root), _grid_proteins(spark, root))


@on(f"{_R} select round(avg(qc_warning::int) + 1e-9, 6) as qc_rate, count(*) as n_readings, count(distinct sample_id) as n_samples, count(distinct protein_id) as n_proteins from r")
def ag18_qc_rate(spark: SparkSession, root: str) -> DataFrame:
    return _readings(spark, root).agg(_steady(F.avg(F.col("qc_warning").cast("int"))).alias("qc_rate"), F.count("*").alias("n_readings"), F.countDistinct("sample_id").alias("n_samples"), F.countDistinct("protein_id").alias("n_proteins"))


@on("with n as (select plate_id, npx from olink_npx where npx between -10 and 25 and not isnan(npx)) select plate_id, round(avg(npx) + 1e-9, 6) as mean_npx, count(*) as n from n group by 1")
def ag19_plate_means(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "olink_npx").select("plate_id", npx.usable_npx(F.col("npx")).alias("npx")).where("npx is not null")
    return rows.groupBy("plate_id").agg(_steady(F.avg("npx")).alias("mean_npx"), F.count("*").alias("n"))


def _catalogue(spark: SparkSession, root: str) -> DataFrame:
    """Effects of the arms against baseline as a catalogue of the effects' shape."""
    d = npx.group_deltas(_readings(spark, root)).where("delta is not null")
    return d.select(F.lit("case").alias("disease"), F.col("protein_id").alias("protein_uniprot"), _steady(F.col("delta"), 4).alias("delta_npx"), F.lit(0.1).alias("se_delta"))


@on(f"{_R}, d as (select protein_id, round(avg(npx) filter (arm = 'case') - avg(npx) filter (arm = 'baseline') + 1e-9, 4) as delta from r group by 1) select protein_id as protein_uniprot, delta as delta_npx from d where abs(delta) > 0")
def prj02_effect_map(spark: SparkSession, root: str) -> DataFrame:
    """Also FLT10: effects of zero are none."""
    made = npx.effect_map(_catalogue(spark, root), ["case"])
    return made.select("protein_uniprot", F.col("effects")["case"].alias("delta_npx"))


@on("select distinct panel, count(distinct protein_id) as n_proteins from olink_panels group by panel")
def prj01_distinct_lists(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "olink_panels").groupBy("panel").agg(F.countDistinct("protein_id").alias("n_proteins")).orderBy("panel")


QUERIES, ORACLES = registry.queries, registry.oracles
