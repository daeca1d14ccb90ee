"""The queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import canonical_id_sql
from ..functions.npx import GROUPS
from ..session import state_folder
from . import leaks, mixing, quantiles, splits, stuffing

#: The stated relative error of the percentile queries.
ERROR = 0.005
#: When the second delivery of readings begins.
SECOND_DELIVERY = date(2023, 1, 1)
#: How far a source's share may be from its planned weight in the check of mixtures.
MIX_SLACK = 0.01
#: Tokens of the tempered mixture as a multiple of those that its sources have.
MIX_PASSES = 1.35


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return splits.same_entity(splits.memberships(table(spark, root, "clinical_tasks"), table(spark, root, "patient_links")))


def _p1_rows(spark: SparkSession, root: str) -> DataFrame:
    return splits.split_rows(table(spark, root, "clinical_tasks"), table(spark, root, "patient_links"))


def p1_splits(spark: SparkSession, root: str) -> DataFrame:
    return _p1_rows(spark, root).select("task_row", "patient_id", "assigned_split")


def p1_split_report(spark: SparkSession, root: str) -> DataFrame:
    return splits.split_report(_p1_rows(spark, root))


def p1_split_check(spark: SparkSession, root: str) -> DataFrame:
    return splits.split_check(table(spark, root, "clinical_tasks"), table(spark, root, "patient_links"))


def p6_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """From day sketches that are kept for later days to be added."""
    days = quantiles.keep_days(state_folder(spark, "percentiles"), table(spark, root, "olink_npx"), table(spark, root, "olink_panels"), ERROR)
    return quantiles.npx_percentiles(days, error=ERROR)


def p6_monthly_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """From day sketches of two deliveries, kept one after the other."""
    npx, panels, store = table(spark, root, "olink_npx"), table(spark, root, "olink_panels"), state_folder(spark, "percentiles")
    early = F.coalesce(F.col("loaded_at") < F.lit(SECOND_DELIVERY).cast("timestamp_ntz"), F.lit(True))
    quantiles.keep_days(store, npx.where(early), panels, ERROR, 0)
    days = quantiles.keep_days(store, npx.where(~early), panels, ERROR, 1)
    return quantiles.npx_percentiles(days, F.date_format("day", "yyyy-MM"), error=ERROR)


def p8_leaks(spark: SparkSession, root: str) -> DataFrame:
    return leaks.find_leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return p8_leaks(spark, root).select("doc_id", "item_id").distinct()


def p8_leaks_by_item(spark: SparkSession, root: str) -> DataFrame:
    return leaks.leaks_by_item(p8_leaks(spark, root))


def p9_mix(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(table(spark, root, "documents"), table(spark, root, "mix_targets"))[0]


def p9_mix_report(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(table(spark, root, "documents"), table(spark, root, "mix_targets"))[1]


def p9_tempered_mix_report(spark: SparkSession, root: str) -> DataFrame:
    """More tokens than the targets alone can give: the exponent is bisected."""
    return mixing.mix(table(spark, root, "documents"), table(spark, root, "mix_targets"), passes=MIX_PASSES)[1]


def p9_mix_check(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix_check(table(spark, root, "documents"), p9_mix_report(spark, root), MIX_SLACK)


def p9_tempered_mix_check(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix_check(table(spark, root, "documents"), p9_tempered_mix_report(spark, root), MIX_SLACK)


def p10_scores(spark: SparkSession, root: str) -> DataFrame:
    return stuffing.score_pages(table(spark, root, "documents"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return p10_scores(spark, root).where("stuffed").select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_splits, p1_split_report, p1_split_check, p6_percentiles, p6_monthly_percentiles, p8_found, p8_leaks, p8_leaks_by_item, p9_mix, p9_mix_report, p9_tempered_mix_report, p9_mix_check, p9_tempered_mix_check, p10_found, p10_scores)}


def _entity_sql(column: str) -> str:
    return f"(case when trim(regexp_replace({column}, '\\s+', ' ', 'g')) <> '' then coalesce({canonical_id_sql(column)}, 'raw:' || {column}) end)"


_P1_FOUND = f"""
with recursive v as (select distinct patient_id, {_entity_sql('patient_id')} as k from clinical_tasks where patient_id <> ''),
l as (
  select least({_entity_sql('old_id')}, {_entity_sql('new_id')}) as a, greatest({_entity_sql('old_id')}, {_entity_sql('new_id')}) as b,
    lower(trim(regexp_replace(status, '\\s+', ' ', 'g'))) as status, linked_at, loaded_at, link_id
  from patient_links where {_entity_sql('old_id')} is not null and {_entity_sql('new_id')} is not null
),
e as (select a, b from l where a <> b group by 1, 2 having arg_max(status, (linked_at, loaded_at, link_id)) = 'confirmed'),
both_ways as (select a, b from e union select b, a from e),
reach(n, c) as (select a, a from both_ways union select b.b, r.c from reach r join both_ways b on b.a = r.n),
comp as (select n, min(c) as c from reach group by 1),
g as (select v.patient_id, coalesce(comp.c, v.k, 'blank:' || v.patient_id) as c from v left join comp on comp.n = v.k),
f as (select c, min(patient_id) as first from g group by 1)
select f.first as patient_id_a, g.patient_id as patient_id_b from g join f using (c) where g.patient_id <> f.first"""


def _p6_sql(period: str) -> str:
    width, offset = quantiles._shape(ERROR)
    arm = f"case when lower(regexp_replace(n.\"group\", '^\\s+|\\s+$', '', 'g')) in {GROUPS} then lower(regexp_replace(n.\"group\", '^\\s+|\\s+$', '', 'g')) end"
    picks = ",\n".join(
        f"min(case when upto > floor({q} * (whole - 1)) then bucket end) as b{i}" for i, q in enumerate((0.05, 0.25, 0.5, 0.75, 0.95))
    )
    value = lambda b: f"case when {b} = 0 then 0.0 else sign({b}) * exp((abs({b}) - {offset}) * {width!r}::double) * {1 - ERROR}::double end"
    values = ",\n".join(f"{value(f'b{i}')} as {quantiles.name_of(q)}" for i, q in enumerate((0.05, 0.25, 0.5, 0.75, 0.95)))
    return f"""
with names as (select distinct protein_id, upper(protein_id) as k from olink_panels),
places as (select panel, assay_no, min(protein_id) as protein_id from olink_panels group by all),
r as (
  select coalesce(a.protein_id, b.protein_id) as protein_id, {arm} as arm, {period} as period, n.npx as x
  from olink_npx n
  left join names a on a.k = regexp_replace(regexp_replace(upper(n.protein_id), '^\\s*[A-Z]+:', ''), '[^A-Z0-9]', '', 'g')
  left join places b on b.panel = n.panel and b.assay_no = n.assay_no
  where n.npx between -10 and 25 and not isnan(n.npx) and coalesce(a.protein_id, b.protein_id) is not null
),
s as (select *, case when abs(x) < 1e-9 then 0 else cast(sign(x) * (ceil(ln(abs(x)) / {width!r}::double) + {offset}) as int) end as bucket from r),
k as (
  select 'protein' as scope, protein_id, null as "group", period, bucket, count(*) as n from s group by all
  union all select 'protein_group', protein_id, arm, period, bucket, count(*) from s where arm is not null group by all
),
c as (select *, sum(n) over (partition by scope, protein_id, "group", period order by bucket) as upto, sum(n) over (partition by scope, protein_id, "group", period) as whole from k),
p as (select scope, protein_id, "group", period, cast(max(whole) as bigint) as n_values, {picks} from c group by 1, 2, 3, 4)
select scope, protein_id, "group", period, n_values, {values}, {ERROR}::double as relative_error from p"""


def _p9_sql(tempered: bool) -> str:
    plain = "nullif(regexp_replace(regexp_replace(lower(source), '^\\s+|\\s+$', '', 'g'), '[\\s_-]+', '_', 'g'), '')"
    return f"""
      with t as (select {plain} as source, min(max_repeats) as max_repeats from mix_targets group by 1),
      d as (select {plain} as source, count(*) as n from documents where length(text) > 0 group by 1)
      select t.source, t.max_repeats, coalesce(d.n, 0) as n_documents, true as repeats_kept, true as as_planned, {tempered} as tempered from t left join d using (source)"""


ORACLES = {
    "p9_mix_check": _p9_sql(False),
    "p9_tempered_mix_check": _p9_sql(True),
    "p1_found": _P1_FOUND,
    "p1_split_check": """
      with c as (select coalesce(task, '(none)') as scope, count(*) as n_rows from clinical_tasks group by 1 union all select '(all)', count(*) from clinical_tasks)
      select scope, split, n_rows, true as as_wanted, cast(0 as bigint) as torn from c cross join (values ('train'), ('validation'), ('test')) s(split)""",
    "p6_percentiles": _p6_sql("'all'"),
    "p6_monthly_percentiles": _p6_sql("strftime(n.measured_at, '%Y-%m')"),
}
