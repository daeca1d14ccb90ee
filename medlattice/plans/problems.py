"""The data-pipeline queries of the core operators, with SQL oracles where SQL can state them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import canonical_id_sql
from ..operators import features, flatten, impute, orphans, pivot
from ..session import state_folder
from .cohorts import FHIR_SQL

#: The day the feature table describes.
FEATURES_AS_OF = date(2024, 6, 15)
#: When the second delivery to the store of features begins.
FEATURES_CUT = date(2024, 1, 1)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return orphans.clinical_replay(spark, root).orphans.select("table_name", "field_name", "row_id")


def p2_orphan_counts(spark: SparkSession, root: str) -> DataFrame:
    return orphans.snapshot(orphans.clinical_replay(spark, root))


def p2_orphan_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """The counts at the end of each of four periods."""
    return orphans.snapshots(orphans.clinical_replay(spark, root, 4)).drop("until")


def _p3(what: str):
    def query(spark: SparkSession, root: str) -> DataFrame:
        return flatten.flatten(table(spark, root, "fhir_records"), what)

    query.__name__ = f"p3_{what}"
    return query


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return flatten.objects(flatten.flatten(table(spark, root, "fhir_records"), "items"))


def p4_filled(spark: SparkSession, root: str) -> DataFrame:
    return impute.fill(table(spark, root, "olink_npx"), table(spark, root, "olink_panels"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return impute.filled_fields(p4_filled(spark, root))


def p4_hidden_error(spark: SparkSession, root: str) -> DataFrame:
    return impute.hidden_error(table(spark, root, "olink_npx"), table(spark, root, "olink_panels"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return pivot.conflicting_cells(table(spark, root, "olink_npx"), table(spark, root, "olink_panels"))


def p5_wide(spark: SparkSession, root: str) -> DataFrame:
    return pivot.wide_npx(table(spark, root, "olink_npx"), table(spark, root, "olink_panels"))


def p5_wide_long_view(spark: SparkSession, root: str) -> DataFrame:
    """The wide table's cells as rows, so that SQL can check them without naming every column."""
    panels = table(spark, root, "olink_panels")
    names = pivot.attribute_list(panels, "protein_id")
    return pivot.melt(pivot.wide_npx(table(spark, root, "olink_npx"), panels), "sample_id", {n: n for n in names}, "protein_id", "npx")


def p7_feature_table(spark: SparkSession, root: str) -> DataFrame:
    return features.feature_table(table(spark, root, "conditions"), FEATURES_AS_OF)


def p7_features_long(spark: SparkSession, root: str) -> DataFrame:
    """The cells of the feature table, from a store that takes the rows in by two deliveries."""
    conditions, store = table(spark, root, "conditions"), state_folder(spark, "features")
    early = F.coalesce(F.col("loaded_at") < F.lit(FEATURES_CUT).cast("timestamp_ntz"), F.lit(True))
    features.update_store(store, conditions.where(early))
    partials, events = features.update_store(store, conditions.where(~early))
    return features.long_features(partials, events, FEATURES_AS_OF).withColumn("patient", F.lower(F.hex("patient")))


QUERIES = {f.__name__: f for f in (p2_found, p2_orphan_counts, p2_orphan_snapshots, p3_found, *map(_p3, flatten.SCHEMAS), p4_found, p4_filled, p4_hidden_error, p5_found, p5_wide, p5_wide_long_view, p7_feature_table, p7_features_long)}

_KEY = canonical_id_sql
_REFS = f"""
refs as (
  select 'conditions' as table_name, 'PATIENT' as field_name, 'patients' as parent, row_id, {_KEY('PATIENT')} as k, loaded_at
  from conditions where trim(regexp_replace(PATIENT, '\\s+', ' ', 'g')) <> ''
  union all
  select 'encounters', 'PATIENT', 'patients', row_id, {_KEY('PATIENT')}, loaded_at
  from encounters where trim(regexp_replace(PATIENT, '\\s+', ' ', 'g')) <> ''
  union all
  select 'conditions', 'ENCOUNTER', 'encounters', row_id, {_KEY('ENCOUNTER')}, loaded_at from conditions where ENCOUNTER is not null
),
parents as (
  select 'patients' as parent, {_KEY('Id')} as k, loaded_at as start, coalesce(deleted_at, timestamp '9999-12-31') as stop from patients
  union all
  select 'encounters', {_KEY('Id')}, loaded_at, timestamp '9999-12-31' from encounters
),
judged as (
  select r.*, not exists (select 1 from parents p where p.parent = r.parent and p.k = r.k and p.start <= r.loaded_at and p.stop > r.loaded_at) as orphan,
    not exists (select 1 from parents p where p.parent = r.parent and p.k = r.k and p.stop >= timestamp '9999-12-31') as still_open
  from refs r
)"""
_PROTEIN = """
names as (select distinct protein_id, upper(protein_id) as k from olink_panels),
places as (select panel, assay_no, min(protein_id) as protein_id from olink_panels group by all),
readings as (
  select n.sample_id, coalesce(a.protein_id, b.protein_id) as protein_id, n.npx, n.qc_warning, n.measured_at, n.loaded_at, n.row_id, n."group"
  from olink_npx n
  left join names a on a.k = regexp_replace(regexp_replace(upper(n.protein_id), '^\\s*[A-Z]+:', ''), '[^A-Z0-9]', '', 'g')
  left join places b on b.panel = n.panel and b.assay_no = n.assay_no
  where n.npx between -10 and 25 and not isnan(n.npx) and n.sample_id is not null and coalesce(a.protein_id, b.protein_id) is not null
)"""
_ENTRIES = f"""
raw as (
  select {_KEY('PATIENT')} as patient, coalesce({_KEY('ENCOUNTER')}, lower(trim(ENCOUNTER)), '') as encounter,
    nullif(regexp_replace(upper(CODE), '^\\s*[A-Z]+:|\\s', '', 'g'), '') as code, START as s, STOP as e from conditions
),
entry as (
  select distinct patient, encounter, code, s,
    case when e between date '{features.FIRST_DAY}' and date '{features.LAST_DAY}' then greatest(e, s) end as e
  from raw where patient is not null and code is not null and s between date '{features.FIRST_DAY}' and date '{features.LAST_DAY}'
)"""



def _members(holder: str, key: str) -> str:
    """A field that is a list or a single object, as a list."""
    return f"case json_type({holder}, '$.{key}') when 'ARRAY' then json_extract({holder}, '$.{key}[*]') when 'OBJECT' then [json_extract({holder}, '$.{key}')] else []::json[] end"


def _plain(holder: str, key: str) -> str:
    """A field that is a list or anything else, as a list."""
    return f"case json_type({holder}, '$.{key}') when 'ARRAY' then json_extract({holder}, '$.{key}[*]') when 'NULL' then []::json[] else case when json_type({holder}, '$.{key}') is null then []::json[] else [json_extract({holder}, '$.{key}')] end end"


_PLAIN_MEMBERS = f"""
  select * from (
    select record_id, pos, owner, owner_no, kind, unnest(m) as m, unnest(range(len(m))) as item_no from (
      select *, 'name' as kind, {_plain('h', 'name')} as m from holder where json_type(h) = 'OBJECT'
      union all select *, 'address', {_plain('h', 'address')} from holder where json_type(h) = 'OBJECT'))
  where json_type(m) <> 'NULL'"""
_HOLDERS = f"""{FHIR_SQL},
holder as (
  select record_id, pos, 'resource' as owner, 0 as owner_no, r as h from res
  union all select record_id, pos, 'contact', unnest(range(len(c))), unnest(c) from (select record_id, pos, {_members('r', 'contact')} as c from res)
),
member as (
  select record_id, pos, owner, owner_no, kind, unnest(m) as m, unnest(range(len(m))) as item_no from (
    select *, 'name' as kind, {_members('h', 'name')} as m from holder where json_type(h) = 'OBJECT'
    union all select *, 'address', {_members('h', 'address')} from holder where json_type(h) = 'OBJECT')
),
-- without its keys an object with content still holds a text, a number or a truth value
filled as (select *, regexp_replace(m::varchar, '"([^"\\\\]|\\\\.)*"\\s*:', '', 'g') as rest from member where json_type(m) = 'OBJECT')"""

ORACLES = {
    "p3_found": f"""with {_HOLDERS} select record_id, cast(pos as int) as entry_no, owner, cast(owner_no as int) as owner_no, kind, cast(item_no as int) as item_no
      from filled where regexp_matches(rest, '"([^"\\\\]|\\\\.)+"|[0-9]|true|false')""",
    "p3_resources": f"""with {FHIR_SQL} select record_id, cast(pos as int) as entry_no, json_extract_string(r, '$.resourceType') as resource_type, json_extract_string(r, '$.id') as resource_id from res where json_type(r) = 'OBJECT'""",
    "p3_contacts": f"""with {_HOLDERS},
      c as (select h.*, coalesce(json_extract_string(h.h, '$.relationship[0].coding[0].code'), json_extract_string(h.h, '$.relationship.coding[0].code'), json_extract_string(h.h, '$.relationship.coding.code'),
        json_extract_string(h.h, '$.relationship[0].text'), json_extract_string(h.h, '$.relationship.text')) as relationship from holder h where owner = 'contact' and json_type(h) = 'OBJECT')
      select c.record_id, cast(c.pos as int) as entry_no, json_extract_string(res.r, '$.id') as resource_id, cast(owner_no as int) as contact_no, relationship from c join res using (record_id, pos)""",
    "p3_items": f"""with {_HOLDERS}, plain as ({_PLAIN_MEMBERS})
      select p.record_id, cast(p.pos as int) as entry_no, json_extract_string(res.r, '$.id') as resource_id, owner, cast(owner_no as int) as owner_no, kind, cast(item_no as int) as item_no,
        json_type(m) = 'OBJECT' as is_object,
        json_type(m) = 'OBJECT' and regexp_matches(regexp_replace(m::varchar, '"([^"\\\\]|\\\\.)*"\\s*:', '', 'g'), '"([^"\\\\]|\\\\.)+"|[0-9]|true|false') as filled,
        case when json_type(m) = 'OBJECT' then json_extract_string(m, '$.text') else json_extract_string(m, '$') end as text,
        {', '.join(f"json_extract_string(m, '$.{t}') as {t}" for t in flatten.TEXTS if t != 'text')},
        json_extract_string(m, '$.period.start') as period_start, json_extract_string(m, '$.period.end') as period_end
      from plain p join res using (record_id, pos)""",
    "p3_leaves": f"""with {FHIR_SQL}
      select record_id, cast(pos as int) as entry_no, json_extract_string(r, '$.id') as resource_id, regexp_replace(substr(t.fullkey, 3), '\\[[0-9]+\\]', '[]', 'g') as path,
        array_to_string(regexp_extract_all(t.fullkey, '\\[([0-9]+)\\]', 1), '.') as places, json_extract_string(t.atom, '$') as value
      from res, json_tree(res.r) t where json_type(r) = 'OBJECT' and t.type not in ('OBJECT', 'ARRAY')""",
    "p3_parts": f"""with {_HOLDERS},
      part as ({' union all '.join(f"select *, '{k}' as part, unnest(v) as value, unnest(range(len(v))) as part_no from (select *, {_plain('m', k)} as v from member where json_type(m) = 'OBJECT')" for k in flatten.LISTS)})
      select p.record_id, cast(p.pos as int) as entry_no, json_extract_string(res.r, '$.id') as resource_id, owner, cast(owner_no as int) as owner_no, kind, cast(item_no as int) as item_no,
        part, cast(part_no as int) as part_no, json_extract_string(value, '$') as value
      from part p join res using (record_id, pos) where json_type(value) <> 'NULL'""",
    "p2_found": f"with {_REFS} select table_name, field_name, row_id from judged where orphan",
    "p2_orphan_counts": f"""with {_REFS} select table_name, field_name, cast(date_trunc('month', loaded_at) as date) as month,
      count(*) as n_refs, cast(count_if(orphan) as bigint) as n_orphans, cast(count_if(still_open) as bigint) as n_open from judged group by 1, 2, 3""",
    "p2_orphan_snapshots": f"""with {_REFS},
      span as (select min(epoch_us(loaded_at)) as low, max(epoch_us(loaded_at)) as high from refs),
      period as (select k as number, case when k < 3 then make_timestamp(low + (high - low) * (k + 1) // 4) else timestamp '9999-12-30' end as until from span, range(4) t(k)),
      open as (select number, until, table_name, field_name, r.loaded_at, orphan,
        not exists (select 1 from parents p where p.parent = r.parent and p.k = r.k and p.start <= until and p.stop > until) as still
        from judged r join period on r.loaded_at <= until)
      select number, table_name, field_name, cast(date_trunc('month', loaded_at) as date) as month,
        count(*) as n_refs, cast(count_if(orphan) as bigint) as n_orphans, cast(count_if(still) as bigint) as n_open from open group by 1, 2, 3, 4""",
    "p4_found": """
      with names as (select distinct upper(protein_id) as k from olink_panels),
      m as (
        select row_id,
          npx is null or isnan(npx) or npx not between -10 and 25 as a,
          coalesce(lower(regexp_replace("group", '^\\s+|\\s+$', '', 'g')), '') not in ('baseline', 'case', 'control', 'treated', 'relapse') as b,
          k is null as c
        from olink_npx left join names on k = regexp_replace(regexp_replace(upper(protein_id), '^\\s*[A-Z]+:', ''), '[^A-Z0-9]', '', 'g')
      )
      select row_id, 'npx' as field_name from m where a
      union all select row_id, 'group' from m where b
      union all select row_id, 'protein_id' from m where c""",
    "p4_hidden_error": """
      with t as (select *, cast('0x' || substr(md5(cast(row_id as varchar)), 1, 8) as bigint) % 40 as turn from olink_npx)
      select 'npx' as field_name, count(*) as n_hidden, true as better from t where turn = 0 and npx between -10 and 25 and not isnan(npx)
      union all select 'group', count(*), true from t where turn = 1 and lower(regexp_replace("group", '^\\s+|\\s+$', '', 'g')) in ('baseline', 'case', 'control', 'treated', 'relapse')""",
    "p5_found": f"""with {_PROTEIN} select sample_id, protein_id from readings group by all
      having count(*) > 1 and round(max(npx) - min(npx), 6) > 0.01""",
    "p5_wide_long_view": f"""with {_PROTEIN} select sample_id, protein_id,
      arg_max(npx, (not coalesce(qc_warning, false), measured_at, loaded_at, row_id)) as npx from readings group by all""",
    "p7_feature_table": f"""with {_ENTRIES},
      f as (select patient, code, count(*) as n, cast(date_diff('day', max(s), date '{FEATURES_AS_OF}') as bigint) as recency,
        cast(sum(date_diff('day', s, least(coalesce(e, date '{FEATURES_AS_OF}'), date '{FEATURES_AS_OF}'))) as bigint) as days
        from entry where s <= date '{FEATURES_AS_OF}' group by all),
      cell as (
        select patient as PATIENT, 'n_' || code as k, n as v from f union all select patient, 'recency_' || code, recency from f union all select patient, 'days_' || code, days from f
        union all select (select min(patient) from f), p || code, null from (select distinct code from entry) cross join (values ('n_'), ('recency_'), ('days_')) t(p))
      select PATIENT, coalesce(columns('^(n|days)_.*'), 0) as "\\0", columns('^recency_.*') from (pivot cell on k using max(v) group by PATIENT)""",
    "p7_features_long": f"""with {_ENTRIES} select patient, code, count(*) as n,
      cast(date_diff('day', max(s), date '{FEATURES_AS_OF}') as bigint) as recency_days,
      cast(sum(date_diff('day', s, least(coalesce(e, date '{FEATURES_AS_OF}'), date '{FEATURES_AS_OF}'))) as bigint) as total_days
      from entry where s <= date '{FEATURES_AS_OF}' group by all""",
}
