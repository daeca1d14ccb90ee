"""Bundles into fact tables, and cohorts over them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import canonical_id, canonical_id_sql
from ..operators import fhir
from ..session import cut
from .common import Registry, table

registry = Registry()
on = registry.on


#: Bundles with the kinds of resources that the tables hold none of, put beside them where a query is about these.
_CODE = {"coding": [{"system": "http://codes.example/rx", "code": "4711", "display": "Fenvelin 20 mg"}]}
MORE_BODIES = [
    json.dumps({"resourceType": "Bundle", "entry": [{"resource": r} for r in ({"resourceType": "Patient", "id": f"extra-{i}", "gender": "female", "name": [{"family": "Extra"}]}, *rest)]})
    for i, rest in enumerate((
        [{"resourceType": "MedicationRequest", "status": "active", "authoredOn": "2021-03-04", "medicationCodeableConcept": _CODE, "code": _CODE}, {"resourceType": "MedicationRequest", "medicationCodeableConcept": _CODE}],
        [{"resourceType": "Procedure", "status": "completed", "code": {"coding": {"code": "88", "display": "Hip scan"}}, "performedPeriod": {"start": "2020-01-02"}}],
        [{"resourceType": "Procedure", "code": {"text": "Free text"}, "performedDateTime": "2019-05-06T10:00:00Z"}, {"resourceType": "MedicationRequest", "status": "stopped", "code": _CODE, "medicationCodeableConcept": _CODE}],
        [],
    ))
]


class Bundles:
    def __init__(self, spark: SparkSession, root: str, more: bool = False, written: bool = False):
        records = table(spark, root, "fhir_records").select("record_id", "body")
        if more:
            records = records.unionByName(spark.createDataFrame([(-1 - i, b) for i, b in enumerate(MORE_BODIES)], "record_id long, body string"))
        self.found = fhir.resources(records)
        if written:  # bodies are parsed once where a query looks at them several times
            self.found = cut(self.found)
        self.people = fhir.demographics(self.found)
        # several records may hold one patient; the cohort has the one of the last record
        first = self.people.where("id is not null").groupBy("id").agg(F.max_by(F.struct("name", "gender", "birth_date"), F.struct("record_id", "pos")).alias("p"))
        self.cohort = first.select("id", "p.*")


_J = "json_extract_string"
FHIR_SQL = f"""
raw as (select record_id, trim(ltrim(body, chr(65279)), ' ' || chr(9) || chr(10) || chr(13)) as b from fhir_records),
ok as (select record_id, case when json_valid(b) then b end as b from raw),
un as (select record_id, case when json_type(b) = 'VARCHAR' then (case when json_valid({_J}(b, '$')) then {_J}(b, '$') end) else b end as b from ok where b is not null),
listed as (
  select record_id, case when coalesce({_J}(b, '$.resourceType') = 'Bundle', false) or coalesce(json_type(b, '$.entry') <> 'NULL', false)
    then case json_type(b, '$.entry') when 'ARRAY' then list_transform(json_extract(b, '$.entry[*]'), lambda e: json_extract(e, '$.resource')) when 'OBJECT' then [json_extract(b, '$.entry.resource')] else []::json[] end
    else [b::json] end as all_r
  from un where b is not null and json_type(b) <> 'NULL'
),
owned as (select record_id, all_r, {_J}(list_filter(all_r, lambda r: coalesce({_J}(r, '$.resourceType') = 'Patient', false))[1], '$.id') as patient_id from listed),
res as (select * from (select record_id, patient_id, unnest(all_r) as r, unnest(range(len(all_r))) as pos from owned) where r is not null and json_type(r) <> 'NULL')"""


FHIR_MORE = FHIR_SQL.replace("from fhir_records", "from (select record_id, body from fhir_records union all select * from (values " + ", ".join(f"({-1 - i}, '{b}')" for i, b in enumerate(MORE_BODIES)) + ") x(record_id, body))")


def _first(*paths: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({_J}(r, '{p}'), '')" for p in paths) + ", null)"


_CODED = f"""record_id, patient_id, cast(pos as int) as pos, {_first('$.code.coding[0].code', '$.code.coding.code')} as code, {_first('$.code.coding[0].display', '$.code.coding.display', '$.code.text')} as display,
{_first('$.code.coding[0].system', '$.code.coding.system')} as system"""


@on(f"with {FHIR_SQL} select record_id, patient_id, cast(pos as int) as pos, {_J}(r, '$.resourceType') as resource_type from res")
def fh07_resources(spark: SparkSession, root: str) -> DataFrame:
    """Also FH08: every resource carries its bundle's first patient."""
    return Bundles(spark, root).found.select("record_id", "patient_id", "pos", "resource_type")


@on(f"""with {FHIR_SQL} select record_id, cast(pos as int) as pos, {_first('$.id')} as id, {_first('$.name[0].family', '$.name.family')} as family, {_first('$.gender')} as gender, {_first('$.birthDate')} as birth_date,
{_first('$.maritalStatus.text', '$.maritalStatus.coding[0].display')} as marital_status from res where {_J}(r, '$.resourceType') = 'Patient'""")
def fh01_demographics(spark: SparkSession, root: str) -> DataFrame:
    return Bundles(spark, root).people.select("record_id", "pos", "id", "family", "gender", "birth_date", "marital_status")


@on()
def fh01_names_and_addresses(spark: SparkSession, root: str) -> DataFrame:
    return Bundles(spark, root).people.select("record_id", "pos", "name", "given", "address", "phone")


@on(f"with {FHIR_SQL} select {_CODED}, {_first('$.onsetDateTime', '$.onsetPeriod.start')} as onset_date from res where {_J}(r, '$.resourceType') = 'Condition'")
def fh02_conditions(spark: SparkSession, root: str) -> DataFrame:
    return fhir.conditions(Bundles(spark, root).found).drop("clinical_status")


@on(f"with {FHIR_MORE} select record_id, patient_id, cast(pos as int) as pos, {_first('$.status')} as status, {_first('$.authoredOn')} as authored_on from res where {_J}(r, '$.resourceType') = 'MedicationRequest'")
def fh03_medications(spark: SparkSession, root: str) -> DataFrame:
    return fhir.medications(Bundles(spark, root, True).found).select("record_id", "patient_id", "pos", "status", "authored_on")


@on(f"with {FHIR_SQL} select record_id, patient_id, cast(pos as int) as pos, {_first('$.id')} as id, {_first('$.type[0].coding[0].display', '$.type[0].text', '$.code.coding[0].display')} as type, {_first('$.status')} as status, {_first('$.period.start')} as start from res where {_J}(r, '$.resourceType') = 'Encounter'")
def fh04_encounters(spark: SparkSession, root: str) -> DataFrame:
    return fhir.encounters(Bundles(spark, root).found).select("record_id", "patient_id", "pos", "id", "type", "status", "start")


@on(f"""with {FHIR_SQL} select {_CODED}, try_cast({_J}(r, '$.valueQuantity.value') as double) as value_num,
case when try_cast({_J}(r, '$.valueQuantity.value') as double) is null then {_first('$.valueCodeableConcept.text', '$.valueCodeableConcept.coding[0].display', '$.valueString')} end as value_str,
{_first('$.valueQuantity.unit')} as unit from res where {_J}(r, '$.resourceType') = 'Observation'""")
def fh05_observations(spark: SparkSession, root: str) -> DataFrame:
    return fhir.observations(Bundles(spark, root).found).drop("date", "category")


@on(f"with {FHIR_MORE} select {_CODED}, {_first('$.status')} as status, {_first('$.performedDateTime', '$.performedPeriod.start')} as performed_date from res where {_J}(r, '$.resourceType') = 'Procedure'")
def fh06_procedures(spark: SparkSession, root: str) -> DataFrame:
    return fhir.procedures(Bundles(spark, root, True).found)


_PEOPLE = f"""{FHIR_SQL},
person as (select id, arg_max(g, k) as g from (select {_first('$.id')} as id, {{'gender': {_first('$.gender')}, 'family': {_first('$.name[0].family', '$.name.family')}}} as g, (record_id, pos) as k from res where {_J}(r, '$.resourceType') = 'Patient') where id is not null group by 1),
fact as (select {_CODED}, {_J}(r, '$.resourceType') as kind, try_cast({_J}(r, '$.valueQuantity.value') as double) as value_num from res)"""


@on(f"with {_PEOPLE} select id from person where id in (select patient_id from fact where kind = 'Condition' and (lower(display) like '%stenosis%' or code = 'stenosis'))")
def flt03_with_condition(spark: SparkSession, root: str) -> DataFrame:
    b = Bundles(spark, root, written=True)
    return fhir.with_fact(b.cohort, fhir.conditions(b.found), "Stenosis").select("id")


@on(f"with {_PEOPLE.replace(FHIR_SQL, FHIR_MORE)} select id from person where id in (select patient_id from fact where kind = 'MedicationRequest')")
def flt04_with_medication(spark: SparkSession, root: str) -> DataFrame:
    b = Bundles(spark, root, True, True)
    return fhir.with_fact(b.cohort, fhir.medications(b.found), "").select("id")


@on(f"with {_PEOPLE} select id from person where lower(g.gender) = 'female'")
def flt05_with_gender(spark: SparkSession, root: str) -> DataFrame:
    return fhir.with_gender(Bundles(spark, root).cohort, "FEMALE").select("id")


@on(f"with {_PEOPLE} select id from person where id in (select patient_id from fact where kind in ('Condition', 'MedicationRequest') and lower(display) like '%hepatic%')")
def flt06_search(spark: SparkSession, root: str) -> DataFrame:
    b = Bundles(spark, root, written=True)
    return fhir.search(b.cohort, fhir.conditions(b.found), fhir.medications(b.found), "hepatic").select("id")


@on(f"with {_PEOPLE} select id from person where id in (select patient_id from fact where kind = 'Observation' and lower(display) like '%a%' and (value_num is null or value_num between 10 and 50))")
def flt07_with_observation(spark: SparkSession, root: str) -> DataFrame:
    b = Bundles(spark, root, written=True)
    return fhir.with_observation(b.cohort, fhir.observations(b.found), display="A", low=10.0, high=50.0).select("id")


@on(f"with {_PEOPLE} select id from person where id like '7%' order by id limit 1")
def flt08_by_prefix(spark: SparkSession, root: str) -> DataFrame:
    return fhir.by_prefix(Bundles(spark, root).cohort, "7").select("id")


def _index(spark: SparkSession, root: str) -> DataFrame:
    return fhir.merge_modalities({
        "fhir": Bundles(spark, root).cohort.select(canonical_id("id").alias("id")),
        "notes": table(spark, root, "documents").select(canonical_id("patient_id").alias("id")).distinct(),
        "genomics": table(spark, root, "encounters").where("REASONCODE is not null").select(canonical_id("PATIENT").alias("id")).distinct(),
    })


_INDEX = f"""{_PEOPLE},
lists as (select {canonical_id_sql('id')} as id, 'fhir' as m from person union select {canonical_id_sql('patient_id')}, 'notes' from documents union select {canonical_id_sql('PATIENT')}, 'genomics' from encounters where REASONCODE is not null),
idx as (select id, string_agg(m, ',' order by m) as modalities from lists where id is not null group by 1)"""


@on(f"with {_INDEX} select id, modalities from idx")
def jn17_modality_index(spark: SparkSession, root: str) -> DataFrame:
    return _index(spark, root).withColumn("modalities", F.array_join("modalities", ","))


@on(f"with {_INDEX} select id from idx where modalities like '%fhir%' and modalities like '%notes%'")
def flt02_with_modalities(spark: SparkSession, root: str) -> DataFrame:
    return fhir.with_modality(_index(spark, root), ["fhir", "notes"]).select("id")


@on(f"with {_INDEX} select count(*) as n_patients, count_if(modalities like '%fhir%')::bigint as with_fhir, count_if(modalities like '%notes%')::bigint as with_notes, count_if(modalities like '%genomics%')::bigint as with_genomics, count_if(modalities = 'fhir,genomics,notes')::bigint as with_all from idx")
def fh12_dataset_summary(spark: SparkSession, root: str) -> DataFrame:
    return fhir.summary(_index(spark, root))


@on(f"with {_PEOPLE} select id, g.gender as gender, (select count(*) from fact where patient_id = id and kind = 'Condition') as n_conditions, (select count(*) from fact where patient_id = id and kind = 'MedicationRequest') as n_medications from person")
def fh11_patient_rows(spark: SparkSession, root: str) -> DataFrame:
    """Also FH13: the counts of one patient."""
    b = Bundles(spark, root, written=True)
    return fhir.dataset_rows(b.cohort, fhir.conditions(b.found), fhir.medications(b.found)).select("id", "gender", "n_conditions", "n_medications")


@on()
def fh14_sample(spark: SparkSession, root: str) -> DataFrame:
    return fhir.sample(Bundles(spark, root).cohort, 20, seed=3)


_NEEDLES = (("fibrosis", "fibrosis"), ("effusion", "effusion"), ("oedema", "effusion"), ("stenosis", "stenosis"))


@on(f"""with {_PEOPLE}, m(needle, flag) as (values {', '.join(str(n) for n in _NEEDLES)}), hit as (select distinct patient_id, flag from fact join m on contains(lower(display), needle) where kind = 'Condition')
select id, coalesce((select string_agg(flag, ',' order by flag) from hit where patient_id = id), 'normal') as flags from person""")
def fh15_imaging_conditions(spark: SparkSession, root: str) -> DataFrame:
    b = Bundles(spark, root, written=True)
    made = fhir.imaging_flags(b.cohort, fhir.conditions(b.found), spark.createDataFrame(list(_NEEDLES), "needle string, flag string"))
    return made.withColumn("flags", F.array_join("flags", ","))


@on(f"with {_PEOPLE} select patient_id, record_id, pos, code, display from fact where kind = 'Condition' and code like '7%5'")
def flt01_predicate(spark: SparkSession, root: str) -> DataFrame:
    """A predicate is a Column; it is pushed as far down as it goes."""
    found = fhir.conditions(Bundles(spark, root).found)
    return found.where(F.col("code").like("7%5")).select("patient_id", "record_id", "pos", "code", "display")


QUERIES, ORACLES = registry.queries, registry.oracles
