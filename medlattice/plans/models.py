"""The common data model, the event stream and concept look-ups."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, meds, omop
from ..operators.clean import CLEAN_SQL
from .common import Registry, table

registry = Registry()
on = registry.on


def _star(spark: SparkSession, root: str) -> DataFrame:
    """Order lines as drug or measurement records of the star schema's customers."""
    return (
        table(spark, root, "lineitem")
        .join(table(spark, root, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, root, "part"), F.col("l_partkey") == F.col("p_partkey"))
    )


def _medications(spark: SparkSession, root: str) -> DataFrame:
    day = F.to_date("l_shipdate")
    return _star(spark, root).where("l_returnflag = 'A'").select(
        F.col("o_custkey").cast("string").alias("PATIENT"), F.col("l_orderkey").cast("string").alias("ENCOUNTER"), day.alias("START"),
        F.when(F.col("l_linestatus") == "F", F.date_add(day, F.col("l_quantity").cast("int"))).alias("STOP"), F.col("p_brand").alias("CODE"),
    )


def _observations(spark: SparkSession, root: str) -> DataFrame:
    value = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity").cast("int").cast("string")).when(F.col("l_linenumber") == 3, "nan").otherwise(F.concat(F.lit("text "), F.col("p_name")))
    return _star(spark, root).where("l_returnflag = 'N'").select(
        F.col("o_custkey").cast("string").alias("PATIENT"), F.col("l_orderkey").cast("string").alias("ENCOUNTER"), F.to_date("l_shipdate").alias("DATE"),
        F.col("p_brand").alias("CODE"), value.alias("VALUE"), F.lit("mg/dL").alias("UNITS"),
    )


def _star_people(spark: SparkSession, root: str) -> DataFrame:
    return omop.person(
        table(spark, root, "customer").select(
            F.col("c_custkey").cast("string").alias("Id"), F.date_add(F.lit(date(1940, 1, 1)), (F.col("c_custkey") * 37 % 20000).cast("int")).alias("BIRTHDATE"),
            F.when(F.col("c_custkey") % 3 == 0, "M").when(F.col("c_custkey") % 3 == 1, "F").otherwise("X").alias("GENDER"),
        ),
        F.col("Id").cast("bigint"),
    )


def _star_visits(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").cast("string").alias("visit_source_value"), F.col("o_orderkey").alias("visit_occurrence_id"))


def _model(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return omop.convert(clean.clinical(spark, root), date(2024, 1, 1))


#: The generated keys stand for natural ones, so the oracles compare those.
@on(f"""with {CLEAN_SQL} select Id as person_source_value, GENDER as gender_source_value, cast(case GENDER when 'M' then 8507 when 'F' then 8532 when 'OTHER' then 8551 else 0 end as int) as gender_concept_id,
  cast(year(BIRTHDATE) as int) as year_of_birth, cast(month(BIRTHDATE) as int) as month_of_birth, cast(day(BIRTHDATE) as int) as day_of_birth from patient""")
def omop_person(spark: SparkSession, root: str) -> DataFrame:
    return _model(spark, root)["person"].select("person_source_value", "gender_source_value", "gender_concept_id", "year_of_birth", "month_of_birth", "day_of_birth")


@on(f"""with {CLEAN_SQL} select e.Id as visit_source_value, p.Id as person_source_value, cast(case lower(cls) when 'emergency' then 9203 when 'urgentcare' then 9203 when 'inpatient' then 9201 else 9202 end as int) as visit_concept_id, s as visit_start_date, e.e as visit_end_date
from encounter e left join patient p on p.Id = e.PATIENT""")
def omop_visit_occurrence(spark: SparkSession, root: str) -> DataFrame:
    m = _model(spark, root)
    return m["visit_occurrence"].join(m["person"].select("person_id", "person_source_value"), "person_id", "left").select("visit_source_value", "person_source_value", "visit_concept_id", "visit_start_date", "visit_end_date")


@on(f"""with {CLEAN_SQL} select p.Id is null as unknown_person, v.Id is null as unknown_visit, CODE as condition_source_value, c.s as condition_start_date, count(*) as n
from condition c left join patient p on p.Id = c.PATIENT left join encounter v on v.Id = c.ENCOUNTER group by all""")
def omop_condition_occurrence(spark: SparkSession, root: str) -> DataFrame:
    """Also JN01 and JN02: unknown persons get 0, unknown visits NULL."""
    facts = _model(spark, root)["condition_occurrence"]
    return facts.groupBy((F.col("person_id") == 0).alias("unknown_person"), F.col("visit_occurrence_id").isNull().alias("unknown_visit"), "condition_source_value", "condition_start_date").agg(F.count("*").alias("n"))


@on("""select o_custkey as person_id, l_shipdate::date as drug_exposure_start_date, case when l_linestatus = 'F' then l_shipdate::date + l_quantity::int end as drug_exposure_end_date,
  case when l_linestatus = 'F' then l_quantity::int end as days_supply, case when l_orderkey % 5 <> 0 then l_orderkey end as visit_occurrence_id, p_brand as drug_source_value
from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey where l_returnflag = 'A'""")
def omop_drug_exposure(spark: SparkSession, root: str) -> DataFrame:
    df = omop.drug_exposure(_medications(spark, root), _star_people(spark, root), _star_visits(spark, root))
    return df.select("person_id", "drug_exposure_start_date", "drug_exposure_end_date", "days_supply", "visit_occurrence_id", "drug_source_value")


@on("""select o_custkey as person_id, l_shipdate::date as measurement_date, l_quantity::int::double as value_as_number, p_brand as measurement_source_value
from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey where l_returnflag = 'N' and l_linenumber % 2 = 0""")
def omop_measurement(spark: SparkSession, root: str) -> DataFrame:
    df = omop.measurement(_observations(spark, root), _star_people(spark, root), _star_visits(spark, root))
    return df.select("person_id", "measurement_date", "value_as_number", "measurement_source_value")


@on("""select o_custkey as person_id, l_shipdate::date as observation_date, case when l_linenumber = 3 then 'nan' else 'text ' || p_name end as value_as_string, p_brand as observation_source_value
from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey where l_returnflag = 'N' and l_linenumber % 2 <> 0""")
def omop_observation(spark: SparkSession, root: str) -> DataFrame:
    df = omop.observation(_observations(spark, root), _star_people(spark, root), _star_visits(spark, root))
    return df.select("person_id", "observation_date", "value_as_string", "observation_source_value")


@on("""select o_custkey as person_id, l_shipdate::date as procedure_date, p_brand as procedure_source_value
from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey where l_returnflag = 'R'""")
def omop_procedure_occurrence(spark: SparkSession, root: str) -> DataFrame:
    rows = _star(spark, root).where("l_returnflag = 'R'").select(F.col("o_custkey").cast("string").alias("PATIENT"), F.col("l_orderkey").cast("string").alias("ENCOUNTER"), F.to_date("l_shipdate").alias("START"), F.col("p_brand").alias("CODE"))
    return omop.procedure_occurrence(rows, _star_people(spark, root), _star_visits(spark, root)).select("person_id", "procedure_date", "procedure_source_value")


@on(f"with {CLEAN_SQL} select Id as person_source_value, DEATHDATE as death_date from patient where DEATHDATE is not null")
def omop_death(spark: SparkSession, root: str) -> DataFrame:
    m = _model(spark, root)
    return m["death"].join(m["person"], "person_id").select("person_source_value", "death_date")


@on(f"with {CLEAN_SQL} select p.Id as person_source_value, min(e.s) as observation_period_start_date, coalesce(max(p.DEATHDATE), max(e.e)) as observation_period_end_date from patient p join encounter e on e.PATIENT = p.Id group by 1")
def omop_observation_period(spark: SparkSession, root: str) -> DataFrame:
    """JN04 and AG08: an equi-join of spans, not a loop over persons."""
    m = _model(spark, root)
    return m["observation_period"].join(m["person"], "person_id").select("person_source_value", "observation_period_start_date", "observation_period_end_date")


@on("select 'Synthetic records' as cdm_source_name, 'v5.4' as cdm_version, date '2024-01-01' as cdm_release_date")
def omop_cdm_source(spark: SparkSession, root: str) -> DataFrame:
    return _model(spark, root)["cdm_source"].select("cdm_source_name", "cdm_version", "cdm_release_date")


@on(f"""with {CLEAN_SQL}, names as (select concept_code, min(concept_name) as concept_name from concepts where vocabulary_id = 'SNOMED' group by 1)
select CODE as code, concept_name, count(*) as n from condition left join names on concept_code = CODE group by all""")
def jn03_concept_names(spark: SparkSession, root: str) -> DataFrame:
    facts = _model(spark, root)["condition_occurrence"]
    named = omop.add_concept_names(facts, "condition_source_value", table(spark, root, "concepts"), "SNOMED")
    return named.groupBy(F.col("condition_source_value").alias("code"), "concept_name").agg(F.count("*").alias("n"))


@on(f"""with {CLEAN_SQL}, stream as (
  select PATIENT as p, s as d, 'VISIT_OCCURRENCE//' || (case lower(cls) when 'emergency' then '9203' when 'urgentcare' then '9203' when 'inpatient' then '9201' else '9202' end) as code, 'visit_occurrence' as t from encounter
  union all select PATIENT, s, 'CONDITION_OCCURRENCE//' || CODE, 'condition_occurrence' from condition
  union all select Id, DEATHDATE, 'DEATH//', 'death' from patient where DEATHDATE is not null)
select d::timestamp as time, code, t as "table", count(*) as n, count(distinct case when p in (select Id from patient) then p else '0' end) as n_subjects from stream group by all""")
def snk06_event_stream(spark: SparkSession, root: str) -> DataFrame:
    stream = omop.event_stream(_model(spark, root))
    return stream.groupBy("time", "code", "table").agg(F.count("*").alias("n"), F.countDistinct("subject_id").alias("n_subjects"))


@on("select user_id as subject_id, ts as time, event_type as code, value as numeric_value from events where user_id in (1, 2, 3, 5, 8)")
def src10_subject_scan(spark: SparkSession, root: str) -> DataFrame:
    stream = table(spark, root, "events").select(F.col("user_id").alias("subject_id"), F.col("ts").alias("time"), F.col("event_type").alias("code"), F.col("value").alias("numeric_value"))
    return meds.select_subjects(stream, ["1", "2", "3", "5", "8"])


@on("select user_id as subject_id, ts as time, event_type as code, event_id from events")
def so01_ordered_stream(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select(F.col("user_id").alias("subject_id"), F.col("ts").alias("time"), F.col("event_type").alias("code"), "event_id").orderBy("subject_id", "time")


@on("select event_type as code, count(*) as n, count(distinct user_id) as n_subjects, min(value) as low, max(value) as high from events group by 1")
def ag15_value_counts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").groupBy(F.col("event_type").alias("code")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_subjects"), F.min("value").alias("low"), F.max("value").alias("high"))


@on("select user_id as participant_id, count(*) as n_records from events group by 1")
def ag16_records_per_participant(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").groupBy(F.col("user_id").alias("participant_id")).agg(F.count("*").alias("n_records"))


@on(f"with {CLEAN_SQL} select count(*) as n_patients, count(DEATHDATE) as n_deaths, round(avg(year(BIRTHDATE)), 6) as mean_birth_year from patient")
def ag17_column_means(spark: SparkSession, root: str) -> DataFrame:
    return clean.clinical(spark, root)["patients"].agg(F.count("*").alias("n_patients"), F.count("DEATHDATE").alias("n_deaths"), F.round(F.avg(F.year("BIRTHDATE")), 6).alias("mean_birth_year"))


@on("select c_custkey as eid, c_mktsegment as segment, o_orderkey, o_totalprice from customer left join orders on o_custkey = c_custkey")
def jn05_wide_merge(spark: SparkSession, root: str) -> DataFrame:
    left = table(spark, root, "customer").select(F.col("c_custkey").alias("eid"), F.col("c_mktsegment").alias("segment"))
    right = table(spark, root, "orders").select(F.col("o_custkey").alias("eid"), "o_orderkey", "o_totalprice")
    return left.join(right, "eid", "left")


@on("select coalesce(vocabulary_id, '?') as domain, count(*) as n from concepts group by 1 order by n desc, 1 limit 10")
def ag21_domain_distribution(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "concepts").groupBy(F.coalesce("vocabulary_id", F.lit("?")).alias("domain")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(10)


QUERIES, ORACLES = registry.queries, registry.oracles
