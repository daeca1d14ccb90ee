"""Clinical tables into a common data model and a flat event stream."""

from __future__ import annotations

import functools
from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Standard concept ids.
GENDER_CONCEPT = {"M": 8507, "F": 8532, "OTHER": 8551}
VISIT_CONCEPT = {"ambulatory": 9202, "emergency": 9203, "inpatient": 9201, "wellness": 9202, "urgentcare": 9203}
VISIT_DEFAULT = 9202
TYPE_CONCEPT = {
    "visit": 32827, "condition": 32879, "drug": 38000177, "procedure": 32817, "measurement": 32856, "observation": 32856, "death": 32815, "observation_period": 44814724,
}


def _choice(value: Column, of: Mapping[str, int], other: int) -> Column:
    made = F.lit(other)
    for key, concept in of.items():
        made = F.when(value == key, concept).otherwise(made)
    return made


def surrogate(name: str) -> Column:
    """A stable bigint key of a natural key: no global numbering, so no single task has to count."""
    return F.xxhash64(name).bitwiseAND(F.lit((1 << 62) - 1))


def person(patients: DataFrame, key: Column | None = None) -> DataFrame:
    """person; ``person_id`` is a hash of the natural id unless a key is given."""
    born = F.to_date("BIRTHDATE")
    return patients.select(
        (surrogate("Id") if key is None else key).alias("person_id"),
        _choice(F.upper(F.coalesce("GENDER", F.lit(""))), GENDER_CONCEPT, 0).alias("gender_concept_id"),
        F.year(born).alias("year_of_birth"),
        F.month(born).alias("month_of_birth"),
        F.dayofmonth(born).alias("day_of_birth"),
        born.alias("birth_datetime"),
        F.lit(0).alias("race_concept_id"),
        F.lit(0).alias("ethnicity_concept_id"),
        F.col("Id").alias("person_source_value"),
        F.col("GENDER").alias("gender_source_value"),
    )


def _with_person(df: DataFrame, people: DataFrame, patient: str = "PATIENT") -> DataFrame:
    """person_id by natural id; 0 where the person is unknown."""
    found = people.select(F.col("person_source_value").alias("_p"), "person_id")
    return df.join(found, F.col(patient) == F.col("_p"), "left").drop("_p").withColumn("person_id", F.coalesce("person_id", F.lit(0)))


def _with_visit(df: DataFrame, visits: DataFrame) -> DataFrame:
    """visit_occurrence_id by natural id, NULL where unknown; of repeated ids the largest."""
    found = visits.groupBy(F.col("visit_source_value").alias("_v")).agg(F.max("visit_occurrence_id").alias("visit_occurrence_id"))
    return df.join(found, F.col("ENCOUNTER") == F.col("_v"), "left").drop("_v")


def visit_occurrence(encounters: DataFrame, people: DataFrame) -> DataFrame:
    df = _with_person(encounters, people)
    return df.select(
        surrogate("Id").alias("visit_occurrence_id"), "person_id",
        _choice(F.lower("ENCOUNTERCLASS"), VISIT_CONCEPT, VISIT_DEFAULT).alias("visit_concept_id"),
        F.to_date("START").alias("visit_start_date"), F.to_date("STOP").alias("visit_end_date"),
        F.lit(TYPE_CONCEPT["visit"]).alias("visit_type_concept_id"),
        F.col("Id").alias("visit_source_value"),
    )


def _fact(df: DataFrame, people: DataFrame, visits: DataFrame) -> DataFrame:
    return _with_visit(_with_person(df, people), visits)


def condition_occurrence(conditions: DataFrame, people: DataFrame, visits: DataFrame) -> DataFrame:
    return _fact(conditions, people, visits).select(
        "person_id", F.lit(0).alias("condition_concept_id"), F.to_date("START").alias("condition_start_date"), F.to_date("STOP").alias("condition_end_date"),
        F.lit(TYPE_CONCEPT["condition"]).alias("condition_type_concept_id"), "visit_occurrence_id",
        F.col("CODE").cast("string").alias("condition_source_value"), F.lit(0).alias("condition_source_concept_id"),
    )


def drug_exposure(medications: DataFrame, people: DataFrame, visits: DataFrame) -> DataFrame:
    start, stop = F.to_date("START"), F.to_date("STOP")
    return _fact(medications, people, visits).select(
        "person_id", F.lit(0).alias("drug_concept_id"), start.alias("drug_exposure_start_date"), stop.alias("drug_exposure_end_date"),
        F.lit(TYPE_CONCEPT["drug"]).alias("drug_type_concept_id"), F.datediff(stop, start).alias("days_supply"), "visit_occurrence_id",
        F.col("CODE").cast("string").alias("drug_source_value"),
    )


def procedure_occurrence(procedures: DataFrame, people: DataFrame, visits: DataFrame) -> DataFrame | None:
    """None where the table has neither DATE nor START."""
    named = [c for c in ("DATE", "START") if c in procedures.columns]
    if not named:
        return None
    return _fact(procedures, people, visits).select(
        "person_id", F.lit(0).alias("procedure_concept_id"), F.to_date(named[0]).alias("procedure_date"),
        F.lit(TYPE_CONCEPT["procedure"]).alias("procedure_type_concept_id"), "visit_occurrence_id", F.col("CODE").cast("string").alias("procedure_source_value"),
    )


def numeric(value: Column) -> Column:
    """The number a text is, NULL for anything else, NaN included."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def measurement(observations: DataFrame, people: DataFrame, visits: DataFrame) -> DataFrame:
    """Observations whose value is a number."""
    df = observations.withColumn("_n", numeric(F.col("VALUE"))).where("_n is not null")
    return _fact(df, people, visits).select(
        "person_id", F.lit(0).alias("measurement_concept_id"), F.to_date("DATE").alias("measurement_date"), F.lit(TYPE_CONCEPT["measurement"]).alias("measurement_type_concept_id"),
        F.col("_n").alias("value_as_number"), F.col("UNITS").alias("unit_source_value"), "visit_occurrence_id", F.col("CODE").cast("string").alias("measurement_source_value"),
    )


def observation(observations: DataFrame, people: DataFrame, visits: DataFrame) -> DataFrame:
    """Observations whose value is no number."""
    df = observations.where(numeric(F.col("VALUE")).isNull())
    return _fact(df, people, visits).select(
        "person_id", F.lit(0).alias("observation_concept_id"), F.to_date("DATE").alias("observation_date"), F.lit(TYPE_CONCEPT["observation"]).alias("observation_type_concept_id"),
        F.col("VALUE").cast("string").alias("value_as_string"), "visit_occurrence_id", F.col("CODE").cast("string").alias("observation_source_value"),
    )


def death(patients: DataFrame, people: DataFrame) -> DataFrame:
    dead = patients.where("DEATHDATE is not null")
    return _with_person(dead, people, "Id").select("person_id", F.to_date("DEATHDATE").alias("death_date"), F.lit(TYPE_CONCEPT["death"]).alias("death_type_concept_id"))


def observation_period(patients: DataFrame, encounters: DataFrame, people: DataFrame) -> DataFrame:
    """From the first START to death or the last STOP; persons without encounters have none."""
    spans = encounters.groupBy("PATIENT").agg(F.min(F.to_date("START")).alias("a"), F.max(F.to_date("STOP")).alias("b"))
    df = spans.join(patients.select("Id", "DEATHDATE"), F.col("PATIENT") == F.col("Id"))
    return _with_person(df, people).select(
        "person_id", F.col("a").alias("observation_period_start_date"), F.coalesce(F.to_date("DEATHDATE"), F.col("b")).alias("observation_period_end_date"),
        F.lit(TYPE_CONCEPT["observation_period"]).alias("period_type_concept_id"),
    )


def cdm_source(spark, released: date, name: str = "Synthetic records") -> DataFrame:
    """The one row about the data set; its date is a parameter, so a run can be repeated."""
    return spark.createDataFrame([(name, name, "v5.4", released, released)], "cdm_source_name string, cdm_source_abbreviation string, cdm_version string, source_release_date date, cdm_release_date date")


def convert(tables: Mapping[str, DataFrame], released: date | None = None) -> dict[str, DataFrame]:
    """Every table of the model for which there is a source; missing sources are left out."""
    people = person(tables["patients"])
    made = {"person": people, "death": death(tables["patients"], people)}
    if "encounters" in tables:
        made["visit_occurrence"] = visit_occurrence(tables["encounters"], people)
        made["observation_period"] = observation_period(tables["patients"], tables["encounters"], people)
    visits = made.get("visit_occurrence")
    if visits is None:
        visits = people.sparkSession.createDataFrame([], "visit_source_value string, visit_occurrence_id long")
    for source, name, build in (
        ("conditions", "condition_occurrence", condition_occurrence), ("medications", "drug_exposure", drug_exposure), ("procedures", "procedure_occurrence", procedure_occurrence),
        ("observations", "measurement", measurement), ("observations", "observation", observation),
    ):
        if source in tables and (df := build(tables[source], people, visits)) is not None:
            made[name] = df
    if released:
        made["cdm_source"] = cdm_source(people.sparkSession, released)
    return made


def concept_names(concepts: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(concept_code, concept_name): of repeated codes the first non-null name in byte order."""
    kept = concepts if vocabulary is None else concepts.where(F.col("vocabulary_id") == vocabulary)
    return kept.groupBy(F.col("concept_code").cast("string").alias("concept_code")).agg(F.min("concept_name").alias("concept_name"))


def add_concept_names(df: DataFrame, code: str, concepts: DataFrame, vocabulary: str | None = None, name: str = "concept_name") -> DataFrame:
    """A left join that never multiplies rows; unknown codes get NULL."""
    names = concept_names(concepts, vocabulary).select(F.col("concept_code").alias("_code"), F.col("concept_name").alias(name))
    return df.join(names, F.col(code).cast("string") == F.col("_code"), "left").drop("_code")


#: Per table of the model: day column, code column, numeric value column.
STREAM = {
    "visit_occurrence": ("visit_start_date", "visit_concept_id", None),
    "condition_occurrence": ("condition_start_date", "condition_source_value", None),
    "drug_exposure": ("drug_exposure_start_date", "drug_source_value", None),
    "procedure_occurrence": ("procedure_date", "procedure_source_value", None),
    "measurement": ("measurement_date", "measurement_source_value", "value_as_number"),
    "observation": ("observation_date", "observation_source_value", None),
    "death": ("death_date", None, None),
}


def event_stream(model: Mapping[str, DataFrame]) -> DataFrame:
    """(subject_id, time, code, numeric_value, table): the model's facts as one flat stream."""
    parts = [
        model[t].select(
            F.col("person_id").cast("string").alias("subject_id"),
            F.col(day).cast("timestamp_ntz").alias("time"),
            F.concat(F.lit(t.upper() + "//"), F.col(code).cast("string") if code else F.lit("")).alias("code"),
            (F.col(value).cast("double") if value else F.lit(None).cast("double")).alias("numeric_value"),
            F.lit(t).alias("table"),
        )
        for t, (day, code, value) in STREAM.items()
        if t in model
    ]
    return functools.reduce(DataFrame.unionByName, parts)
