"""Tidy views of the clinical tables: one row per record, ids and codes in plain form."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import canonical_id, canonical_id_sql
from .features import plain_code

#: History lies between these days.
FIRST_DAY, LAST_DAY = date(1901, 1, 1), date(2030, 12, 31)

Tables = dict[str, DataFrame]


def _sane(column: str) -> Column:
    return F.col(column).between(F.lit(FIRST_DAY), F.lit(LAST_DAY))


def gender(value: Column) -> Column:
    """M, F or OTHER; NULL where nothing is given."""
    first = F.upper(F.substring(F.trim(value), 1, 1))
    return F.when(F.length(F.trim(value)) == 0, None).when(first.isin("M", "F"), first).when(value.isNotNull(), F.lit("OTHER"))


def patients(df: DataFrame) -> DataFrame:
    """(Id, BIRTHDATE, DEATHDATE, GENDER): the row of each id that arrived last."""
    rank = F.struct("loaded_at", "row_id")
    return (
        df.select(canonical_id("Id").alias("Id"), "BIRTHDATE", "DEATHDATE", gender(F.col("GENDER")).alias("GENDER"), "loaded_at", "row_id")
        .where("Id is not null")
        .groupBy("Id")
        .agg(*[F.max_by(F.struct("BIRTHDATE", "DEATHDATE", "GENDER"), rank).alias("v")])
        .select("Id", "v.*")
    )


def encounters(df: DataFrame) -> DataFrame:
    """One row per encounter id, the one that arrived last, with a patient and a plausible START."""
    return (
        df.select(
            canonical_id("Id").alias("Id"), canonical_id("PATIENT").alias("PATIENT"), "START", "STOP", "ENCOUNTERCLASS", "DESCRIPTION",
            plain_code(F.col("REASONCODE")).alias("REASONCODE"), "REASONDESCRIPTION", "loaded_at", "row_id",
        )
        .where(F.col("Id").isNotNull() & F.col("PATIENT").isNotNull() & _sane("START"))
        .groupBy("Id")
        .agg(F.max_by(F.struct("PATIENT", "START", "STOP", "ENCOUNTERCLASS", "DESCRIPTION", "REASONCODE", "REASONDESCRIPTION"), F.struct("loaded_at", "row_id")).alias("v"))
        .select("Id", "v.*")
    )


def conditions(df: DataFrame) -> DataFrame:
    """One row per patient, encounter, START and code, with the smallest description and the latest STOP."""
    return (
        df.select(canonical_id("PATIENT").alias("PATIENT"), canonical_id("ENCOUNTER").alias("ENCOUNTER"), "START", "STOP", plain_code(F.col("CODE")).alias("CODE"), F.lower(F.trim("DESCRIPTION")).alias("DESCRIPTION"))
        .where(F.col("PATIENT").isNotNull() & F.col("CODE").isNotNull() & _sane("START"))
        .groupBy("PATIENT", "ENCOUNTER", "START", "CODE")
        .agg(F.min("DESCRIPTION").alias("DESCRIPTION"), F.max("STOP").alias("STOP"))
    )


def clinical(spark: SparkSession, root: str) -> Tables:
    read: Callable[[str], DataFrame] = lambda t: spark.read.parquet(f"{root}/{t}.parquet")
    return {"patients": patients(read("patients")), "encounters": encounters(read("encounters")), "conditions": conditions(read("conditions"))}


#: Concepts of the panel that labels and cohorts are made for: a documented input of theirs, not a cut of the rows.
PANEL_SIZE = 16


def panel(codes: DataFrame, size: int = PANEL_SIZE) -> DataFrame:
    """(concept_id): the ``size`` codes that most patients have, ties by code."""
    return (
        codes.groupBy(F.col("CODE").alias("concept_id"))
        .agg(F.countDistinct("PATIENT").alias("n"))
        .orderBy(F.desc("n"), "concept_id")
        .limit(size)
        .select("concept_id")
    )


_CODE = "nullif(regexp_replace(upper({}), '^\\s*[A-Z]+:|\\s', '', 'g'), '')"
_BETWEEN = f"between date '{FIRST_DAY}' and date '{LAST_DAY}'"
#: The same views as common table expressions of the SQL oracles.
CLEAN_SQL = f"""
pat as (
  select Id, arg_max(b, r) as BIRTHDATE, arg_max(d, r) as DEATHDATE, arg_max(g, r) as GENDER from (
    select {canonical_id_sql('Id')} as Id, {{'v': BIRTHDATE}} as b, {{'v': DEATHDATE}} as d,
      {{'v': case when trim(GENDER) = '' then null when upper(trim(GENDER))[1] in ('M', 'F') then upper(trim(GENDER))[1] when GENDER is not null then 'OTHER' end}} as g,
      (loaded_at, row_id) as r from patients) where Id is not null group by Id
),
patient as (select Id, BIRTHDATE.v as BIRTHDATE, DEATHDATE.v as DEATHDATE, GENDER.v as GENDER from pat),
enc as (
  select Id, arg_max(v, r) as v from (
    select {canonical_id_sql('Id')} as Id, {{'PATIENT': {canonical_id_sql('PATIENT')}, 'START': "START", 'STOP': STOP, 'CLS': ENCOUNTERCLASS, 'DSC': DESCRIPTION, 'RC': {_CODE.format('REASONCODE')}, 'RD': REASONDESCRIPTION}} as v,
      (loaded_at, row_id) as r from encounters where "START" {_BETWEEN} and {canonical_id_sql('PATIENT')} is not null)
  where Id is not null group by Id
),
encounter as (select Id, v.PATIENT as PATIENT, v."START" as s, v.STOP as e, v.CLS as cls, v.DSC as dsc, v.RC as rc, v.RD as rd from enc),
condition as (
  select PATIENT, ENCOUNTER, s, CODE, min(dsc) as dsc, max(e) as e from (
    select {canonical_id_sql('PATIENT')} as PATIENT, {canonical_id_sql('ENCOUNTER')} as ENCOUNTER, "START" as s, STOP as e, {_CODE.format('CODE')} as CODE, lower(trim(DESCRIPTION)) as dsc from conditions)
  where PATIENT is not null and CODE is not null and s {_BETWEEN} group by all
)"""
PANEL_SQL = f"panel as (select CODE as concept_id from condition group by CODE order by count(distinct PATIENT) desc, CODE limit {PANEL_SIZE})"
