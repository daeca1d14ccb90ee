"""Patient-day events from the clinical tables."""

from __future__ import annotations

import functools
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import capitalise, collapse

#: The clinical tables in the order in which their facts are told.
TABLE_ORDER = ("encounters", "conditions", "observations", "medications", "procedures", "careplans", "allergies", "imaging_studies", "devices", "immunizations", "supplies")


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def _day(df: DataFrame) -> Column:
    """The record's own day: DATE before START."""
    days = [F.to_date(F.col(c)) for c in ("DATE", "START") if c in df.columns]
    if not days:
        raise ValueError("a clinical table needs a DATE or a START column")
    return F.coalesce(*days)


def _fact(table: str, df: DataFrame) -> Column:
    """What a record says: conditions say nothing themselves, they are diagnoses."""
    if table == "conditions":
        return F.lit(None).cast("string")
    if table == "observations":
        said = F.concat(F.coalesce(_column(df, "DESCRIPTION"), F.lit("")), F.lit(": "), F.coalesce(_column(df, "VALUE"), F.lit("")), F.lit(" "), F.coalesce(_column(df, "UNITS"), F.lit("")))
    elif table == "imaging_studies":
        said = F.concat(F.coalesce(_column(df, "MODALITY_DESCRIPTION"), F.lit("")), F.lit(" of "), F.coalesce(_column(df, "BODYSITE_DESCRIPTION"), F.lit("")))
    else:
        said = _column(df, "DESCRIPTION")
    return collapse(said)


def records(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All tables as (patient_id, date, encounter_id, table_no, kind, fact, code, diagnosis); unknown tables are ignored."""
    made = []
    for number, table in enumerate(TABLE_ORDER):
        if table not in tables:
            continue
        df = tables[table]
        own = table == "conditions"
        made.append(
            df.select(
                F.col("PATIENT").alias("patient_id"),
                _day(df).alias("date"),
                (_column(df, "Id") if table == "encounters" else _column(df, "ENCOUNTER")).alias("encounter_id"),
                F.lit(number).alias("table_no"),
                F.lit("Encounter" if table == "encounters" else table).alias("kind"),
                _fact(table, df).alias("fact"),
                _column(df, "CODE" if own else "REASONCODE").alias("code"),
                collapse(_column(df, "DESCRIPTION" if own else "REASONDESCRIPTION")).alias("diagnosis"),
            )
        )
    return functools.reduce(DataFrame.unionByName, made)


def bundle(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One event per patient and day: encounter ids, facts in order, diagnoses and codes.

    A day's facts keep the order of the tables; within a table they are ordered by encounter and text, so the result
    does not depend on partitioning.  A record without a day is an error of the input and raises.  A patient with very
    many records spreads over days; no patient is gathered in one row.
    """
    dated = records(tables).withColumn("date", F.when(F.col("date").isNull(), F.raise_error(F.lit("a clinical record has no date"))).otherwise(F.col("date")))
    fact = F.when(F.length("fact") > 0, F.struct("table_no", F.coalesce("encounter_id", F.lit("")).alias("e"), "fact", capitalise(F.col("kind")).alias("kind")))
    return (
        dated.groupBy("patient_id", "date")
        .agg(
            F.array_sort(F.collect_set("encounter_id")).alias("encounter_ids"),
            F.transform(F.array_sort(F.collect_list(fact)), lambda f: F.struct(f["kind"].alias("kind"), f["fact"].alias("fact"))).alias("facts"),
            F.array_sort(F.collect_set(F.when(F.length("diagnosis") > 0, F.col("diagnosis")))).alias("diagnoses"),
            F.array_sort(F.collect_set(F.when(F.length("code") > 0, F.col("code")))).alias("codes"),
        )
        .withColumn("event_id", F.concat_ws("-", "patient_id", F.date_format("date", "yyyy-MM-dd")))
    )


def explicit_text(facts: Column, diagnoses: Column) -> Column:
    """``Kind: fact`` parts, then every recorded diagnosis, joined by semicolons."""
    told = F.transform(facts, lambda f: F.concat(f["kind"], F.lit(": "), f["fact"]))
    return F.array_join(F.concat(told, F.transform(diagnoses, lambda d: F.concat(F.lit("Recorded condition/indication: "), d))), "; ")


def labelled(events: DataFrame, bridge: DataFrame) -> DataFrame:
    """(patient_id, date, event_id, concept_id): events that hold a code of a concept, by (concept_id, code) pairs."""
    return (
        events.select("patient_id", "date", "event_id", F.explode("codes").alias("code"))
        .join(bridge.select("concept_id", "code"), "code")
        .select("patient_id", "date", "event_id", "concept_id")
        .distinct()
    )


def first_dates(labels: DataFrame) -> DataFrame:
    """The first day of each concept of a patient."""
    return labels.groupBy("patient_id", "concept_id").agg(F.min("date").alias("first_date"))


@dataclass(frozen=True)
class SourceCheck:
    """Histories against demographics."""

    unknown: DataFrame  #: patients with a history and no demographics
    silent: DataFrame  #: patients without any event


def check_sources(people: DataFrame, events: DataFrame) -> SourceCheck:
    having = events.select("patient_id").distinct()
    known = people.select(F.col("Id").alias("patient_id"))
    return SourceCheck(having.join(known, "patient_id", "left_anti"), known.join(having, "patient_id", "left_anti"))
