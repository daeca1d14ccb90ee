"""Labels of documents and patients: recorded, incident at a cutoff, and their summaries."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .splits import hash_split

#: Outcomes in the order in which they are decided.
OUTCOMES = ("not_at_risk", "prevalent", "positive", "censored", "negative")
SPLITS = ("train", "validation", "test")


def record_labels(events: DataFrame, documents: DataFrame, labels: DataFrame, panel: DataFrame) -> DataFrame:
    """(document_id, concept_id, positive, first_date, evidence_event_ids, information_status) per panel concept.

    In explicit documents a recorded concept is visible; in implicit ones it is hidden, with or without other context
    (``context`` of the event, if the column is there).  All others have no recorded target.
    """
    context = F.col("context") if "context" in events.columns else F.lit(True)
    about = events.select("event_id", context.alias("context"))
    slots = documents.select("document_id", "explicitness", F.explode("event_ids").alias("event_id"))
    found = (
        slots.join(labels.select("event_id", "concept_id", "date"), "event_id")
        .join(about, "event_id")
        .groupBy("document_id", "concept_id")
        .agg(F.min("date").alias("first_date"), F.array_sort(F.collect_set("event_id")).alias("evidence_event_ids"), F.bool_or("context").alias("context"))
    )
    every = documents.select("document_id", "explicitness").join(F.broadcast(panel.select("concept_id")))
    status = (
        F.when(F.col("first_date").isNull(), "no_recorded_target")
        .when(F.col("explicitness") == "explicit", "recorded_visible")
        .when(F.col("context"), "recorded_hidden_with_context")
        .otherwise("recorded_hidden_no_context")
    )
    return every.join(found, ["document_id", "concept_id"], "left").select(
        "document_id", "concept_id", F.col("first_date").isNotNull().alias("positive"), "first_date",
        F.coalesce("evidence_event_ids", F.array().cast("array<string>")).alias("evidence_event_ids"), status.alias("information_status"),
    )


def label_rows(labels: DataFrame) -> DataFrame:
    """One row per document with maps by concept, as the label files hold them."""
    of = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("concept_id", c))))
    return labels.groupBy("document_id").agg(
        F.array_sort(F.collect_list("concept_id")).alias("candidate_ids"),
        F.array_sort(F.collect_list(F.when(F.col("positive"), F.col("concept_id")))).alias("positive_ids"),
        of("evidence_event_ids").alias("evidence_event_ids"),
        of("information_status").alias("information_status"),
        of("first_date").alias("first_recorded_dates"),
    )


def followup_end(source_end: Column, last_event: Column, cutoff: Column, death: Column) -> Column:
    """The first of the source's end, the patient's last event (the cutoff if there is none) and death."""
    return F.least(source_end, F.coalesce(last_event, cutoff), death)


def incident_outcome(had_past: Column, born: Column, first: Column, end: Column, cutoff: Column, horizon: Column) -> Column:
    """The outcome of a patient at a cutoff, decided in the order of OUTCOMES."""
    until = F.date_add(cutoff, horizon)
    at_risk = had_past & (born.isNull() | (born <= cutoff)) & (end >= cutoff)
    return (
        F.when(~at_risk, "not_at_risk")
        .when(first <= cutoff, "prevalent")
        .when((first > cutoff) & (first <= until) & (first <= end), "positive")
        .when(end < until, "censored")
        .otherwise("negative")
    )


def age_bin(born: Column, at: Column) -> Column:
    """Age by calendar: years less one before the birthday."""
    early = (F.month(at) < F.month(born)) | ((F.month(at) == F.month(born)) & (F.dayofmonth(at) < F.dayofmonth(born)))
    age = F.year(at) - F.year(born) - early.cast("int")
    return F.when(born.isNull(), "unknown").when(born > at, "not_born").when(age < 18, "0-17").when(age < 40, "18-39").when(age < 65, "40-64").otherwise("65+")


def risk_sets(
    people: DataFrame, events: DataFrame, first: DataFrame, panel: DataFrame, cutoffs: Sequence[date], horizons: Sequence[int], source_end: date, seed: int = 0
) -> DataFrame:
    """(patient_id, split, age_bin, cutoff, horizon_days, concept_id, outcome) for every patient, cutoff, horizon and concept.

    Cutoffs, horizons and the panel are small dimensions: they are exploded as literals or broadcast, so the only
    shuffles are those on the patient.
    """
    dates = F.array(*[F.lit(c) for c in cutoffs])
    # per patient and cutoff only whether there is a past matters, so the first event suffices
    spans = events.groupBy("patient_id").agg(F.min("date").alias("first_event"), F.max("date").alias("last_event"))
    base = (
        people.select(F.col("Id").alias("patient_id"), "BIRTHDATE", "DEATHDATE")
        .join(spans, "patient_id", "left")
        .withColumn("cutoff", F.explode(dates))
        .withColumn("end", followup_end(F.lit(source_end), F.col("last_event"), F.col("cutoff"), F.col("DEATHDATE")))
        .withColumn("horizon_days", F.explode(F.array(*[F.lit(h) for h in horizons])))
        .join(F.broadcast(panel.select("concept_id")))
        .join(first.select("patient_id", "concept_id", "first_date"), ["patient_id", "concept_id"], "left")
    )
    past = F.coalesce(F.col("first_event") <= F.col("cutoff"), F.lit(False))
    outcome = incident_outcome(past, F.col("BIRTHDATE"), F.col("first_date"), F.col("end"), F.col("cutoff"), F.col("horizon_days"))
    return base.select("patient_id", hash_split(F.col("patient_id"), seed).alias("split"), age_bin(F.col("BIRTHDATE"), F.col("cutoff")).alias("age_bin"), "cutoff", "horizon_days", "concept_id", outcome.alias("outcome"))


def risk_summary(outcomes: DataFrame) -> DataFrame:
    """Counts of outcomes per cutoff, horizon, concept and split; split ``all`` holds all of them."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    return (
        outcomes.groupingSets([["cutoff", "horizon_days", "concept_id"], ["cutoff", "horizon_days", "concept_id", "split"]], "cutoff", "horizon_days", "concept_id", "split")
        .agg(*counts, F.count_if(F.col("outcome").isin("positive", "negative")).alias("eligible"))
        .withColumn("split", F.coalesce("split", F.lit("all")))
    )


def age_summary(outcomes: DataFrame) -> DataFrame:
    """Patients per cutoff, split and age bin."""
    return outcomes.groupBy("cutoff", "split", "age_bin").agg(F.countDistinct("patient_id").alias("n_patients"))


def incident_evidence(labels: DataFrame, first: DataFrame) -> DataFrame:
    """(patient_id, concept_id, event_ids): the events on the first day that carry the concept."""
    return (
        labels.join(first, ["patient_id", "concept_id"])
        .where("date = first_date")
        .groupBy("patient_id", "concept_id")
        .agg(F.array_sort(F.collect_set("event_id")).alias("event_ids"))
    )


def prevalence(people: DataFrame, first: DataFrame, panel: DataFrame, seed: int = 0) -> DataFrame:
    """(concept_id, split, positive_patients, patients): overall (``all``) and by split, zeros kept."""
    placed = people.select(F.col("Id").alias("patient_id"), hash_split(F.col("Id"), seed).alias("split"))
    sizes = placed.groupBy("split").agg(F.count("*").alias("patients"))
    sizes = sizes.unionByName(sizes.agg(F.sum("patients").alias("patients")).select(F.lit("all").alias("split"), "patients"))
    had = (
        placed.join(first, "patient_id")
        .groupingSets([["concept_id"], ["concept_id", "split"]], "concept_id", "split")
        .agg(F.count("*").alias("positive_patients"))
        .withColumn("split", F.coalesce("split", F.lit("all")))
    )
    every = panel.select("concept_id").join(F.broadcast(sizes))
    return every.join(had, ["concept_id", "split"], "left").select("concept_id", "split", F.coalesce("positive_patients", F.lit(0)).alias("positive_patients"), F.coalesce("patients", F.lit(0)).alias("patients"))


def rare_concepts(prevalences: DataFrame) -> DataFrame:
    """Concepts without a positive patient, or with a split in which all or none are positive."""
    split = F.col("split") != "all"
    odd = split & ((F.col("positive_patients") == 0) | (F.col("positive_patients") == F.col("patients")))
    return (
        prevalences.groupBy("concept_id")
        .agg(F.max(F.when(~split, F.col("positive_patients"))).alias("positive_patients"), F.bool_or(odd).alias("odd"))
        .where("odd or coalesce(positive_patients, 0) = 0")
        .select("concept_id", "positive_patients")
    )


def eligible_concepts(people: DataFrame, first: DataFrame, least: int) -> DataFrame:
    """Concepts with at least ``least`` positive and as many other patients."""
    n = people.agg(F.count("*").alias("n"))
    return (
        first.join(people.select(F.col("Id").alias("patient_id")), "patient_id")
        .groupBy("concept_id")
        .agg(F.countDistinct("patient_id").alias("positive_patients"))
        .join(F.broadcast(n))
        .where((F.col("positive_patients") >= least) & (F.col("n") - F.col("positive_patients") >= least))
        .select("concept_id", "positive_patients")
    )


def task_documents(histories: DataFrame, families: DataFrame) -> DataFrame:
    """The same documents under each task family: (document_id, task, family_id, n_candidates)."""
    sizes = families.groupBy("task", "family_id").agg(F.countDistinct("concept_id").alias("n_candidates"))
    return histories.select("document_id", "patient_id", "resolution").join(F.broadcast(sizes))


def negative_type(case: Column, positive_here: Column, positive_elsewhere: Column, control: str) -> Column:
    """Why a window is negative: ``case`` where it is not."""
    return F.when(positive_here, "case").when(case & positive_elsewhere, "history_outside_window").when(case, "unrelated_event").otherwise(control)
