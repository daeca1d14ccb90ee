"""The two corpora over clinical records: labelled tasks, and a balanced case-control benchmark."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, mask, scrub
from . import events as ev
from . import labels as lb
from . import splits, windows

EMPTY_EVENT = "Clinical encounter recorded."


@dataclass(frozen=True)
class Corpus:
    documents: DataFrame
    labels: DataFrame
    events: DataFrame
    metadata: dict


def told_events(tables: Mapping[str, DataFrame], aliases: Sequence[str]) -> DataFrame:
    """Patient-day events with explicit and implicit text.

    Aliases go first, then ids, then white space; what is left empty becomes a constant.  ``context`` tells whether an
    implicit text says more than that there was an encounter.
    """
    made = ev.bundle(tables)
    implicit = F.array_join(F.transform("facts", lambda f: F.concat(f["kind"], F.lit(": "), f["fact"])), "; ")
    ids = F.array_distinct(F.concat(F.array("patient_id"), "encounter_ids", "codes"))
    bare = scrub(collapse(mask(implicit, aliases)), ids)
    return made.select(
        "patient_id", "date", "event_id", "codes",
        ev.explicit_text(F.col("facts"), F.col("diagnoses")).alias("explicit"),
        F.when(F.length(bare) > 0, bare).otherwise(F.lit(EMPTY_EVENT)).alias("implicit"),
        F.exists("facts", lambda f: f["kind"] != "Encounter").alias("context"),
    )


def clinical_tasks(
    tables: Mapping[str, DataFrame], bridge: DataFrame, aliases: Sequence[str], cutoffs: Sequence[date], horizons: Sequence[int], source_end: date | None = None, seed: int = 0
) -> Corpus:
    """Documents over natural and clipped windows in both texts, record labels, and incident outcomes in the metadata.

    ``bridge`` has (concept_id, code).  Without ``source_end`` it is the last event's day.
    """
    told = told_events(tables, aliases)
    panel = bridge.select("concept_id").distinct()
    found = ev.labelled(told, bridge)
    first = ev.first_dates(found)
    if source_end is None:
        source_end = told.agg(F.max("date")).first()[0] or max(cutoffs)
    cut = told.sparkSession.createDataFrame([(c,) for c in cutoffs], "cutoff date")
    placed = windows.windowed(told, cut)
    documents = None
    for version in ("explicit", "implicit"):
        part = windows.window_documents(placed.select("patient_id", "event_id", "date", "resolution", "window_start", "window_end", F.col(version).alias("text")), version)
        documents = part if documents is None else documents.unionByName(part)
    documents = documents.withColumn("split", splits.hash_split(F.col("patient_id"), seed))
    outcomes = lb.risk_sets(tables["patients"], told, first, panel, cutoffs, horizons, source_end, seed)
    metadata = {"seed": seed, "source_end": str(source_end), "cutoffs": [str(c) for c in cutoffs], "horizons": list(horizons), "resolutions": list(windows.RESOLUTIONS)}
    return Corpus(documents, lb.record_labels(told, documents, found, panel), told, metadata | {"risk_sets": lb.risk_summary(outcomes)})


def benchmark(tables: Mapping[str, DataFrame], bridge: DataFrame, aliases: Sequence[str], least: int = 3, fraction: float = 1.0, seed: int = 0) -> Corpus:
    """Balanced cases and controls per concept, their half-open windows, and a label for each window and patient.

    Only patients with a history take part.  A case's window without the concept is a negative of its own kind.
    """
    told = told_events(tables, aliases)
    found = ev.labelled(told, bridge)
    first = ev.first_dates(found)
    people = tables["patients"].join(told.select(F.col("patient_id").alias("Id")).distinct(), "Id", "left_semi")
    concepts = lb.eligible_concepts(people, first, least).select("concept_id")
    every = people.select(F.col("Id").alias("patient_id"), splits.hash_split(F.col("Id"), seed).alias("split")).join(F.broadcast(concepts))
    status = every.join(first.withColumn("positive", F.lit(True)), ["patient_id", "concept_id"], "left").withColumn("positive", F.coalesce("positive", F.lit(False)))
    chosen = splits.balanced_cohort(status, fraction=fraction, least=least, seed=seed).withColumnRenamed("positive", "case")
    rows = told.join(chosen, "patient_id").join(found.select("event_id", "concept_id", F.lit(True).alias("hit")), ["event_id", "concept_id"], "left")
    rows = rows.withColumn("resolution", F.explode(F.array(*[F.lit(r) for r in windows.RESOLUTIONS])))
    key, start, end = windows.keyed_window(F.col("date"), F.col("resolution"))
    rows = rows.withColumn("window_key", key).withColumn("window_start", start).withColumn("window_end", end)
    line = F.struct("date", "event_id", F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(": "), F.col("implicit")).alias("l"))
    made = rows.groupBy("concept_id", "patient_id", "split", "case", "resolution", "window_key", "window_start", "window_end").agg(
        F.coalesce(F.bool_or("hit"), F.lit(False)).alias("positive"), F.array_sort(F.collect_list(line)).alias("x")
    )
    documents = made.select(
        F.concat_ws("-", "concept_id", "patient_id", "resolution", "window_key", F.lit("implicit")).alias("document_id"), "concept_id", "patient_id", "split", "resolution", "window_start", "window_end", "positive",
        lb.negative_type(F.col("case"), F.col("positive"), F.lit(True), "other_conditions").alias("negative_type"),
        F.size("x").alias("n_events"), F.array_join(F.transform("x", lambda v: v["l"]), "\n").alias("text"),
    )
    return Corpus(documents, chosen, told, {"seed": seed, "least": least, "fraction": fraction})
