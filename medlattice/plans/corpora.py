"""Whole corpora as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tasks
from .clinical import _CUTS, _WINDOWED, EVENT_SQL, split_sql
from .common import CUTOFFS, HORIZONS, SOURCE_END, History, Registry

registry = Registry()
on = registry.on

_ALIASES = ["stenosis", "sclerosis", "neuropathy"]


def _tasks(spark: SparkSession, root: str) -> tasks.Corpus:
    h = History(spark, root)
    bridge = h.panel.select("concept_id", F.col("concept_id").alias("code"))
    return tasks.clinical_tasks(h.tables, bridge, _ALIASES, CUTOFFS, HORIZONS, SOURCE_END)


@on(f"""with {EVENT_SQL}, {_WINDOWED}, cuts(c) as (values {_CUTS}),
parts as (select event_id, d, text, patient_id, resolution, window_start, window_end from win union select w.event_id, w.d, w.text, w.patient_id, w.resolution, w.window_start, least(w.window_end, c) from win w, cuts where c >= w.d and c < w.window_end)
select patient_id || ':history:' || resolution || ':' || window_start || ':' || window_end || ':explicit' as document_id, {split_sql('patient_id')} as split, cast(count(*) as int) as n_events,
  sha256(string_agg(d || ': ' || text, chr(10) order by d, event_id)) as text_sha256 from parts group by patient_id, resolution, window_start, window_end""")
def gn04_clinical_documents(spark: SparkSession, root: str) -> DataFrame:
    """Also WN07: natural and clipped windows are one registry of documents."""
    return _tasks(spark, root).documents.where("explicitness = 'explicit'").select("document_id", "split", "n_events", "text_sha256")


@on()
def gn04_implicit_documents(spark: SparkSession, root: str) -> DataFrame:
    return _tasks(spark, root).documents.where("explicitness = 'implicit'").select("document_id", "split", "n_events", "text")


@on()
def gn03_benchmark(spark: SparkSession, root: str) -> DataFrame:
    h = History(spark, root)
    made = tasks.benchmark(h.tables, h.panel.select("concept_id", F.col("concept_id").alias("code")), _ALIASES, fraction=0.5)
    return made.documents.select("document_id", "concept_id", "split", "positive", "negative_type", "n_events")


@on(f"""with {EVENT_SQL}, {_WINDOWED}, pos as (select w.patient_id, w.resolution, w.window_start, p.concept_id, bool_or(l.event_id is not null) as positive
  from win w cross join panel p left join label l on l.event_id = w.event_id and l.concept_id = p.concept_id where w.resolution = '1mo' group by all)
select concept_id, positive, count(*) as n_windows from pos group by 1, 2""")
def lb08_support_labels(spark: SparkSession, root: str) -> DataFrame:
    """A window supports a concept if any of its events does."""
    from ..operators import windows

    h = History(spark, root)
    placed = windows.windowed(h.events.select("patient_id", "event_id", "date")).where("resolution = '1mo'").join(F.broadcast(h.panel))
    hit = h.labels.select("event_id", "concept_id", F.lit(True).alias("hit"))
    made = placed.join(hit, ["event_id", "concept_id"], "left").groupBy("patient_id", "resolution", "window_start", "concept_id").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("positive"))
    return made.groupBy("concept_id", "positive").agg(F.count("*").alias("n_windows"))


@on("select 'conditions' as table_name, count(*) as n from conditions union all select 'encounters', count(*) from encounters union all select 'patients', count(*) from patients")
def se01_union_all(spark: SparkSession, root: str) -> DataFrame:
    made = None
    for t in ("conditions", "encounters", "patients"):
        part = spark.read.parquet(f"{root}/{t}.parquet").select(F.lit(t).alias("table_name"), "row_id")
        made = part if made is None else made.unionByName(part)
    return made.groupBy("table_name").agg(F.count("*").alias("n"))


@on("select distinct t.document_id, t.task from clinical_tasks t join (select distinct document_id from clinical_tasks where task = 'evidence') e on e.document_id = t.document_id")
def jn13_documents_with_labels(spark: SparkSession, root: str) -> DataFrame:
    t = spark.read.parquet(f"{root}/clinical_tasks.parquet").select("document_id", "task")
    return t.join(t.where("task = 'evidence'").select("document_id").distinct(), "document_id").distinct()


QUERIES, ORACLES = registry.queries, registry.oracles
