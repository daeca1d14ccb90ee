"""Events, windows, labels and splits over the clinical tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events, labels, splits, windows
from ..operators.clean import CLEAN_SQL, PANEL_SIZE, PANEL_SQL
from .common import CUTOFFS, HORIZONS, SOURCE_END, History, Registry

registry = Registry()
on = registry.on

_DOT = "' '"
#: Records, events and concept labels as common table expressions.
EVENT_SQL = f"""{CLEAN_SQL},
rec as (
  select PATIENT as patient_id, s as d, Id as eid, 0 as tno, trim(regexp_replace(dsc, '\\s+', ' ', 'g')) as fact, rc as code, trim(regexp_replace(rd, '\\s+', ' ', 'g')) as dia from encounter
  union all
  select PATIENT, s, ENCOUNTER, 1, null, CODE, trim(regexp_replace(dsc, '\\s+', ' ', 'g')) from condition
),
ev as (
  select patient_id, d, patient_id || '-' || strftime(d, '%Y-%m-%d') as event_id,
    coalesce(string_agg(distinct eid, ',' order by eid), '') as encounter_ids,
    coalesce(string_agg('Encounter: ' || fact, '; ' order by tno, coalesce(eid, ''), fact) filter (fact <> ''), '') as facts,
    coalesce(string_agg(distinct dia, '; ' order by dia) filter (dia <> ''), '') as diagnoses,
    coalesce(string_agg(distinct 'Recorded condition/indication: ' || dia, '; ' order by 'Recorded condition/indication: ' || dia) filter (dia <> ''), '') as dia_text,
    coalesce(string_agg(distinct code, ',' order by code) filter (code <> ''), '') as codes
  from rec group by patient_id, d
),
event as (select *, concat_ws('; ', nullif(facts, ''), nullif(dia_text, '')) as text from ev),
{PANEL_SQL},
label as (select distinct r.patient_id, r.d, r.patient_id || '-' || strftime(r.d, '%Y-%m-%d') as event_id, p.concept_id from rec r join panel p on p.concept_id = r.code),
first as (select patient_id, concept_id, min(d) as first_date from label group by 1, 2)"""
_LIST = lambda c, by=",": F.array_join(c, by)


def split_sql(column: str, seed: int = 0) -> str:
    digits = f"substr(sha256('{seed}:' || {column}), 1, 16)"
    return f"(case when {digits} < '{splits.VALIDATION_FROM}' then 'train' when {digits} < '{splits.TEST_FROM}' then 'validation' else 'test' end)"


@on(f"with {EVENT_SQL} select patient_id, d as date, event_id, encounter_ids, facts, diagnoses, codes from event")
def ag01_patient_day_bundles(spark: SparkSession, root: str) -> DataFrame:
    h = History(spark, root)
    told = F.transform("facts", lambda f: F.concat(f["kind"], F.lit(": "), f["fact"]))
    return h.events.select("patient_id", "date", "event_id", _LIST("encounter_ids").alias("encounter_ids"), _LIST(told, "; ").alias("facts"), _LIST("diagnoses", "; ").alias("diagnoses"), _LIST("codes").alias("codes"))


@on(f"with {EVENT_SQL} select patient_id, d as date, event_id, concept_id from label")
def jn06_concept_events(spark: SparkSession, root: str) -> DataFrame:
    return History(spark, root).labels


@on(f"""with {EVENT_SQL} select 'unknown' as kind, patient_id from (select distinct patient_id from rec) where patient_id not in (select Id from patient)
union all select 'silent', Id from patient where Id not in (select patient_id from rec)""")
def jn07_source_check(spark: SparkSession, root: str) -> DataFrame:
    h = History(spark, root)
    check = events.check_sources(h.people, h.events)
    return check.unknown.select(F.lit("unknown").alias("kind"), "patient_id").unionByName(check.silent.select(F.lit("silent").alias("kind"), "patient_id"))


@on(f"with {EVENT_SQL} select patient_id, concept_id, first_date from first")
def lb05_first_recorded(spark: SparkSession, root: str) -> DataFrame:
    return History(spark, root).first


def _window_sql(prefix: str = "") -> str:
    d = f"{prefix}d"
    return f"""(case r.r when '1d' then {d} when '1mo' then date_trunc('month', {d})::date else date_trunc('year', {d})::date end) as window_start,
  (case r.r when '1d' then {d} when '1mo' then last_day({d}) else make_date(year({d}), 12, 31) end) as window_end"""


_RES = "(values ('1d'), ('1mo'), ('1y')) r(r)"
_WINDOWED = f"""win as (select e.*, r.r as resolution, {_window_sql('e.')} from event e, {_RES}),
doc as (
  select patient_id || ':history:' || resolution || ':' || window_start || ':' || window_end || ':explicit' as document_id, patient_id, resolution, window_start, window_end,
    cast(count(*) as int) as n_events, string_agg(d || ': ' || text, chr(10) order by d, event_id) as text
  from win group by patient_id, resolution, window_start, window_end
)"""


@on(f"with {EVENT_SQL}, days as (select distinct d from rec) select d as date, r.r as resolution, {_window_sql()} from days, {_RES}")
def wn01_calendar_windows(spark: SparkSession, root: str) -> DataFrame:
    days = History(spark, root).events.select("date").distinct().withColumn("resolution", F.explode(F.array(*[F.lit(r) for r in windows.RESOLUTIONS])))
    first, last = windows.calendar_window(F.col("date"), F.col("resolution"))
    return days.select("date", "resolution", first.alias("window_start"), last.alias("window_end"))


@on(f"""with {EVENT_SQL}, days as (select distinct d from rec), w as (select d, r.r, {_window_sql()} from days, {_RES})
select d as date, r as resolution, case r when '1d' then strftime(d, '%Y-%m-%d') when '1mo' then strftime(d, '%Y-%m') else strftime(d, '%Y') end as window_key, (window_start - 1)::date as window_start, window_end from w""")
def wn02_keyed_windows(spark: SparkSession, root: str) -> DataFrame:
    days = History(spark, root).events.select("date").distinct().withColumn("resolution", F.explode(F.array(*[F.lit(r) for r in windows.RESOLUTIONS])))
    key, start, end = windows.keyed_window(F.col("date"), F.col("resolution"))
    return days.select("date", "resolution", key.alias("window_key"), start.alias("window_start"), end.alias("window_end"))


@on(f"""with {EVENT_SQL}, days as (select distinct d from rec)
select d as date, r.r as resolution, (case r.r when '1d' then d - 1 when '1mo' then (d - interval 1 month)::date else (d - interval 12 month)::date end)::date as window_start from days, {_RES}""")
def wn03_lookback_windows(spark: SparkSession, root: str) -> DataFrame:
    days = History(spark, root).events.select("date").distinct().withColumn("resolution", F.explode(F.array(*[F.lit(r) for r in windows.RESOLUTIONS])))
    return days.select("date", "resolution", windows.lookback_start(F.col("date"), F.col("resolution")).alias("window_start"))


_TILES = f"""with recursive {EVENT_SQL},
span as (select patient_id, min(d) as a, max(d) as b from rec group by 1),
tile(patient_id, a, window_no, window_start, window_end) as (
  select patient_id, a, 0, (b - interval 1 month)::date, b from span
  union all
  select patient_id, a, window_no + 1, (window_start - interval 1 month)::date, window_start from tile where window_start >= a
)"""


@on(_TILES + " select patient_id, window_no, window_start, window_end from tile")
def wn04_lookback_tiling(spark: SparkSession, root: str) -> DataFrame:
    spans = History(spark, root).events.groupBy("patient_id").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return windows.lookback_tiling(spans, "1mo")


@on(_TILES + """ select t.patient_id, t.window_no, t.window_start, t.window_end, e.event_id, e.d as date
from tile t join event e on e.patient_id = t.patient_id and e.d > t.window_start and e.d <= t.window_end""")
def jn09_sliding_range_join(spark: SparkSession, root: str) -> DataFrame:
    h = History(spark, root)
    spans = h.events.groupBy("patient_id").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return windows.assign_tiles(h.events, windows.lookback_tiling(spans, "1mo"))


_CUTS = ", ".join(f"(date '{c}')" for c in CUTOFFS)


@on(f"""with {EVENT_SQL}, {_WINDOWED}, cuts(c) as (values {_CUTS}),
parts as (select event_id, resolution, window_start, window_end from win union select w.event_id, w.resolution, w.window_start, least(w.window_end, c) from win w, cuts where c >= w.d and c < w.window_end)
select resolution, window_start, window_end, count(*) as n_slots from parts group by all""")
def wn05_clipped_windows(spark: SparkSession, root: str) -> DataFrame:
    h = History(spark, root)
    cutoffs = spark.createDataFrame([(c,) for c in CUTOFFS], "cutoff date")
    made = windows.windowed(h.events.select("patient_id", "event_id", "date"), cutoffs)
    return made.groupBy("resolution", "window_start", "window_end").agg(F.count("*").alias("n_slots"))


def _documents(h: History) -> DataFrame:
    return windows.window_documents(windows.windowed(h.texted.select("patient_id", "event_id", "date", "text")))


@on(f"with {EVENT_SQL}, {_WINDOWED} select document_id, patient_id, resolution, window_start, window_end, n_events, text, sha256(text) as text_sha256 from doc")
def wn06_window_documents(spark: SparkSession, root: str) -> DataFrame:
    return _documents(History(spark, root)).select("document_id", "patient_id", "resolution", "window_start", "window_end", "n_events", "text", "text_sha256")


_HISTORY = f"""{_WINDOWED},
hist as (select Id as patient_id, r.r as resolution from patient, {_RES}),
h as (
  select p.patient_id, p.resolution, min(d.window_start) as window_start, coalesce(sum(d.n_events), 0)::bigint as n_events,
    coalesce(string_agg(d.document_id, ',' order by d.window_start, d.window_end, d.document_id), '') as window_document_ids,
    sha256(coalesce(string_agg(d.text, chr(10) order by d.window_start, d.window_end, d.document_id), '{windows.EMPTY_HISTORY}')) as input_sha256
  from hist p left join doc d on d.patient_id = p.patient_id and d.resolution = p.resolution group by 1, 2
)"""


@on(f"with {EVENT_SQL}, {_HISTORY} select patient_id || ':multilabel::' || resolution || ':full-history:explicit' as document_id, patient_id, resolution, window_document_ids, window_start, n_events, input_sha256 from h")
def wn08_history_documents(spark: SparkSession, root: str) -> DataFrame:
    h = History(spark, root)
    return windows.history_documents(h.people, _documents(h)).withColumn("window_document_ids", _LIST("window_document_ids"))


@on(f"with {EVENT_SQL}, {_WINDOWED} select d.resolution, e.n as n_events, sum(d.n_events)::bigint as n_slots, sum(d.n_events)::bigint as n_covered, e.n = sum(d.n_events) as exact from doc d, (select count(*) as n from event) e group by d.resolution, e.n")
def se04_window_coverage(spark: SparkSession, root: str) -> DataFrame:
    h = History(spark, root)
    return windows.coverage(h.events, _documents(h))


@on(f"""with {EVENT_SQL}, {_WINDOWED} select d.patient_id || ':multilabel::' || d.resolution || ':full-history:explicit' as history_id,
  cast(row_number() over (partition by d.patient_id, d.resolution order by d.window_start, d.window_end, d.document_id) - 1 as int) as position, d.document_id, sha256(d.text) as text_sha256, d.n_events
from doc d join patient p on p.Id = d.patient_id""")
def jn12_window_references(spark: SparkSession, root: str) -> DataFrame:
    h = History(spark, root)
    documents = _documents(h)
    return windows.resolve_references(windows.history_documents(h.people, documents), documents)


@on(f"""with {EVENT_SQL}, y as (select patient_id, event_id, year(d) as y, min(year(d)) over (partition by patient_id) as lo, max(year(d)) over (partition by patient_id) as hi from event),
c as (select *, cast((y - lo) // 5 as int) as chunk_no from y)
select patient_id, chunk_no, cast(lo + chunk_no * 5 as int) as from_year, cast(least(lo + chunk_no * 5 + 4, hi) as int) as to_year, count(*) as n_events from c group by all""")
def wn10_period_chunks(spark: SparkSession, root: str) -> DataFrame:
    return windows.period_chunks(History(spark, root).events, 5)


@on(f"""with {EVENT_SQL}, {_WINDOWED},
t as (select patient_id, sum(length(text) // 4) as tokens, max(year(d)) - min(year(d)) + 1 as span from event group by 1)
select patient_id, cast(tokens as bigint) as tokens, cast(span as int) as span_years, cast(case when tokens <= 0 then span else least(greatest(1, cast(floor(0.7 * 200 / (tokens / greatest(span, 1))) as int)), greatest(span, 1)) end as int) as years_per_chunk from t""")
def wn11_auto_chunk_period(spark: SparkSession, root: str) -> DataFrame:
    per = History(spark, root).texted.groupBy("patient_id").agg(
        F.sum(F.floor(F.length("text") / 4)).cast("bigint").alias("tokens"), (F.max(F.year("date")) - F.min(F.year("date")) + 1).alias("span_years")
    )
    return per.withColumn("years_per_chunk", windows.auto_chunk_years(F.col("tokens"), F.col("span_years"), 200))


@on(f"""with {EVENT_SQL}, {_WINDOWED},
slot as (select w.patient_id || ':history:' || w.resolution || ':' || w.window_start || ':' || w.window_end || ':explicit' as document_id, w.event_id from win w),
got as (select s.document_id, l.concept_id, min(l.d) as first_date, string_agg(distinct s.event_id, ',' order by s.event_id) as evidence from slot s join label l using (event_id) group by 1, 2)
select d.document_id, p.concept_id, g.first_date is not null as positive, g.first_date, coalesce(g.evidence, '') as evidence_event_ids, case when g.first_date is null then 'no_recorded_target' else 'recorded_visible' end as information_status
from doc d cross join panel p left join got g on g.document_id = d.document_id and g.concept_id = p.concept_id where d.resolution = '1y'""")
def lb01_record_labels(spark: SparkSession, root: str) -> DataFrame:
    h = History(spark, root)
    made = labels.record_labels(h.events, _documents(h).where("resolution = '1y'"), h.labels, h.panel)
    return made.withColumn("evidence_event_ids", _LIST("evidence_event_ids"))


@on(f"""with {EVENT_SQL}, hist as (select Id as patient_id from patient), fam(task, family_id, n) as (values ('multilabel', null, {PANEL_SIZE}::bigint), ('differential', 'front', 3::bigint), ('evidence', null, {PANEL_SIZE}::bigint))
select p.patient_id, r.r as resolution, f.task, f.family_id, case when (select count(*) from panel) < {PANEL_SIZE} then null else f.n end as n_candidates from hist p, {_RES}, fam f""")
def lb06_task_documents(spark: SparkSession, root: str) -> DataFrame:
    from pyspark.sql import Window

    h = History(spark, root)
    ranked = h.panel.withColumn("k", F.row_number().over(Window.orderBy("concept_id")))  # six rows
    families = (
        ranked.select(F.lit("multilabel").alias("task"), F.lit(None).cast("string").alias("family_id"), "concept_id")
        .unionByName(ranked.where("k <= 3").select(F.lit("differential").alias("task"), F.lit("front").alias("family_id"), "concept_id"))
        .unionByName(ranked.select(F.lit("evidence").alias("task"), F.lit(None).cast("string").alias("family_id"), "concept_id"))
    )
    return labels.task_documents(windows.history_documents(h.people, _documents(h)), families).select("patient_id", "resolution", "task", "family_id", "n_candidates")


def _outcomes(h: History) -> DataFrame:
    return labels.risk_sets(h.people, h.events, h.first, h.panel, CUTOFFS, HORIZONS, SOURCE_END)


_AGE = "(year(c) - year(BIRTHDATE) - case when month(c) < month(BIRTHDATE) or (month(c) = month(BIRTHDATE) and day(c) < day(BIRTHDATE)) then 1 else 0 end)"
_RISK = f"""{EVENT_SQL},
span as (select patient_id, min(d) as a, max(d) as b from event group by 1),
cuts(c) as (values {_CUTS}), hor(h) as (values {', '.join(f'({h})' for h in HORIZONS)}),
base as (
  select p.Id as patient_id, BIRTHDATE, c, h, n.concept_id, f.first_date, coalesce(s.a <= c, false) as past, least(date '{SOURCE_END}', coalesce(s.b, c), DEATHDATE) as fu
  from patient p cross join cuts cross join hor cross join panel n left join span s on s.patient_id = p.Id left join first f on f.patient_id = p.Id and f.concept_id = n.concept_id
),
outcome as (
  select patient_id, {split_sql('patient_id')} as split,
    case when BIRTHDATE is null then 'unknown' when BIRTHDATE > c then 'not_born' when {_AGE} < 18 then '0-17' when {_AGE} < 40 then '18-39' when {_AGE} < 65 then '40-64' else '65+' end as age_bin,
    c as cutoff, h as horizon_days, concept_id,
    case when not (past and (BIRTHDATE is null or BIRTHDATE <= c) and fu >= c) then 'not_at_risk' when first_date <= c then 'prevalent'
      when first_date > c and first_date <= c + h and first_date <= fu then 'positive' when fu < c + h then 'censored' else 'negative' end as outcome
  from base
)"""


@on(f"with {_RISK} select patient_id, split, age_bin, cutoff, horizon_days, concept_id, outcome from outcome")
def lb02_incident_labels(spark: SparkSession, root: str) -> DataFrame:
    return _outcomes(History(spark, root))


@on(f"""with {_RISK} select cutoff, horizon_days, concept_id, coalesce(split, 'all') as split, {', '.join(f"count_if(outcome = '{o}')::bigint as {o}" for o in labels.OUTCOMES)},
count_if(outcome in ('positive', 'negative'))::bigint as eligible from outcome group by grouping sets ((cutoff, horizon_days, concept_id), (cutoff, horizon_days, concept_id, split))""")
def ag03_risk_set_summary(spark: SparkSession, root: str) -> DataFrame:
    return labels.risk_summary(_outcomes(History(spark, root)))


@on(f"with {_RISK} select cutoff, split, age_bin, count(distinct patient_id) as n_patients from outcome group by all")
def lb07_age_bins(spark: SparkSession, root: str) -> DataFrame:
    return labels.age_summary(_outcomes(History(spark, root)))


@on(f"with {EVENT_SQL} select l.patient_id, l.concept_id, string_agg(l.event_id, ',' order by l.event_id) as event_ids from label l join first f on f.patient_id = l.patient_id and f.concept_id = l.concept_id and f.first_date = l.d group by 1, 2")
def lb04_incident_evidence(spark: SparkSession, root: str) -> DataFrame:
    h = History(spark, root)
    return labels.incident_evidence(h.labels, h.first).withColumn("event_ids", _LIST("event_ids"))


_PREVALENCE = f"""{EVENT_SQL}, placed as (select Id as patient_id, {split_sql('Id')} as split from patient),
sizes as (select split, count(*) as patients from placed group by 1 union all select 'all', count(*) from placed),
had as (select coalesce(split, 'all') as split, concept_id, count(*) as n from placed join first using (patient_id) group by grouping sets ((concept_id), (concept_id, split))),
prev as (select p.concept_id, s.split, coalesce(h.n, 0)::bigint as positive_patients, s.patients from panel p cross join sizes s left join had h on h.concept_id = p.concept_id and h.split = s.split)"""


@on(f"with {_PREVALENCE} select concept_id, split, positive_patients, patients from prev")
def ag02_prevalence(spark: SparkSession, root: str) -> DataFrame:
    h = History(spark, root)
    return labels.prevalence(h.people, h.first, h.panel)


_EVERY_CODE = _PREVALENCE.replace(PANEL_SQL, "panel as (select distinct CODE as concept_id from condition)")


@on(f"""with {_EVERY_CODE} select concept_id, max(case when split = 'all' then positive_patients end)::bigint as positive_patients from prev group by 1
having bool_or(split <> 'all' and positive_patients in (0, patients)) or coalesce(max(case when split = 'all' then positive_patients end), 0) = 0""")
def ag05_rare_concepts(spark: SparkSession, root: str) -> DataFrame:
    """Over all codes of the conditions, not those of the panel alone."""
    h = History(spark, root)
    codes = h.tables["conditions"].select(F.col("CODE").alias("concept_id")).distinct()
    first = events.first_dates(events.labelled(h.events, codes.withColumn("code", F.col("concept_id"))))
    return labels.rare_concepts(labels.prevalence(h.people, first, codes))


@on(f"with {_PREVALENCE} select f.concept_id, count(distinct f.patient_id) as positive_patients from first f join patient p on p.Id = f.patient_id group by 1 having count(distinct f.patient_id) >= 3 and (select count(*) from patient) - count(distinct f.patient_id) >= 3")
def ag06_eligible_concepts(spark: SparkSession, root: str) -> DataFrame:
    h = History(spark, root)
    return labels.eligible_concepts(h.people, h.first, 3)


@on("select task || ':' || level as scope, count(*) as n_documents, count(distinct document_id) as n_distinct from clinical_tasks group by 1 union all select task || ':' || resolution || ':' || level || ':' || explicitness, count(*), count(distinct document_id) from clinical_tasks group by 1")
def ag04_document_counts(spark: SparkSession, root: str) -> DataFrame:
    tasks = spark.read.parquet(f"{root}/clinical_tasks.parquet")
    scoped = tasks.select("document_id", F.explode(F.array(F.concat(F.col("task"), F.lit(":"), F.col("level")), F.concat("task", F.lit(":"), "resolution", F.lit(":"), "level", F.lit(":"), "explicitness"))).alias("scope"))
    return scoped.groupBy("scope").agg(F.count("*").alias("n_documents"), F.countDistinct("document_id").alias("n_distinct"))


@on(f"with {EVENT_SQL}, c as (select {split_sql('Id')} as split, count(e.event_id) as n from patient p left join event e on e.patient_id = p.Id group by p.Id, 1) select split, count(*) as n_patients, sum(n)::bigint as n_events, count_if(n = 0)::bigint as without_events from c group by 1")
def ag25_split_counts(spark: SparkSession, root: str) -> DataFrame:
    h = History(spark, root)
    n = h.events.groupBy("patient_id").agg(F.count("*").alias("n"))
    per = h.people.select(F.col("Id").alias("patient_id"), splits.hash_split(F.col("Id")).alias("split")).join(n, "patient_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return per.groupBy("split").agg(F.count("*").alias("n_patients"), F.sum("n").alias("n_events"), F.count_if(F.col("n") == 0).alias("without_events"))


@on(f"with {CLEAN_SQL} select Id as patient_id, {split_sql('Id')} as split from patient")
def sp01_hash_split(spark: SparkSession, root: str) -> DataFrame:
    return History(spark, root).people.select(F.col("Id").alias("patient_id"), splits.hash_split(F.col("Id")).alias("split"))


@on(f"""with {CLEAN_SQL}, s as (select distinct coalesce(GENDER, 'none') as stratum, Id from patient),
k as (select *, row_number() over (partition by stratum order by sha256('0:' || Id), Id) as rk, count(*) over (partition by stratum) as n from s)
select stratum, Id, case when rk <= greatest(1, floor(n * 0.6)) then 'train' when rk <= greatest(1, floor(n * 0.6)) + greatest(1, floor(n * 0.2)) then 'validation' else 'test' end as split from k""")
def sp03_stratified_split(spark: SparkSession, root: str) -> DataFrame:
    people = History(spark, root).people.select("Id", F.coalesce("GENDER", F.lit("none")).alias("stratum"))
    return splits.stratified_split(people, "stratum", "Id")


def _cohort_labels(h: History) -> DataFrame:
    every = h.people.select(F.col("Id").alias("patient_id"), splits.hash_split(F.col("Id")).alias("split")).join(F.broadcast(h.panel))
    return every.join(h.first.withColumn("positive", F.lit(True)), ["patient_id", "concept_id"], "left").withColumn("positive", F.coalesce("positive", F.lit(False)))


_COHORT = f"""{EVENT_SQL}, l as (select p.Id as patient_id, {split_sql('p.Id')} as split, n.concept_id, f.first_date is not null as positive from patient p cross join panel n left join first f on f.patient_id = p.Id and f.concept_id = n.concept_id),
k as (select *, row_number() over (partition by concept_id, split, positive order by sha256('0:cohort:' || concept_id || ':' || patient_id), patient_id) as rk,
  count_if(positive) over (partition by concept_id, split) as a, count_if(not positive) over (partition by concept_id, split) as b from l),
cohort as (select concept_id, split, patient_id, positive from k where rk <= least(a, b, greatest(3, floor(least(a, b) * 0.5))))"""


@on(f"with {_COHORT} select concept_id, split, patient_id, positive from cohort")
def sp04_balanced_cohort(spark: SparkSession, root: str) -> DataFrame:
    return splits.balanced_cohort(_cohort_labels(History(spark, root)), fraction=0.5)


@on(f"with {_COHORT} select concept_id, count_if(split = 'train')::bigint as train, count_if(split = 'validation')::bigint as validation, count_if(split = 'test')::bigint as test from cohort where positive group by 1")
def ag07_target_counts(spark: SparkSession, root: str) -> DataFrame:
    chosen = splits.balanced_cohort(_cohort_labels(History(spark, root)), fraction=0.5).where("positive")
    return chosen.groupBy("concept_id").agg(*[F.count_if(F.col("split") == s).alias(s) for s in labels.SPLITS])


@on(f"""with {CLEAN_SQL}, s as (select count(*) as n, floor(0.6::double * count(*))::bigint as a, floor(0.8::double * count(*))::bigint as b from patient)
select 'train' as split, a as n_patients, true as classes_kept from s union all select 'validation', b - a, true from s union all select 'test', n - b, true from s""")
def sp02_shuffled_split(spark: SparkSession, root: str) -> DataFrame:
    """Parity mode: the ids of a bounded cohort are shuffled until each common concept has cases and controls everywhere."""
    h = History(spark, root)
    ids = [r[0] for r in h.people.select("Id").limit(splits.MAX_DRIVER_IDS + 1).collect()]
    known = h.first.select("concept_id", "patient_id").distinct()
    n = known.groupBy("concept_id").agg(F.count("*").alias("n")).where((F.col("n") >= 40) & (F.col("n") <= len(ids) - 40))
    positives: dict[str, set[str]] = {}
    for r in known.join(n, "concept_id").select("concept_id", "patient_id").collect():
        positives.setdefault(r[0], set()).add(r[1])
    made = splits.shuffled_split(ids, positives, seed=7)
    parts = {name: {p for p, s in made.items() if s == name} for name in ("train", "validation", "test")}
    kept = {name: all(len(part & case) >= 3 and len(part - case) >= 3 for case in positives.values()) for name, part in parts.items()}
    return spark.createDataFrame([(name, len(part), kept[name]) for name, part in parts.items()], "split string, n_patients long, classes_kept boolean")


@on(f"""with {EVENT_SQL} select l.patient_id, l.concept_id, e.cutoff, max(l.d) as last_date, count(*) as n_before from label l, (values {_CUTS}) e(cutoff) where l.d <= e.cutoff group by all""")
def jn11_as_of_cutoff(spark: SparkSession, root: str) -> DataFrame:
    """What is known at each cutoff: all labels up to it, and the latest of them."""
    h = History(spark, root)
    cut = spark.createDataFrame([(c,) for c in CUTOFFS], "cutoff date")
    return h.labels.join(F.broadcast(cut), F.col("date") <= F.col("cutoff")).groupBy("patient_id", "concept_id", "cutoff").agg(F.max("date").alias("last_date"), F.count("*").alias("n_before"))


@on(f"with {EVENT_SQL} select patient_id from rec intersect select Id from patient")
def se02_intersection(spark: SparkSession, root: str) -> DataFrame:
    h = History(spark, root)
    return h.events.select("patient_id").intersect(h.people.select("Id"))


@on(f"with {EVENT_SQL} select distinct code as concept_code from rec where code is not null and code not in (select concept_id from panel)")
def se03_difference(spark: SparkSession, root: str) -> DataFrame:
    """Codes of events that are none of the panel's."""
    h = History(spark, root)
    return h.events.select(F.explode("codes").alias("concept_code")).distinct().join(h.panel.select(F.col("concept_id").alias("concept_code")), "concept_code", "left_anti")


AS_OF = date(2024, 1, 1)
QUERIES, ORACLES = registry.queries, registry.oracles
