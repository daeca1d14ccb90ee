"""The eight-patient history: bundles, windows, labels and risk sets."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from medlattice.operators import events, labels, splits, tasks, windows

from .conftest import day, rows

CUTOFF, END = date(2020, 1, 1), date(2021, 3, 1)


@pytest.fixture(scope="module")
def tables(spark):
    """Prevalent, incident by an indication's code, control, censored, dead, diagnosis only, born later, silent."""
    people = [("prev", "1950-05-05", None), ("inc", "1960-01-01", None), ("ctl", "1970-02-29".replace("29", "28"), None), ("cens", "1980-01-01", None), ("dead", "1940-01-01", "2020-02-01"), ("dx", "1990-01-01", None), ("late", "2020-06-01", None), ("none", "2000-01-01", None)]
    enc = [
        ("e1", "prev", "2019-05-01", "visit", None, None), ("e2", "prev", "2021-02-01", "visit", None, None), ("e3", "inc", "2019-06-01", "visit", None, None), ("e4", "inc", "2021-02-10", "visit", None, None),
        ("e5", "ctl", "2018-01-01", "visit", None, None), ("e6", "ctl", "2021-02-20", "visit", None, None), ("e7", "cens", "2019-12-01", "visit", None, None), ("e8", "cens", "2020-02-01", "visit", None, None),
        ("e9", "dead", "2019-01-01", "visit", None, None), ("e12", "dead", "2020-01-15", "visit", None, None), ("e10", "late", "2020-07-01", "visit", None, None), ("e11", "inc", "2020-02-15", "check", "D2", "diabetic eye"),
    ]
    cond = [("prev", "e1", "2019-05-01", "D1", "diabetes"), ("dx", None, "2020-12-01", "H1", "heart failure")]
    obs = [("ctl", "e6", "2021-02-20", "glucose", "5", "mmol/L"), ("inc", "e3", "2019-06-01", "pressure", "120", "mmHg")]
    d = lambda rs, k: [(*r[:k], day(r[k]), *r[k + 1 :]) for r in rs]
    return {
        "patients": spark.createDataFrame([(i, day(b), day(x)) for i, b, x in people], "Id string, BIRTHDATE date, DEATHDATE date"),
        "encounters": spark.createDataFrame(d(enc, 2), "Id string, PATIENT string, START date, DESCRIPTION string, REASONCODE string, REASONDESCRIPTION string"),
        "conditions": spark.createDataFrame(d(cond, 2), "PATIENT string, ENCOUNTER string, START date, CODE string, DESCRIPTION string"),
        "observations": spark.createDataFrame(d(obs, 2), "PATIENT string, ENCOUNTER string, DATE date, DESCRIPTION string, VALUE string, UNITS string"),
    }


@pytest.fixture(scope="module")
def bridge(spark):
    return spark.createDataFrame([("diabetes", "D1"), ("diabetes", "D2"), ("heart", "H1")], "concept_id string, code string")


def test_bundles(tables):
    made = {r["event_id"]: r for r in events.bundle(tables).collect()}
    assert len(made) == 13
    first = made["prev-2019-05-01"]
    assert [tuple(f) for f in first["facts"]] == [("Encounter", "visit")] and first["codes"] == ["D1"] and first["diagnoses"] == ["diabetes"]
    assert [tuple(f) for f in made["ctl-2021-02-20"]["facts"]] == [("Encounter", "visit"), ("Observations", "glucose: 5 mmol/L")]
    assert made["inc-2020-02-15"]["codes"] == ["D2"] and made["dx-2020-12-01"]["facts"] == [] and made["dx-2020-12-01"]["encounter_ids"] == []


def test_a_record_without_a_day_is_an_error(spark, tables):
    bad = dict(tables, conditions=tables["conditions"].withColumn("START", F.lit(None).cast("date")))
    with pytest.raises(Exception, match="no date"):
        events.bundle(bad).count()


def test_risk_sets(tables, bridge):
    told = events.bundle(tables)
    found = events.labelled(told, bridge)
    outcomes = labels.risk_sets(tables["patients"], told, events.first_dates(found), bridge.select("concept_id").distinct(), [CUTOFF], [90, 365], END)
    assert outcomes.groupBy("patient_id", "concept_id", "horizon_days").count().where("count <> 1").count() == 0
    got = labels.risk_summary(outcomes).where("split = 'all' and concept_id = 'diabetes' and horizon_days = 90").first()
    assert {k: got[k] for k in ("eligible", *labels.OUTCOMES)} == {"eligible": 2, "positive": 1, "negative": 1, "censored": 2, "prevalent": 1, "not_at_risk": 3}


@pytest.mark.parametrize(("first", "outcome"), [("2020-01-01", "prevalent"), ("2020-03-31", "positive"), ("2020-04-01", "negative"), (None, "negative")])
def test_horizon_boundary(spark, first, outcome):
    df = spark.createDataFrame([(day(first),)], "f date")
    made = labels.incident_outcome(F.lit(True), F.lit(None).cast("date"), F.col("f"), F.lit(END), F.lit(CUTOFF), F.lit(90))
    assert df.select(made).first()[0] == outcome


def test_windows(spark):
    df = spark.createDataFrame([(day("2024-03-31"),), (day("2024-02-29"),)], "d date")
    assert rows(df.select(windows.lookback_start(F.col("d"), F.lit("1mo")), windows.lookback_start(F.col("d"), F.lit("1y")))) == [(date(2024, 1, 29), date(2023, 2, 28)), (date(2024, 2, 29), date(2023, 3, 31))]
    first, last = windows.calendar_window(F.col("d"), F.lit("1mo"))
    assert rows(df.select(first, last)) == [(date(2024, 2, 1), date(2024, 2, 29)), (date(2024, 3, 1), date(2024, 3, 31))]
    with pytest.raises(Exception, match="unknown resolution"):
        df.select(windows.calendar_window(F.col("d"), F.lit("1w"))[0]).collect()


def test_tiling_drifts_and_covers_once(spark):
    spans = spark.createDataFrame([("a", day("2023-12-15"), day("2024-03-31"))], "patient_id string, first_date date, last_date date")
    tiles = windows.lookback_tiling(spans, "1mo")
    assert [r["window_end"] for r in tiles.orderBy("window_no").collect()] == [date(2024, 3, 31), date(2024, 2, 29), date(2024, 1, 29), date(2023, 12, 29)]
    days = spark.range(107).select(F.lit("a").alias("patient_id"), F.col("id").cast("string").alias("event_id"), F.date_add(F.lit(day("2023-12-15")), F.col("id").cast("int")).alias("date"))
    held = windows.assign_tiles(days, tiles)
    assert days.where("date <= '2024-03-31'").count() == held.count() == held.select("event_id").distinct().count()


def test_corpus(tables, bridge):
    made = tasks.clinical_tasks(tables, bridge, ["diabetes", "diabetic"], [CUTOFF], [90], END)
    docs = made.documents
    assert docs.where("explicitness = 'implicit'").where(F.lower("text").rlike("diabet")).count() == 0
    assert docs.groupBy("document_id").count().where("count > 1").count() == 0
    assert docs.where("window_end = '2020-01-01' and resolution = '1y'").count() == 0  # nobody has an event in 2020 up to the cutoff
    explicit = made.labels.join(docs.where("explicitness = 'explicit'"), "document_id").where("positive")
    assert {r[0] for r in explicit.select("information_status").distinct().collect()} == {"recorded_visible"}
    maps = labels.label_rows(made.labels).first()
    assert len(maps["candidate_ids"]) == 2 and set(maps["information_status"]) == {"diabetes", "heart"}
    histories = windows.history_documents(tables["patients"], docs.where("explicitness = 'explicit'"))
    assert histories.count() == 8 * 3 and histories.where("n_events = 0").select("patient_id").distinct().collect() == [("none",)]


def test_clipping_to_one_day(spark):
    e = spark.createDataFrame([("p", "p-1", day("2020-01-01")), ("p", "p-2", day("2020-01-20"))], "patient_id string, event_id string, date date")
    made = windows.windowed(e, spark.createDataFrame([(CUTOFF,)], "cutoff date")).where("resolution = '1mo'")
    assert rows(made.select("event_id", "window_end")) == [("p-1", date(2020, 1, 1)), ("p-1", date(2020, 1, 31)), ("p-2", date(2020, 1, 31))]


def test_splits(spark):
    ids = [f"p{i}" for i in range(4000)]
    df = spark.createDataFrame([(i,) for i in ids], "p string")
    got = dict(df.select("p", splits.hash_split(F.col("p"), 42)).collect())
    import hashlib

    for p in ids[:500]:
        u = int.from_bytes(hashlib.sha256(f"42:{p}".encode()).digest()[:8], "big") / 2**64
        assert got[p] == ("train" if u < 0.6 else "validation" if u < 0.8 else "test")
    a = splits.shuffled_split(ids[:60], {"c": set(ids[:20])}, 1)
    assert a == splits.shuffled_split(ids[59::-1], {"c": set(ids[:20])}, 1) and sorted(a.values()).count("train") == 36
    with pytest.raises(ValueError):
        splits.shuffled_split(ids[:10], {"c": {"p1"}}, 1, attempts=5)
    strata = splits.stratified_split(spark.createDataFrame([("s", i) for i in ids[:3]] + [("t", i) for i in ids[:10]], "s string, p string"), "s", "p")
    assert rows(strata.groupBy("s", "split").count()) == [("s", "test", 1), ("s", "train", 1), ("s", "validation", 1), ("t", "test", 2), ("t", "train", 6), ("t", "validation", 2)]


def test_prevalence_keeps_zeros(spark, tables, bridge):
    told = events.bundle(tables)
    first = events.first_dates(events.labelled(told, bridge))
    panel = spark.createDataFrame([("diabetes",), ("nothing",)], "concept_id string")
    made = {(r["concept_id"], r["split"]): r["positive_patients"] for r in labels.prevalence(tables["patients"], first, panel).collect()}
    assert made["diabetes", "all"] == 2 and made["nothing", "all"] == 0
    assert "nothing" in {r[0] for r in labels.rare_concepts(labels.prevalence(tables["patients"], first, panel)).select("concept_id").collect()}


def test_benchmark_balances(spark):
    people = spark.range(60).select(F.concat(F.lit("p"), "id").alias("Id"), F.lit(day("1970-01-01")).alias("BIRTHDATE"), F.lit(None).cast("date").alias("DEATHDATE"))
    enc = spark.range(60).select(F.concat(F.lit("e"), "id").alias("Id"), F.concat(F.lit("p"), "id").alias("PATIENT"), F.lit(day("2020-02-29")).alias("START"), F.lit("visit").alias("DESCRIPTION"))
    cond = spark.range(25).select(F.concat(F.lit("p"), "id").alias("PATIENT"), F.concat(F.lit("e"), "id").alias("ENCOUNTER"), F.lit(day("2001-01-01")).alias("START"), F.lit("X").alias("CODE"), F.lit("x").alias("DESCRIPTION"))
    made = tasks.benchmark({"patients": people, "encounters": enc, "conditions": cond}, spark.createDataFrame([("x", "X")], "concept_id string, code string"), ["x"])
    n = {(r["split"], r["case"]): r["count"] for r in made.labels.groupBy("split", "case").count().collect()}
    assert all(n[s, True] == n[s, False] for s in {k[0] for k in n})
    assert made.documents.where("positive and window_start >= '2019-12-31'").count() == 0
    assert {r[0] for r in made.documents.select("negative_type").distinct().collect()} == {"case", "history_outside_window", "other_conditions"}
