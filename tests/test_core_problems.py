"""Orphans, flattening, pivoting and feature tables on small fixtures with awkward cases."""

import json
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from medlattice.functions.ids import canonical_id
from medlattice.operators import features, flatten, orphans, pivot
from medlattice.operators.orphans import Reference

from .conftest import day, rows, ts

A, B, C = "0a1b2c3d-0000-4000-8000-00000000000a", "0a1b2c3d-0000-4000-8000-00000000000b", "0a1b2c3d-0000-4000-8000-00000000000c"
PATIENTS = "row_id long, Id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, key string, parent string"
REFS = "row_id long, PATIENT string, loaded_at timestamp_ntz, start string, key string"


def test_canonical_id(spark):
    spellings = [A, A.upper(), A.replace("-", ""), "{" + A.upper() + "}", "urn:uuid:" + A, "Patient/" + A, A + "\t", "  " + A + " "]
    bad = [None, "", " ", "legacy-1", "0a1b2c3d-0000-4", "#REF!", A + "0", "0"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in spellings + bad], "s string").select(canonical_id("s")).collect()]
    assert got == [A.replace("-", "")] * len(spellings) + [None] * len(bad)


def _state(spark, patients, refs, periods):
    p = orphans.parent_intervals(spark.createDataFrame(patients, PATIENTS), "patients")
    r = orphans.references(spark.createDataFrame(refs, REFS), Reference("conditions", "PATIENT", "patients"))
    return orphans.replay(r, p, periods)


@pytest.mark.parametrize("periods", [1, 2, 5])
def test_orphans(spark, periods):
    patients = [
        (1, A, ts("2020-01-10"), ts("2020-02-01"), "x", "y"), (2, A.upper(), ts("2020-03-01"), None, "x", "y"), (3, A, ts("2020-01-10"), ts("2020-02-01"), "x", "y"),
        (4, B, ts("2020-05-01"), None, None, None), (5, None, ts("2020-05-01"), None, None, None), (6, C, None, None, None, None), (7, C, ts("2020-01-01"), ts("2020-01-01"), None, None),
    ]
    refs = [
        (1, A, ts("2020-01-09"), "k", "k"), (2, "urn:uuid:" + A, ts("2020-01-10"), "k", "k"), (3, A, ts("2020-01-31T23:59:59"), "k", "k"), (4, A, ts("2020-02-01"), "k", "k"),
        (5, A, ts("2020-03-01"), "k", "k"), (6, B, ts("2020-04-30"), "k", "k"), (7, B, ts("2020-06-01"), "k", "k"), (8, "n/a", ts("2020-06-01"), "k", "k"), (9, " \t", ts("2020-06-01"), "k", "k"),
        (10, None, ts("2020-06-01"), "k", "k"), (11, C, ts("2020-06-01"), "k", "k"), (12, A, None, "k", "k"), (2, "urn:uuid:" + A, ts("2020-01-10"), "k", "k"),
    ]
    state = _state(spark, patients, refs, periods)
    assert sorted(r[0] for r in state.orphans.select("row_id").collect()) == [1, 4, 6, 8, 11, 12]
    counts = orphans.snapshot(state).agg(F.sum("n_refs"), F.sum("n_orphans"), F.sum("n_open")).first()
    assert tuple(counts) == (11, 6, 2)  # the unreadable one and the one of C stay open
    before = orphans.snapshot(state, ts("2020-02-15")).agg(F.sum("n_open")).first()[0]
    assert before == 11  # deletion reopened those of A, B is not there yet


def test_orphans_against_brute_force(spark):
    random.seed(3)
    ids = [f"{i:032x}" for i in range(12)]
    when = lambda: ts("2020-01-01") + timedelta(hours=random.randrange(2000))
    patients = []
    for i in range(60):
        a = when()
        patients.append((i, random.choice(ids), a, random.choice([None, a + timedelta(hours=random.randrange(300))]), None, None))
    refs = [(i, random.choice(ids[:3] if i % 3 else ids), when(), None, None) for i in range(400)]
    want = {r[0] for r in refs if not any(p[1] == r[1] and p[2] <= r[2] and (p[3] is None or p[3] > r[2]) for p in patients)}
    state = _state(spark, patients, refs, 4)
    assert {r[0] for r in state.orphans.select("row_id").collect()} == want


def test_orphans_of_empty_tables(spark):
    state = _state(spark, [], [], 3)
    assert state.orphans.count() == 0 and orphans.snapshot(state).count() == 0


BODIES = [
    {"resourceType": "Bundle", "entry": [{"resource": {"resourceType": "Patient", "id": "p", "name": [None, {"family": ""}, {"given": ["A", None, "B"]}, "plain"], "address": {"line": "1 Road", "city": None},
        "contact": [None, {"name": {"extension": [{"value": 0}]}, "address": []}, {"name": None}]}}, {}, None, {"resource": None}, {"resource": {"resourceType": "Location", "name": "Ward", "address": [{}, {"x": {"y": [{"z": "v"}]}}]}}]},
    {"resourceType": "Patient", "id": "q", "name": {"family": "Solo"}, "contact": {"name": {"family": "C"}}},
    {"resourceType": "Bundle", "entry": {"resource": {"resourceType": "Patient", "name": []}}},
    {"resourceType": "Bundle", "entry": None}, {"resourceType": "Bundle"}, [], None, 5,
]


def test_flatten(spark):
    texts = [json.dumps(b) for b in BODIES] + ["﻿" + json.dumps(BODIES[1]), json.dumps(json.dumps(BODIES[1])), json.dumps(BODIES[1])[:-9], "", None, "ERROR", " \n" + json.dumps(BODIES[1]) + "\t"]
    df = spark.createDataFrame([(i, t, "extra", i) for i, t in enumerate(texts)], "record_id long, body string, owner string, entry_no int")
    got = rows(flatten.objects(flatten.flatten(df, "items")))
    solo = lambda i: [(i, 0, "contact", 0, "name", 0), (i, 0, "resource", 0, "name", 0)]
    want = [(0, 0, "resource", 0, "name", 2), (0, 0, "resource", 0, "address", 0), (0, 0, "contact", 1, "name", 0), (0, 4, "resource", 0, "address", 1), *solo(1), *solo(8), *solo(9), *solo(14)]
    assert got == sorted(want, key=repr)
    parts = {tuple(r) for r in flatten.flatten(df, "parts").where("record_id = 0").select("part", "item_no", "part_no", "value").collect()}
    assert parts == {("given", 2, 0, "A"), ("given", 2, 2, "B"), ("line", 0, 0, "1 Road")}
    items = flatten.flatten(df, "items").where("record_id = 0 and entry_no = 0 and kind = 'name' and owner = 'resource'").select("item_no", "is_object", "filled", "text").collect()
    assert sorted(tuple(r) for r in items) == [(1, True, False, None), (2, True, True, None), (3, False, False, "plain")]
    assert rows(flatten.flatten(df, "resources").where("record_id = 0").select("entry_no", "resource_type")) == [(0, "Patient"), (4, "Location")]
    assert rows(flatten.flatten(df, "contacts").where("record_id = 0").select("contact_no")) == [(1,), (2,)]


def test_flatten_links_and_long_bodies(spark):
    deep = {"resourceType": "Patient", "name": [{"family": "x" * 200_000}] * 300}
    nested = {"resourceType": "Patient", "name": {"e": "[" * 0}}
    bottom = "[" * 5000 + "]" * 5000
    df = spark.createDataFrame([(1, json.dumps(deep)), (2, json.dumps(nested)), (3, bottom)], "record_id long, body string")
    assert flatten.flatten(df, "items").groupBy("record_id").count().collect() and flatten.objects(flatten.flatten(df, "items")).where("record_id = 1").count() == 300
    parents = flatten.flatten(df, "resources").select("record_id", "entry_no")
    assert flatten.flatten(df, "items").join(parents, ["record_id", "entry_no"], "left_anti").count() == 0
    empty = spark.createDataFrame([], "record_id long, body string")
    assert all(flatten.flatten(empty, t).count() == 0 for t in flatten.SCHEMAS)


NPX = "sample_id string, protein_id string, npx double, qc_warning boolean, group string, plate_id string, panel string, assay_no int, measured_at timestamp_ntz, loaded_at timestamp_ntz, row_id long, low double, own string"
PANELS = [("p1", 0, "X1A", 1.0, 5.0, 1.0), ("p1", 1, "X2B", 1.0, 5.0, 1.0), ("p2", 0, "X1A", 1.0, 5.0, 1.0)]
PANEL = "panel string, assay_no int, protein_id string, lod double, mean double, sd double"


def reading(i, sample, protein, npx, panel="p1", assay=0, qc=False, group="case", at="2021-01-01", loaded="2021-01-02"):
    return (sample, protein, npx, qc, group, "pl", panel, assay, None if at is None else ts(at), ts(loaded), i, 0.0, "own")


def test_pivot_and_conflicts(spark):
    data = [
        reading(1, "S1", "X1A", 5.0), reading(2, "S1", " x1a ", 5.0), reading(3, "S1", "UniProt:X1A", 5.02, "p2"), reading(4, "S1", None, 7.0, "p1", 1), reading(5, "S1", "n/a", 7.005, "p1", 1),
        reading(6, "S2", "X1A", float("nan")), reading(7, "S2", "X1A", -99.0), reading(8, "S2", "?", 4.0, "zz", 9), reading(9, None, "X1A", 4.0), reading(10, "S3", "X2B", None),
        reading(11, "S4", "X1A", 1.0, qc=True, at="2022-01-01"), reading(12, "S4", "X1A", 2.0, qc=None), reading(13, "S4", "X1A", float("inf")), reading(14, "S4", "X1A", 2.0, at=None),
    ]
    npx, panels = spark.createDataFrame(data, NPX), spark.createDataFrame(PANELS, PANEL).withColumn("own", F.lit(1))
    assert rows(pivot.conflicting_cells(npx, panels)) == [("S1", "X1A"), ("S4", "X1A")]
    assert rows(pivot.wide_npx(npx, panels, block=1)) == [("S1", 5.02, 7.005), ("S4", 2.0, None)]
    empty = npx.where("false")
    assert pivot.wide_npx(empty, panels).columns == ["sample_id", "X1A", "X2B"] and pivot.wide_npx(empty, panels).count() == 0
    assert pivot.wide_npx(npx, panels.where("false")).count() == 0


@pytest.mark.parametrize("block", [1, 3, 64])
def test_block_pivot_round_trip(spark, block):
    random.seed(block)
    names = [f"a.{i}" for i in range(7)]
    cells = sorted({(e, a): (e, a, random.random()) for e in range(20) for a in random.sample(names, 3)}.values())
    df = spark.createDataFrame(cells, "e int, a string, v double")
    wide = pivot.block_pivot(df, "e", "a", {"v": "{}"}, names, block)
    assert wide.columns == ["e", *names]
    assert rows(pivot.melt(wide, "e", {n: n for n in names}, "a", "v")) == sorted(cells, key=repr)
    assert "Exchange" in (plan := wide._jdf.queryExecution().executedPlan().toString()) and plan.count("hashpartitioning(e") <= -(-7 // block) + 1


def test_block_pivot_shuffles_once(spark):
    df = spark.createDataFrame([(1, "a", 1.0)], "e int, a string, v double")
    wide = pivot.block_pivot(df, "e", "a", {"v": "{}"}, ["a", "b", "c"], block=1)
    wide.collect()
    assert wide._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS") == 0


CONDITIONS = "row_id long, PATIENT string, ENCOUNTER string, START date, STOP date, CODE string, loaded_at timestamp_ntz, n long, code_ string"


def entry(i, patient, start, stop, code, encounter="e"):
    return (i, patient, encounter, day(start), day(stop), code, ts("2024-01-01"), 0, "")


def test_features(spark):
    data = [
        entry(1, A, "2020-01-10", "2020-01-20", "111"), entry(2, A.upper(), "2020-01-10", "2020-01-20", "SNOMED:111"), entry(3, A, "2020-01-10", "2020-01-25", "111"),
        entry(4, A, "2020-06-10", None, " 222 "), entry(5, A, "2020-06-20", "2020-06-18", "222"), entry(6, A, "2020-07-01", None, "222"),
        entry(7, B, "1900-01-01", None, "111"), entry(8, B, "2099-12-31", None, "111"), entry(9, None, "2020-01-01", None, "111"), entry(10, B, "2020-01-01", None, ""), entry(11, B, None, None, "333"),
        entry(12, B, "2019-01-01", "2020-06-12", "333"), entry(13, B, "2019-01-01", "2100-01-01", "111", None),
    ]
    df = spark.createDataFrame(data, CONDITIONS)
    as_of = date(2020, 6, 15)
    got = {r["PATIENT"]: r.asDict() for r in features.feature_table(df, as_of, block=2).collect()}
    a, b = got[A.replace("-", "")], got[B.replace("-", "")]
    assert (a["n_111"], a["recency_111"], a["days_111"]) == (2, 157, 25)
    assert (a["n_222"], a["recency_222"], a["days_222"]) == (1, 5, 5)
    assert (a["n_333"], a["recency_333"], a["days_333"]) == (0, None, 0)
    assert (b["n_333"], b["recency_333"], b["days_333"]) == (1, 531, 528)
    assert (b["n_111"], b["days_111"]) == (1, 531)
    assert len(got) == 2 and features.feature_table(df.where("false"), as_of).count() == 0


def test_features_incremental(spark, tmp_path):
    random.seed(5)
    start = lambda: date(2019, 1, 1) + timedelta(days=random.randrange(600))
    data = []
    for i in range(300):
        s = start()
        data.append((i, random.choice([A, B]), f"e{i}", s, random.choice([None, s + timedelta(days=random.randrange(200))]), random.choice("12"), ts("2024-01-01"), 0, ""))
    df = spark.createDataFrame(data, CONDITIONS)
    for part in (df.where("row_id < 250"), df.where("row_id >= 240"), df.where("row_id = 3"), df.where("false")):
        partials, everything = features.update_store(str(tmp_path / "store"), part, 40)
    assert everything.count() == 300
    for as_of in (date(2019, 8, 31), date(2020, 1, 1), date(2021, 3, 15)):
        want = {}
        for _, p, _, s, e, c, *_ in data:
            if s <= as_of:
                n, last, total = want.get((p, c), (0, date.min, 0))
                want[p, c] = (n + 1, max(last, s), total + (min(e or as_of, as_of) - s).days)
        got = {(r["p"], r["code"]): (r["n"], r["recency_days"], r["total_days"]) for r in features.long_features(partials, everything, as_of).withColumn("p", F.lower(F.hex("patient"))).collect()}
        assert got == {(p.replace("-", ""), c): (n, (as_of - last).days, total) for (p, c), (n, last, total) in want.items()}


def test_stored_partials(spark, tmp_path):
    random.seed(6)
    data = [(i, random.choice([A, B]), f"e{i}", date(2017, 1, 1) + timedelta(days=random.randrange(1000)), None, random.choice("12"), ts("2024-01-01"), 0, "") for i in range(120)]
    df = spark.createDataFrame(data, CONDITIONS)
    path = str(tmp_path / "store")
    features.update_store(path, df.where("row_id < 100"))
    times = lambda: {p: p.stat().st_mtime_ns for what in ("entries", "partials") for p in (tmp_path / "store" / what / "start_bucket=2017-01-01").iterdir()}
    untouched = times()
    partials, _ = features.update_store(path, df.where("START >= '2018-06-01'"))
    assert times() == untouched and len(untouched) > 2
    whole = features.bucket_partials(features.entries(df.where("row_id < 100 or START >= '2018-06-01'")))
    assert rows(partials.select(*whole.columns)) == rows(whole)


def _tracked(spark, deliveries, folder=None):
    """Deliveries are (patients, references, until) in the order they come."""
    state = None
    for number, (patients, refs, until) in enumerate(deliveries):
        p = orphans.parent_intervals(spark.createDataFrame(patients, PATIENTS), "patients")
        r = orphans.references(spark.createDataFrame(refs, REFS), Reference("conditions", "PATIENT", "patients"))
        state = orphans.advance(state, r, p, until, folder, number)
    return state


def _open(state):
    return orphans.snapshot(state).agg(F.sum("n_open")).first()[0] or 0


def test_a_deletion_that_comes_later(spark, tmp_path):
    before, after = (1, A, ts("2020-01-01"), None, "x", "y"), (1, A, ts("2020-01-01"), ts("2020-06-01"), "x", "y")
    first, second = (1, A, ts("2020-02-01"), "k", "k"), (2, A, ts("2020-07-01"), "k", "k")
    folder = str(tmp_path / "tracker")
    state = _tracked(spark, [([before], [first], ts("2020-03-01"))], folder)
    assert state.orphans.count() == 0 and _open(state) == 0
    state = _tracked(spark, [([before], [first], ts("2020-03-01")), ([after], [second], None)], folder)
    assert [r["row_id"] for r in state.orphans.collect()] == [2] and _open(state) == 2
    again = orphans.advance(state, state.orphans.drop("month"), orphans.parent_intervals(spark.createDataFrame([before], PATIENTS), "patients"), None, number=1)
    assert again is state  # a batch that is delivered again changes nothing
    kept = orphans.load_state(spark, folder)
    assert kept == state and _open(kept) == 2 and rows(orphans.snapshots(kept).select("number", "month", "n_open")) == [(0, date(2020, 2, 1), 0), (1, date(2020, 2, 1), 1), (1, date(2020, 7, 1), 1)]
    third = orphans.advance(kept, spark.createDataFrame([], "table_name string, field_name string, parent string, row_id long, key binary, loaded_at timestamp_ntz"), orphans.parent_intervals(spark.createDataFrame([(9, A.upper(), ts("2020-08-01"), None, "", "")], PATIENTS), "patients"))
    assert _open(third) == 0 and third.orphans.count() == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_deliveries_in_any_order(spark, seed):
    """Versions of parent rows and references come in any order; brute force looks at all that has come so far."""
    rng = random.Random(seed)
    ids = [f"{i:032x}" for i in range(7)]
    day_of = lambda: ts("2020-01-01") + timedelta(days=rng.randrange(100))
    deliveries, seen, judged = [], {}, set()
    all_refs, number = [], 0
    for k in range(11):  # more than are kept as parts
        patients, refs = [], []
        for _ in range(rng.randrange(4)):
            start = day_of()
            patients.append((0, rng.choice(ids), start, rng.choice([None, start + timedelta(days=rng.randrange(60))]), "", ""))
            if seen and rng.random() < 0.6:  # another version of a row that came before
                key, start = rng.choice(sorted(seen))
                patients.append((0, key, start, rng.choice([None, start + timedelta(days=rng.randrange(60))]), "", ""))
        now = {}
        for _, key, start, stop, *_ in patients:
            stop = stop or ts("9999-12-31")
            now[key, start] = max(stop, now.get((key, start), stop))
        seen.update(now)
        for _ in range(rng.randrange(9)):
            number += 1
            refs.append((number, rng.choice([*ids, "n/a"]), day_of(), "", ""))
        live = lambda key, at: any(i == key and s <= at < e for (i, s), e in seen.items())
        judged |= {r[0] for r in refs if not live(r[1], r[2])}
        all_refs += refs
        until = ts("2020-01-01") + timedelta(days=9 * (k + 1)) if k < 10 else None
        deliveries.append((patients, refs, until))
    state = _tracked(spark, deliveries)
    assert {r["row_id"] for r in state.orphans.collect()} == judged
    assert _open(state) == sum(not live(r[1], ts("9999-12-30")) for r in all_refs)


def test_stored_orphans(spark, tmp_path):
    patients = spark.createDataFrame([(1, A, ts("2020-03-01"), None, "", "")], PATIENTS)
    refs = orphans.references(spark.createDataFrame([(1, A, ts("2020-01-01"), "", ""), (2, A, ts("2020-04-01"), "", "")], REFS), Reference("conditions", "PATIENT", "patients"))
    none = orphans.parent_intervals(patients.where("false"), "patients")
    folder = str(tmp_path / "state")
    assert orphans.load_state(spark, folder) is None
    state = orphans.advance(None, refs.where("row_id = 1"), none, ts("2020-02-01"), folder)
    assert orphans.snapshot(state).first()["n_open"] == 1
    assert orphans.load_state(spark, folder).until == ts("2020-02-01")
    state = orphans.advance(orphans.load_state(spark, folder), refs.where("row_id = 2"), orphans.parent_intervals(patients, "patients"))
    assert [r["row_id"] for r in state.orphans.collect()] == [1] and _open(state) == 0
