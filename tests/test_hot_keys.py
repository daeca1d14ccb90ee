"""One key holds a third of all rows: results stay whole and equal to brute force."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from medlattice.operators import events, features, orphans, pivot, splits
from medlattice.operators.orphans import Reference

from .conftest import rows, ts
from .test_core_problems import CONDITIONS, NPX, PANEL, PANELS, PATIENTS, REFS, reading

HOT = "0" * 31 + "1"


def key(i):
    return HOT if i % 3 == 0 else f"{1000 + i % 97:032x}"


def test_orphans(spark):
    random.seed(8)
    when = lambda: ts("2020-01-01") + timedelta(minutes=random.randrange(300_000))
    patients = []
    for i in range(900):
        a = when()
        patients.append((i, key(i), a, a + timedelta(minutes=random.randrange(2000)), None, None))
    refs = [(i, key(i + 1) if i % 2 else HOT, when(), None, None) for i in range(3000)]
    by = {}
    for p in patients:
        by.setdefault(p[1], []).append((p[2], p[3]))
    want = {r[0] for r in refs if not any(a <= r[2] < b for a, b in by.get(r[1], []))}
    index = orphans.parent_intervals(spark.createDataFrame(patients, PATIENTS), "patients")
    assert orphans.compact(index).where(F.hex("key") == HOT).count() < 300
    found = orphans.references(spark.createDataFrame(refs, REFS), Reference("conditions", "PATIENT", "patients"))
    assert {r["row_id"] for r in orphans.replay(found, index, 3).orphans.collect()} == want


def test_features(spark):
    data = [(i, key(i), f"e{i}", date(2020, 1, 1) + timedelta(days=i % 300), None, str(i % 4), ts("2024-01-01"), 0, "") for i in range(6000)]
    made = features.feature_table(spark.createDataFrame(data, CONDITIONS), date(2021, 1, 1))
    total = made.agg(*[F.sum(f"n_{c}") for c in "0123"]).first()
    assert sum(total) == 6000 and made.where(F.col("PATIENT") == HOT).select(sum(F.col(f"n_{c}") for c in "0123")).first()[0] == 2000


def test_pivot(spark):
    data = [reading(i, "S0" if i % 3 == 0 else f"S{i % 50}", "X1A" if i % 2 else "X2B", float(i % 7), assay=(i + 1) % 2) for i in range(3000)]
    npx, panels = spark.createDataFrame(data, NPX), spark.createDataFrame(PANELS, PANEL)
    cells = pivot.agreed_cells(npx, panels)
    assert cells.agg(F.sum("n_readings")).first()[0] == 3000
    assert pivot.wide_npx(npx, panels).count() == len({d[0] for d in data})
    assert pivot.conflicting_cells(npx, panels).count() == cells.where("spread is not null").count()


def test_ranks(spark):
    df = spark.createDataFrame([("hot" if i % 3 == 0 else f"g{i % 5}", f"k{i}") for i in range(5000)], "g string, k string")
    made = splits.ranked(df, ["g"], F.sha2("k", 256), "k")
    sizes = made.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.max("rank").alias("m"))
    assert sizes.where("n <> d or n <> m").count() == 0
    order = [r["k"] for r in made.where("g = 'hot'").orderBy("rank").collect()]
    assert order == [r["k"] for r in df.where("g = 'hot'").orderBy(F.sha2("k", 256)).collect()]


def test_bundles_do_not_depend_on_partitioning(spark):
    enc = spark.createDataFrame([(f"e{i}", key(i), date(2020, 1, 1) + timedelta(days=i % 40), f"visit {i % 9}", None, None) for i in range(1500)], "Id string, PATIENT string, START date, DESCRIPTION string, REASONCODE string, REASONDESCRIPTION string")
    one = rows(events.bundle({"encounters": enc.coalesce(1)}))
    assert one == rows(events.bundle({"encounters": enc.repartition(13)}))
