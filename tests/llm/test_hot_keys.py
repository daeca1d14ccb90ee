"""One key holds a third of all rows in the training-data operators."""

import random

from pyspark.sql import functions as F

from medlattice.llm import mixing, quantiles, splits
from tests.conftest import rows
from tests.llm.test_llm_problems import LINKS, TASKS, link, uid
from tests.test_core_problems import NPX, PANEL, PANELS, reading


def test_one_person_with_many_links(spark):
    tasks = spark.createDataFrame([(i, uid(i % 200) if i % 3 else uid(0), "t", "c", "s") for i in range(3000)], TASKS)
    links = spark.createDataFrame([link(i, uid(0), uid(1 + i % 60)) for i in range(600)], LINKS)
    member = splits.memberships(tasks, links)
    assert splits.same_entity(member).where(F.col("patient_id_a") == uid(0)).count() == 60
    out = splits.split_rows(tasks, links)
    assert out.count() == 3000 and out.where(F.col("patient_id").isin([uid(i) for i in range(61)])).select("assigned_split").distinct().count() == 1


def test_one_protein(spark):
    random.seed(9)
    data = [reading(i, f"S{i}", "X1A" if i % 3 == 0 else "X2B", random.gauss(5, 1), assay=0 if i % 3 == 0 else 1) for i in range(3000)]
    got = quantiles.npx_percentiles(quantiles.npx_days(spark.createDataFrame(data, NPX), spark.createDataFrame(PANELS, PANEL))).where("scope = 'protein'")
    assert rows(got.select("protein_id", "n_values")) == [("X1A", 1000), ("X2B", 2000)]


def test_one_source(spark):
    docs = spark.createDataFrame([(i, "some words of a text " * (1 + i % 5), "big" if i % 3 else "small") for i in range(6000)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.2, 1), ("small", 0.8, 2)], "source string, target_share double, max_repeats int")
    made, report = mixing.mix(docs, targets)
    share = {r["source"]: r["share"] for r in report.collect()}
    assert abs(share["big"] - 0.2) < 0.01 and made.where("source = 'small'").groupBy("doc_id").count().where("count <> 2").count() == 0
    again, _ = mixing.mix(docs.repartition(11), targets)
    assert rows(made) == rows(again)
