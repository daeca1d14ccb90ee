"""Counts of causal chains: equal to the chains themselves, also where these are too many to make."""

import random

import pytest
from pyspark.sql import functions as F

from medlattice.operators import causal

EDGE = "doc_id string, key string, sources array<string>, target string"


def counted(spark, edges, start, depth, exact):
    made = causal.chain_counts(edges, start, depth, exact).collect()
    return {(r["doc_id"], r["length"]): r["n"] for r in made}


@pytest.mark.parametrize("exact", [False, True])
def test_counts_are_those_of_the_chains(spark, exact):
    random.seed(3)
    names, edges = ["a", "A", "ab", "b", "c"], []  # one name holds another, and an edge may follow itself
    for doc in range(4):
        for i in range(3 + 4 * doc):
            sources = [random.choice(names) for _ in range(random.choice((1, 1, 2)))]
            edges.append((f"d{doc}", str(i), sources, random.choice(names) + random.choice(("", " (week 2)"))))
    df = spark.createDataFrame([*edges, ("e", "0", ["x"], "a"), ("f", "0", ["a"], "a"), ("f", "1", ["a"], "a")], EDGE)
    chains = causal.chains(df, "a", 5, exact).groupBy("doc_id", "length").agg(F.count("*").alias("n")).collect()
    want = {(r["doc_id"], r["length"]): r["n"] for r in chains}
    assert max(n for _, n in want) == 5 and ("f", 2) in want and ("f", 3) not in want
    for depth in (1, 2, 3, 4, 5):
        assert counted(spark, df, "a", depth, exact) == {k: n for k, n in want.items() if k[1] <= depth}


def test_chains_too_many_to_make(spark):
    wide = 40  # six layers, each joined wholly to the next: 40 to the power of 6 chains of five edges
    names = [[f"{'uvwxyz'[layer]}{i:02d}" for i in range(wide)] for layer in range(6)]
    edges = [("d", f"{a}{b}", [a], b) for layer in range(5) for a in names[layer] for b in names[layer + 1]]
    assert counted(spark, spark.createDataFrame(edges, EDGE), "u", 5, False) == {("d", k): wide ** (k + 1) for k in range(1, 6)}
