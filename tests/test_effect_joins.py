"""Joins of genotypes with effects: nothing that has rows for every person is broadcast, whatever the planner takes it for."""

import pytest

from medlattice.plans import genes


def built(node):
    """The sides of a plan that are broadcast, as text."""
    if node.getClass().getSimpleName() == "BroadcastHashJoinExec":
        yield (node.left() if node.buildSide().toString() == "BuildLeft" else node.right()).toString()
    for i in range(node.children().size()):
        yield from built(node.children().apply(i))


@pytest.mark.parametrize("name", ["sm06_dominance", "sm08_context", "sm10_phenotypes", "sm05_additive", "sm07_interaction", "sm09_compound_het"])
def test_only_effects_are_broadcast(spark, root, name):
    sides = list(built(genes.QUERIES[name](spark, root)._jdf.queryExecution().sparkPlan()))
    assert sides and not any("customer" in side for side in sides)
