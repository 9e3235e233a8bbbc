import random

import pytest

from ticketloom.llm.graph import connected_components


def brute(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {(x, root(x)) for x in parent}


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(1, 2), (2, 1), (1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)],
    [(None, 3), (3, 4)], [(9, -5), (-5, 2), (7, 6)],
])
def test_shapes(spark, edges):
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {tuple(r) for r in found.collect()} == brute(edges)


def test_random(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {tuple(r) for r in found.collect()} == brute(edges)
