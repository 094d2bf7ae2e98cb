"""Components of chains, hubs and random graphs, with and without broadcasting."""

import random

import pytest

from millrace.llm import common, components


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("bound", [common.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("shape", ["chain", "hub", "random", "none"])
def test_components(spark, monkeypatch, shape, bound):
    monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
    rng = random.Random(shape)
    edges = {"chain": [(i, i + 1) for i in range(60)], "hub": [(-5, i) for i in range(200)] + [(7, 7)], "random": [(rng.randrange(90), rng.randrange(90)) for _ in range(60)], "none": []}[shape]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    assert got == {x: r for x, r in brute(edges).items() if any(a != b and x in (a, b) for a, b in edges)}
