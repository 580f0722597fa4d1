"""Connected components against union-find."""

import random

from postloom.plans.components import connected_components


def _brute(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in up}


def test_random_graphs(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(2040 - i, 2041 - i) for i in range(40)] + [(5000, 5000 + i) for i in range(60)] + [edges[0]] * 3
    edges = [(a, b) for a, b in edges if a != b]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == _brute(edges)


def test_empty_and_null(spark):
    df = spark.createDataFrame([(None, 1), (2, None), (3, 3)], "a long, b long")
    assert connected_components(df).count() == 0
