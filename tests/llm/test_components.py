import random

from riskweave.llm.components import components


def test_equals_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, 5000 + k) for k in range(300)]
    edges += [(7, 7), (None, 3), (-5, -9)]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
