import random

from echoframe.operators.components import connected_components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is None or b is None:
            continue
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_random_chain_and_nulls(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)]
    edges += [(i, i + 1) for i in range(200, 260)] + [(7, None), (None, 9), (500, 500)] + [(1, 2)] * 5
    df = spark.createDataFrame(edges, "x long, y long").repartition(3)
    got = {r.node: r.component for r in connected_components(df, "x", "y").collect()}
    assert got == brute(edges)


def test_empty(spark):
    df = spark.createDataFrame([], "x long, y long")
    assert connected_components(df, "x", "y").count() == 0
