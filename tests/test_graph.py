import random

import pytest

from twinsift.operators.graph import connected_components


def expected(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def found(spark, edges):
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    rows = connected_components(df).collect()
    assert len(rows) == len({r["node"] for r in rows})
    return {r["node"]: r["component"] for r in rows}


def test_shapes(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(500, 501 + i) for i in range(20)]
    cycle = [(900, 901), (901, 902), (902, 900)]
    late = [(1000, 1003), (1001, 1002), (1003, 1001)]
    odd = [(7, 7), (None, 3), (3, None), (1000, 1003)]
    edges = path + star + cycle + late + odd
    assert found(spark, edges) == expected(edges)


def test_random_graphs(spark):
    rng = random.Random(4)
    for n, m in ((30, 20), (200, 180)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        assert found(spark, edges) == expected(edges)


def test_empty(spark):
    assert found(spark, []) == {}


def test_too_few_rounds_raise(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(100, 140)], "src bigint, dst bigint")
    with pytest.raises(RuntimeError):
        connected_components(df, max_rounds=1)
