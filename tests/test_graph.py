"""Components against a small union-find."""

import random

import pytest

from cognatus.operators.graph import connected_components


def union_find(vertices, edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in vertices}


def solve(spark, vertices, edges, kind="long"):
    v = spark.createDataFrame([(x,) for x in vertices], f"id {kind}")
    e = spark.createDataFrame(edges, f"src {kind}, dst {kind}")
    return {r["id"]: r["component"] for r in connected_components(v, e).collect()}


def test_basic(spark):
    assert solve(spark, ["a", "b"], [], "string") == {"a": "a", "b": "b"}
    assert solve(spark, ["a", "b"], [("a", "b")], "string") == {"a": "a", "b": "a"}
    assert solve(spark, ["a", "b", "c"], [("c", "b"), ("b", "a"), ("a", "a"), (None, "a")], "string") == {"a": "a", "b": "a", "c": "a"}


def test_path_and_hub(spark):
    edges = [(i, i + 1) for i in range(64)] + [(1000, i) for i in range(1001, 1300)]
    vertices = [*range(65), *range(1000, 1300), 5000]
    assert solve(spark, vertices, edges) == union_find(vertices, edges)


@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, seed):
    rng = random.Random(seed)
    vertices = list(range(200))
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    assert solve(spark, vertices, edges) == union_find(vertices, edges)
    rng.shuffle(edges)
    assert solve(spark, vertices, edges) == union_find(vertices, edges)
