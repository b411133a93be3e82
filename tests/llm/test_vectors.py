"""Neighbour search and the vector join against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cognatus.llm import ann, embdedup
from cognatus.llm.vectors import dots, norms

SCHEMA = "vec_id long, embedding array<float>, label int"
ODD = [
    (900, None, 1),
    (901, [], 1),
    (902, [0.0] * 8, 1),
    (903, [1.0, None] + [0.0] * 6, 1),
    (904, [math.nan] + [1.0] * 7, 1),
    (905, [math.inf] + [1.0] * 7, None),
    (None, [1.0] * 8, 1),
]


def vectors(seed=3, n=300, dim=8):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    for group in range(5):
        at = 40 + 20 * group
        x[at : at + 12] = x[at] + rng.normal(0, 0.05 * (group + 1), (12, dim))
    x[200:215] = x[199]
    x[230] = 3 * x[199]
    return x


def rows_of(x):
    return [(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)]


def cosines(x):
    x = x.astype(np.float64)
    n = np.sqrt((x * x).sum(1))
    return (x @ x.T) / np.outer(n, n)


def test_search(spark):
    x = vectors()
    df = spark.createDataFrame(rows_of(x) + ODD, SCHEMA)
    got = {}
    for r in ann.nearest(df, F.col("id") % 50 == 0, query_block=2, vector_block=70).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["neighbour_id"], r["score"]))
    c = cosines(x)
    assert sorted(got) == [0, 50, 100, 150, 200, 250]
    for q, found in got.items():
        found.sort()
        assert [k for k, _, _ in found] == [1, 2, 3, 4, 5]
        best = [i for i in np.lexsort((np.arange(len(x)), -np.round(c[q], 12))) if i != q][:5]
        assert [i for _, i, _ in found] == best
        assert [s for _, _, s in found] == pytest.approx([c[q][i] for i in best], abs=1e-12)


def test_search_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.0, 0.0], 1), (0, [1.0, 0.0], 1)], SCHEMA)
    assert [tuple(r) for r in ann.nearest(df, F.col("id") % 50 == 0).collect()] == [(0, 1, 1, 0.0)]
    assert ann.nearest(spark.createDataFrame([], SCHEMA), F.col("id") % 50 == 0).count() == 0
    assert ann.nearest(df, F.col("id") == 77).count() == 0


def test_long_vectors_and_other_columns(spark, monkeypatch):
    x = vectors(7, 260, 300)
    df = spark.createDataFrame(rows_of(x), SCHEMA)
    for name in ("id", "vec", "dim", "code", "a", "rank", "score", "n", "kept", "component"):
        df = df.withColumn(name, F.lit("clash"))
    c = cosines(x)
    np.fill_diagonal(c, -2)
    monkeypatch.setattr(ann, "BLOCK_BYTES", 8 * 300 * 16)
    monkeypatch.setattr(embdedup, "TILE_BYTES", 16 * 300 * 16)
    got = {r["query_id"]: r["neighbour_id"] for r in ann.nearest(df, F.col("id") % 50 == 0).where("rank = 1").collect()}
    exact = x.astype(np.float64)  # ties of multiples are decided by the last bits, so add up as the operator does
    n = norms(exact)
    scores = {q: dots(exact, exact[q : q + 1]) / (n * n[q]) for q in range(0, 260, 50)}
    assert got == {q: int(np.argmax(np.where(np.arange(260) == q, -2, s))) for q, s in scores.items()}
    assert sum(r["n_links"] for r in embdedup.embedding_groups(df).collect()) == (c >= 0.9).sum()


def test_error_bound_holds():
    x = vectors(5, 2000, 64)
    bits, a = ann.encode(x.astype(float), 64)
    signs = np.unpackbits(bits, axis=1)[:, :64] * 2.0 - 1
    q = x[:50] / np.sqrt((x[:50] ** 2).sum(1, keepdims=True))
    estimate = (q @ ann.rotation(64).T) @ signs.T / (a * 8)
    bound = ann.BOUND * np.sqrt(1 - a * a) / (a * np.sqrt(63))
    assert (np.abs(estimate - cosines(x)[:50]) <= bound).mean() > 0.98


def groups(spark, rows, **kind):
    return {r["id"]: (r["n_links"], r["component"], r["kept"]) for r in embdedup.embedding_groups(spark.createDataFrame(rows, SCHEMA), **kind).collect()}


@pytest.mark.parametrize(("tile", "blocks"), [(32768, 4), (25, 4), (40, 2)])
def test_join(spark, tile, blocks):
    x = vectors()
    got = groups(spark, rows_of(x) + ODD, tile=tile, blocks=blocks)
    near = cosines(x) >= 0.9 - 1e-12
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.minimum(label, np.where(near, label[None, :], len(x)).min(1))
    for i in range(len(x)):
        assert got[i] == (int(near[i].sum()), int(label[i]), bool(label[i] == i)), i
    for i in range(900, 906):
        assert got[i] == (0, i, True)
    assert got[None] == (0, None, True)
    assert near.sum() > 300


def test_planted_links_at_64_dimensions(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1500, 64)).astype(np.float32)
    for k in range(100):
        x[2 * k + 1] = x[2 * k] + rng.normal(0, 0.3 if k % 2 else 0.6, 64)
    near = cosines(x) >= 0.9
    np.fill_diagonal(near, False)
    assert 80 <= near.sum() <= 150
    for kind in ({}, {"tile": 400}):
        got = groups(spark, rows_of(x), **kind)
        assert [got[i][0] for i in range(len(x))] == near.sum(axis=1).tolist()


def compared(x, threshold=0.9):
    """Pairs compared over all pairs, of all blocks together; bands aside."""
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    split = embdedup.split_of(unit[:1000], x.shape[1], 4, threshold)
    total = 0
    for block, share in enumerate(split.shares):
        own = (unit @ split.turn)[:, split.edges[block] : split.edges[block + 1]]
        total += sum(len(p) * len(q) for p, q in embdedup.leaf_pairs(own, None, share))
    return total / (len(x) * (len(x) - 1) / 2), len(split.shares)


def test_spread_vectors_are_pruned():
    rng = np.random.default_rng(4)
    low = rng.standard_normal((40_000, 4)) @ rng.standard_normal((4, 64)) + rng.normal(0, 0.01, (40_000, 64))
    share, blocks = compared(low)
    assert blocks == 1 and share < 0.1
    share, blocks = compared(rng.standard_normal((4000, 64)))
    assert blocks == 4 and share < 4.6  # no range join prunes these: each block meets nearly all


def test_join_empty_and_repeats(spark):
    assert groups(spark, []) == {}
    assert groups(spark, [(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [1.0, 0.0, 0.0], 1)]) == {5: (1, 3, False), 3: (1, 3, True), 4: (0, 4, True)}


def test_hot_group_of_copies(spark):
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(400)]
    got = groups(spark, rows)
    assert all(v == (399, 0, i == 0) for i, v in got.items())
