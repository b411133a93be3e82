"""Connected components over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cognatus.session import discard, materialize


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges`` as a table, and a fingerprint taken while they are written."""
    seen = Observation()
    table = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "edges")
    return table, (seen.get["n"], seen.get["x"])


def star_forest(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Reduce an edge list to ``(v, u)`` rows that hang each vertex on its component's least vertex.

    Alternates the large-star and small-star steps until the edge set stands still, so
    a path of n vertices needs O(log n) rounds in practice. Each step is an aggregate with
    map-side combine and an equi-join that AQE can split at a hub; each round is written to
    the shared folder and the one before deleted. Self-loops, repeated and null edges count for nothing. The root
    itself has no row.
    """
    now = (
        edges.select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    now, before = _written(now)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        # large star: every larger neighbour of a vertex moves to the least neighbour
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        )
        # small star: a vertex and its smaller neighbours move to the least of them
        parent = large.groupBy("v").agg(F.min("u").alias("m"))
        moved = large.join(parent, "v").where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
        last = now
        now, after = _written(moved.union(parent.select(F.col("m").alias("u"), "v")).distinct())
        discard(last)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
    return now.select("v", "u")


def connected_components(
    vertices: DataFrame, edges: DataFrame, key: str = "id", src: str = "src", dst: str = "dst", label: str = "component"
) -> DataFrame:
    """``vertices`` with ``label``: the least key reachable over ``edges``, the row's own included.

    Endpoints missing from ``vertices`` still connect; they get no row of their own.
    A null key keeps a null label.
    """
    roots = star_forest(edges, src, dst).select(F.col("v").alias("__v"), F.col("u").alias("__root"))
    return (
        vertices.join(roots, vertices[key] == roots["__v"], "left")
        .withColumn(label, F.coalesce("__root", key))
        .drop("__v", "__root")
    )
