"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with a cosine of at least t have a squared distance of at most ``2 - 2t``. They
are rotated and split into blocks of few dimensions, each with a share of that budget in proportion
to its variance. In some block the squared distance is within the share, so a range join per block
finds every pair. Candidates are verified exactly on the original vectors; a pair is counted in the first
block whose share it keeps only.

The rotation is fitted to a bounded sample: principal directions, dealt to the blocks in turn, so that
each block leads with directions of much variance. There are as many blocks as the sample's
effective dimension has sixteens, ``blocks`` at most; any rotation and any split find the same pairs.

The range join of a block cuts its first coordinate into bands as wide as the block's radius: near
pairs lie in one band or in two neighbours. Within a task a k-d tree over all coordinates of the block
cuts the vectors into leaves; only leaves whose boxes are within the radius meet.

Scale: equal vectors are merged first, so a group of exact copies is one row with a count. A
band of more than a tile is salted into tiles of bounded bytes, and a task holds two tiles at a time.
Tasks return one row per vector that has a link (how many, and its local component's root),
never pairs. Rotated vectors are computed once and travel as floats beside the originals, so every
task sees the same sums. The driver sees the sample and the bands' sizes, of which there are at most
``2 / radius`` per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cognatus.llm.simhash import _Stars
from cognatus.llm.vectors import dots, matrix, norms, rotation, usable_vectors
from cognatus.operators.graph import star_forest
from cognatus.session import materialize

#: Vectors to a tile, and what a tile's vectors may hold in bytes.
TILE, TILE_BYTES = 32768, 64 << 20
#: The rotation is fitted to about so many vectors of a length, fewer if they hold more bytes than this.
SAMPLE, SAMPLE_BYTES = 4096, 16 << 20
#: Dimensions to a block, about, of the effective ones.
BLOCK_DIMS = 16
#: Rows of a leaf: coarse ones where boxes rule out next to nothing, fine ones otherwise.
COARSE, FINE, WORTH = 256, 32, 0.7
SLACK = 1e-6


@dataclass
class Split:
    """A rotation of vectors of one length, the borders of its blocks, and the blocks' shares of the budget."""

    turn: np.ndarray
    edges: list[int]
    shares: list[float]

    def width(self, block: int) -> float:
        return float(np.sqrt(self.shares[block]) + SLACK)


def split_of(unit: np.ndarray, dim: int, blocks: int, threshold: float) -> Split:
    """The split for vectors like the rows of ``unit``; without rows to learn from a random rotation, evenly split."""
    turn, variance = rotation(dim).T, np.ones(dim)
    if len(unit) > 1:
        values, vectors = np.linalg.eigh(np.cov(unit.T).reshape(dim, dim))
        turn, variance = vectors[:, ::-1], np.maximum(values[::-1], 0)
    whole = variance.sum()
    if whole <= 0:
        variance, whole = np.ones(dim), dim
    effective = whole**2 / (variance**2).sum()
    blocks = int(np.clip(round(effective / BLOCK_DIMS), 1, min(blocks, dim)))
    # to and fro, so that the blocks' variances are alike
    dealt: list[list[int]] = [[] for _ in range(blocks)]
    for i in range(dim):
        at = i % (2 * blocks)
        dealt[min(at, 2 * blocks - 1 - at)].append(i)
    edges = np.cumsum([0, *map(len, dealt)]).tolist()
    shares = [(2 - 2 * threshold) * float(variance[own].sum() / whole) + SLACK for own in dealt]
    return Split(np.ascontiguousarray(turn[:, np.concatenate(dealt)]), edges, shares)


def fit_splits(classes: DataFrame, blocks: int, threshold: float, sample: int = SAMPLE) -> dict[int, Split]:
    """A split for each length of vectors, fitted to those of a sample that a hash of the id picks."""
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = F.lit(False)
    for dim, n in sizes.items():
        most = max(2, min(sample, SAMPLE_BYTES // (8 * dim)))
        wanted = wanted | ((F.col("dim") == dim) & (F.pmod(F.xxhash64("id"), F.lit(max(1, n // most))) == 0))
    found = classes.where(wanted).orderBy("id").select("dim", "vec").toArrow() if sizes else None
    out = {}
    for dim in sizes:
        x = matrix(found.filter(pc.equal(found.column("dim"), dim)).column("vec"), dim)
        out[dim] = split_of(x / norms(x)[:, None], dim, blocks, threshold)
    return out


def leaves(x: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Rows cut at medians of the widest coordinate into sets of at most ``leaf``."""
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        own = x[rows]
        widest = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        half = len(rows) // 2
        order = np.argpartition(own[:, widest], half)
        todo += [rows[order[:half]], rows[order[half:]]]
    return out


def leaf_pairs(x: np.ndarray, y: np.ndarray | None, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sets of rows of ``x`` and of ``y`` (of x itself if None) that hold all pairs within the squared distance ``limit``."""
    for leaf in (COARSE, FINE):
        left = leaves(x, leaf)
        right = left if y is None else leaves(y, leaf)
        near = [_near_leaves(x[rows], *bounds, limit) for bounds in [_bounds(x if y is None else y, right)] for rows in left]
        if sum(map(len, near)) > WORTH * len(left) * len(right):
            break
    step = max(1, 2048 // leaf)
    for k, (rows, some) in enumerate(zip(left, near, strict=True)):
        some = some[some >= k] if right is left else some
        for at in range(0, len(some), step):
            yield rows, np.concatenate([right[i] for i in some[at : at + step]])


def _bounds(y: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Boxes and balls of sets of rows: least and greatest coordinates, centres and radii."""
    low, high, middle = (np.stack([f(y[r], axis=0) for r in sets]) for f in (np.min, np.max, np.mean))
    return low, high, middle, np.array([np.sqrt(((y[r] - c) ** 2).sum(axis=1).max()) for r, c in zip(sets, middle, strict=True)])


def _near_leaves(own: np.ndarray, low: np.ndarray, high: np.ndarray, middle: np.ndarray, reach: np.ndarray, limit: float) -> np.ndarray:
    """Which boxes and balls lie within the squared distance of those of the rows ``own``."""
    gap = np.maximum(np.maximum(low - own.max(axis=0), own.min(axis=0) - high), 0)
    centre = own.mean(axis=0)
    far = np.sqrt(((middle - centre) ** 2).sum(axis=1)) - reach - np.sqrt(((own - centre) ** 2).sum(axis=1).max())
    return np.flatnonzero(((gap * gap).sum(axis=1) <= limit) & (far <= np.sqrt(limit) + SLACK))


def _verify(ux: np.ndarray, uy: np.ndarray, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, a: np.ndarray, b: np.ndarray, split: Split, block: int, threshold: float) -> np.ndarray:
    """Which candidate pairs belong to this block and reach the threshold on the original vectors."""
    keep = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 11):  # a chunk's rows stay in cache
        i, j = a[at : at + (1 << 11)], b[at : at + (1 << 11)]
        square = (ux[i] - uy[j]) ** 2
        sums = np.stack([square[:, p:q].sum(axis=1) for p, q in zip(split.edges, split.edges[1:], strict=False)], axis=1)
        first = np.argmax(sums <= np.array(split.shares), axis=1)
        mine = np.flatnonzero((first == block) & (sums[:, block] <= split.shares[block]))
        i, j = i[mine], j[mine]
        keep[at + mine] = dots(x[i], y[j]) / (nx[i] * ny[j]) >= threshold
    return keep


def _join_tiles(left: pa.Table, right: pa.Table | None, dim: int, block: int, split: Split, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(id, links, root)`` of the vectors linked between two tiles, or within one (right None)."""
    tables = [left] if right is None else [left, right]
    vecs = [matrix(t.column("vec"), dim) for t in tables]
    lens = [norms(v) for v in vecs]
    units = [matrix(t.column("turned"), dim) for t in tables]
    ids = np.concatenate([t.column("id").to_numpy() for t in tables])
    count = np.concatenate([t.column("n").to_numpy() for t in tables])
    lo, hi = split.edges[block], split.edges[block + 1]
    x, y = units[0], units[-1]
    bx, by = x[:, lo:hi].astype(np.float32), y[:, lo:hi].astype(np.float32)
    # one product gives squared distances: |x|^2 * 1 + 1 * |y|^2 - 2 x.y
    one = lambda v: np.ones((len(v), 1), np.float32)
    sq = lambda v: (v * v).sum(axis=1, keepdims=True)
    sx, sy = np.hstack([bx, sq(bx), one(bx)]), np.hstack([-2 * by, one(by), sq(by)])
    limit = np.float32(split.shares[block] + 1e-4)
    shift = 0 if right is None else len(x)
    links = np.zeros(len(ids), np.int64)
    stars = _Stars(len(ids))
    for p, q in leaf_pairs(bx, None if right is None else by, float(limit)):
        i, j = np.nonzero(sx[p] @ sy[q].T <= limit)
        i, j = p[i], q[j]
        if right is None:
            # within a leaf both orders turn up, between leaves one does
            i, j = np.minimum(i, j), np.maximum(i, j)
            own = np.unique(np.stack([i, j], axis=1)[i < j], axis=0) if len(i) else np.zeros((0, 2), np.int64)
            i, j = own[:, 0], own[:, 1]
        if not len(i):
            continue
        ok = _verify(x, y, vecs[0], vecs[-1], lens[0], lens[-1], i, j, split, block, threshold)
        i, j = i[ok], j[ok] + shift
        np.add.at(links, i, count[j])
        np.add.at(links, j, count[i])
        stars.link(i, j)
    on = np.flatnonzero(links > 0)
    return ids[on], links[on], ids[stars.label[on]]


def vector_links(classes: DataFrame, threshold: float, blocks: int, tile: int) -> DataFrame:
    """``(id, links, root)`` from distinct vectors ``(id, vec, dim, n)``; n is how many a vector stands for."""
    splits = fit_splits(classes, blocks, threshold)
    shared = classes.sparkSession.sparkContext.broadcast(splits)

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            bands: list = [None] * batch.num_rows
            turned: list = [None] * batch.num_rows
            for dim in np.unique(dims):
                at, split = np.flatnonzero(dims == dim), shared.value[int(dim)]
                x = matrix(batch.column("vec").take(pa.array(at)), int(dim))
                own = ((x / norms(x)[:, None]) @ split.turn).astype(np.float32)
                widths = np.array([split.width(b) for b in range(len(split.shares))])
                cut = np.floor(own[:, split.edges[:-1]] / widths).astype(np.int32)
                for r, row, band in zip(at, own, cut, strict=True):
                    turned[r], bands[r] = row, band
            arrays = [pa.array(turned, pa.list_(pa.float32())), pa.array(bands, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, "turned", "bands"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    rows = materialize(classes.mapInArrow(banded, f"{fields}, turned array<float>, bands array<int>"), "bands")
    sizes = rows.select("dim", F.posexplode("bands").alias("block", "band")).groupBy("dim", "block", "band").count()
    most = lambda dim: max(1, min(tile, TILE_BYTES // (16 * dim)))
    tiles = {(r["dim"], r["block"], r["band"]): -(-r["count"] // most(r["dim"])) for r in sizes.collect()}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each pair of tiles that a vector is in: within its band, and with either neighbour."""
        for batch in batches:
            at, keys, sides = [], [], []
            ids = batch.column("id").to_numpy()
            salts = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for r, (dim, bands) in enumerate(zip(batch.column("dim").to_pylist(), batch.column("bands").to_pylist(), strict=True)):
                for block, band in enumerate(bands):
                    mine = tiles[dim, block, band]
                    s = int(salts[r] % np.uint64(mine))
                    for j in range(mine):
                        at.append(r)
                        keys.append((dim, block, band, min(s, j), band, max(s, j)))
                        sides.append(int(s > j))
                    for j in range(tiles.get((dim, block, band + 1), 0)):
                        at.append(r)
                        keys.append((dim, block, band, s, band + 1, j))
                        sides.append(0)
                    for i in range(tiles.get((dim, block, band - 1), 0)):
                        at.append(r)
                        keys.append((dim, block, band - 1, i, band, s))
                        sides.append(1)
                if at and (len(at) >= 1 << 16 or r == batch.num_rows - 1):
                    take = batch.select(["id", "vec", "turned", "n"]).take(pa.array(at, pa.int64()))
                    cols = [pa.array(c, pa.int32()) for c in zip(*keys, strict=True)]
                    yield pa.RecordBatch.from_arrays([*take.columns, *cols, pa.array(sides, pa.int32())], names=["id", "vec", "turned", "n", *KEY, "side"])
                    at, keys, sides = [], [], []

    def join(key: tuple, table: pa.Table) -> pa.Table:
        dim, block, band, i, other, j = (k.as_py() for k in key)
        side = table.column("side").to_numpy()
        if (band, i) == (other, j):
            left, right = table, None
        else:
            left, right = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        if not left.num_rows or (right is not None and not right.num_rows):
            return OUT.empty_table()
        return pa.table(list(_join_tiles(left, right, dim, block, shared.value[dim], threshold)), schema=OUT)

    KEY = ["dim", "block", "band", "i", "other", "j"]
    OUT = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    kind = classes.schema["vec"].dataType.simpleString()
    spread_schema = f"id long, vec {kind}, turned array<float>, n long, " + ", ".join(f"{k} int" for k in KEY) + ", side int"
    return rows.mapInArrow(spread, spread_schema).groupBy(*KEY).applyInArrow(join, "id long, links long, root long")


def embedding_groups(
    vectors: DataFrame, *, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", blocks: int = 4, tile: int = TILE
) -> DataFrame:
    """``(id, n_links, component, kept)``, one row per id, null ids included as one row each.

    ``n_links`` counts the other vectors whose cosine reaches ``threshold``; ``component`` is the
    least id reachable. Vectors that are null, empty, zero, or hold a null or non-finite
    component link with nothing, and neither do vectors of different lengths. Rows that repeat
    an id are one vector, the least usable one. Long vectors make smaller tiles. Other columns are not
    looked at, whatever their names; an empty table gives no rows.
    """
    usable = materialize(usable_vectors(vectors, id_col, vec_col).withColumn("id", F.col("id").cast("long")), "vectors")
    classes = materialize(usable.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("dim").alias("dim")), "classes")
    found = materialize(vector_links(classes.select("id", "vec", "dim", "n"), threshold, blocks, tile), "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    forest = star_forest(found.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    named = (
        classes.join(counts, "id", "left")
        .join(forest.select(F.col("v").alias("id"), F.col("u").alias("root")), "id", "left")
        .select("vec", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component"))
    )
    members = usable.join(named, "vec").select("id", "n_links", "component")
    every = vectors.select(F.col(id_col).cast("long").alias("id"))
    every = every.where("id is not null").distinct().unionByName(every.where("id is null"))
    return every.join(members, "id", "left").select(
        "id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component", "id").alias("component"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )
