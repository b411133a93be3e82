"""Nearest neighbours by randomly rotated one-bit codes.

A unit vector is rotated at random and each coordinate kept as its sign, packed into bytes.
With the scalar ``a = <code, vector>`` the inner product with a query is estimated without
bias as ``<code, query> / a``, within ``bound * sqrt(1 - a^2) / (a * sqrt(dim - 1))`` with high
probability. In each block the best estimates are reranked exactly first; then every vector
whose upper bound reaches the k-th exact score so far.

Scale: codes are built once, in a scan. Queries and vectors meet in pairs of hash blocks of
bounded rows and bytes, each pair a task of its own; a pair returns at most k rows per query, and a
partial top-k precedes the last shuffle. Neither side is broadcast or collected.

A vector travels with its code, once for each block of queries. Sending codes alone and fetching
the vectors of all candidates afterwards moves more: a pair that the bound lets through costs a vector of
its own then, and one vector to a block of 16384 queries is less than that as soon as the bound lets through one
pair in 16384. Estimates are a product of signs and rotated queries in single precision, which a
matrix library does faster than numpy counts bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cognatus.llm.vectors import dots, matrix, norms, rotation, usable_vectors
from cognatus.session import materialize

#: How many standard errors the error bound spans.
BOUND = 2.5
#: Rows of a block, and bytes that its vectors may hold in double precision.
QUERY_BLOCK, VECTOR_BLOCK, BLOCK_BYTES = 16384, 32768, 64 << 20


def encode(x: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """``(packed bits, a)`` for the rows of ``x``."""
    turned = (x / norms(x)[:, None]) @ rotation(dim).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(dim)


def build_index(vectors: DataFrame) -> DataFrame:
    """``vectors`` (id, vec, dim) with ``code`` and its correction scalar ``a``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            codes: list = [None] * batch.num_rows
            a = np.zeros(batch.num_rows)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                bits, a[at] = encode(matrix(batch.column("vec").take(pa.array(at)), int(dim)), int(dim))
                for i, b in zip(at, bits, strict=True):
                    codes[i] = b.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(a)], names=[*batch.schema.names, "code", "a"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{fields}, code binary, a double")


def _search(queries: pa.Table, block: pa.Table, k: int, bound: float) -> tuple[list, list, list]:
    """Best k of a block for each query: positions of queries, positions of vectors, scores."""
    dim = queries.column("dim")[0].as_py()
    q, x = matrix(queries.column("vec"), dim), matrix(block.column("vec"), dim)
    q_id, x_id = queries.column("id").to_numpy(), block.column("id").to_numpy()
    q_norm, x_norm, a = norms(q), norms(x), block.column("a").to_numpy()
    packed = np.frombuffer(b"".join(block.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
    signs = np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2 - 1
    error = (bound * np.sqrt(np.maximum(0, 1 - a * a)) / (a * np.sqrt(max(1, dim - 1)))).astype(np.float32)
    unbias = (1 / (a * np.sqrt(dim))).astype(np.float32)
    turned = ((q / q_norm[:, None]) @ rotation(dim).T).astype(np.float32)
    out_q, out_x, out_s = [], [], []

    def exact(i: int, at: np.ndarray) -> np.ndarray:
        return dots(x[at], q[i : i + 1]) / (x_norm[at] * q_norm[i])

    step = max(1, (8 << 20) // max(1, len(x)))
    for start in range(0, len(q), step):
        estimates = (turned[start : start + step] @ signs.T) * unbias
        for i, estimate in enumerate(estimates, start):
            own = x_id == q_id[i]
            estimate[own] = -np.inf
            first = np.argpartition(-estimate, min(4 * k, len(x) - 1))[: 4 * k]
            first = first[~own[first]]
            scores = exact(i, first)
            if len(first) >= k:
                reach = np.partition(scores, len(scores) - k)[len(scores) - k]
                at = np.flatnonzero(estimate + error >= reach - 1e-6)
                at = np.union1d(first, at)
                scores = exact(i, at)
            else:
                at = first
            best = np.lexsort((x_id[at], -scores))[:k]
            out_q += [i] * len(best)
            out_x += at[best].tolist()
            out_s += scores[best].tolist()
    return out_q, out_x, out_s


def nearest(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    bound: float = BOUND,
    query_block: int = QUERY_BLOCK,
    vector_block: int = VECTOR_BLOCK,
) -> DataFrame:
    """``(query_id, rank, neighbour_id, score)``: each query's k vectors of largest cosine found.

    ``is_query`` is a condition on column ``id``. A query's own id is no candidate; fewer
    candidates than k are all returned. Vectors of another length than the query's are none.
    Scores are exact cosines in double precision, ties go to the smaller id. See
    :func:`usable_vectors` for rows that take no part and for repeated ids. Long vectors make smaller
    blocks. Other columns are not looked at, whatever their names. An empty table, or one without
    queries, gives no rows.
    """
    index = materialize(build_index(usable_vectors(vectors, id_col, vec_col)), "codes")
    queries = index.where(is_query).select("id", "vec", "dim")
    rows, asked, longest = index.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1)), F.coalesce(F.max("dim"), F.lit(1))).first()
    most = max(1, BLOCK_BYTES // (8 * longest))
    xs, qs = max(1, -(-rows // min(vector_block, most))), max(1, -(-asked // min(query_block, most)))
    left = queries.withColumn("qb", F.pmod(F.xxhash64("id", F.lit("q")), F.lit(qs)).cast("int"))
    left = left.withColumn("xb", F.explode(F.sequence(F.lit(0), F.lit(xs - 1))))
    right = index.withColumn("xb", F.pmod(F.xxhash64("id"), F.lit(xs)).cast("int"))
    right = right.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qs - 1))))
    schema = pa.schema([("query_id", pa.int64()), ("neighbour_id", pa.int64()), ("score", pa.float64())])

    def pair(some: pa.Table, block: pa.Table) -> pa.Table:
        if not some.num_rows or not block.num_rows:
            return schema.empty_table()
        out_q, out_x, out_s = _search(some, block, k, bound)
        ids = some.column("id").take(pa.array(out_q, pa.int64())), block.column("id").take(pa.array(out_x, pa.int64()))
        return pa.table([*(x.cast(pa.int64()) for x in ids), pa.array(out_s, pa.float64())], schema=schema)

    found = left.groupBy("dim", "qb", "xb").cogroup(right.groupBy("dim", "qb", "xb"))
    found = found.applyInArrow(pair, "query_id long, neighbour_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbour_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "score")
