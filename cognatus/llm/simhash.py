"""SimHash near-duplicates found by pigeonring filtering.

Fingerprints of 64 bits in eight segments of a byte lie on a ring. If two differ in at most
three bits, some start exists from which every chain of l segments differs in at most 3*l/8
bits, rounded down: 0 bits over the first two segments, 1 over five, 2 over seven, 3 over all.
Candidates therefore agree exactly on the two first segments of a chain and on two of the next
three. These 24 keys of 32 bits each are the join keys; the longer chains prune what they
bring together before the full Hamming check.

Documents that are only similar differ in more bits than that: :func:`drop_near_duplicates` has a
threshold on similarity and compares sets of shingles, see :mod:`cognatus.llm.jaccard`.

Scale: equal fingerprints are merged first, so a group of copies is one row. Keys that occur
once leave before any pairing. A bucket of more than ``TILE`` fingerprints is salted into
tiles, and a task holds two of them at a time. Tasks emit a star per local component, never
its pairs. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cognatus.llm.text import slices, small_batches, tidy
from cognatus.operators.graph import star_forest
from cognatus.session import materialize

SEGMENTS, DISTANCE = 8, 3
TILE = 4096
#: Runs up to this length are paired by offsets, longer ones by blocks.
SHORT = 32
PIECE = 1 << 16


def simhash(words: list[bytes], shingle: int, seed: int = 42) -> bytes:
    """Fingerprint of one document's words, least byte first; zeros if there are no words."""
    if not words:
        return bytes(8)
    ones, total = np.zeros(64, np.int64), 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), PIECE):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + PIECE], ends[at : at + PIECE], strict=True)], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
        total += len(hashes)
    return np.packbits(2 * ones > total, bitorder="little").tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)`` of every document: A-Z lower-cased, whole text, repeated shingles counted.

    Fewer words than a shingle make one shingle; null, empty and blank texts have fingerprint
    zero. ``fp`` is its bits as a long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                texts = pc.fill_null(piece.column("text"), "").cast(pa.binary()).to_pylist()
                fps = [simhash(t.lower().split(), shingle) for t in texts]
                column = pa.array(np.frombuffer(b"".join(fps), "<i8"))
                yield pa.RecordBatch.from_arrays([piece.column("id"), column], names=["id", "fp"])

    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"id {id_type}, fp long")


def ring_keys(fp: Column | str = "fp") -> Column:
    """The 24 keys of a fingerprint, each with its chain's start and the segment left out."""
    fp = F.col(fp) if isinstance(fp, str) else fp

    def seg(i: int) -> Column:
        return F.shiftrightunsigned(fp, 8 * (i % SEGMENTS)).bitwiseAND(F.lit(255))

    keys = []
    for start in range(SEGMENTS):
        for left_out in range(3):
            used = [start, start + 1] + [start + 2 + k for k in range(3) if k != left_out]
            key = F.lit((start * 3 + left_out) << 32).cast("long")
            for place, s in enumerate(used):
                key = key.bitwiseOR(F.shiftleft(seg(s), 8 * place))
            keys.append(key)
    return F.array(*keys)


def _near(a: np.ndarray, b: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Chains of 5 and 7 segments first, then the whole distance; fingerprints have a column a lane."""
    x = np.bitwise_xor(a[..., 0], b[..., 0])
    down = np.uint64(8) * np.asarray(start, np.uint64)
    ring = np.right_shift(x, down) | np.left_shift(x, (np.uint64(64) - down) % np.uint64(64))
    ok = np.bitwise_count(ring & np.uint64((1 << 40) - 1)) <= DISTANCE * 5 // SEGMENTS
    ok &= np.bitwise_count(ring & np.uint64((1 << 56) - 1)) <= DISTANCE * 7 // SEGMENTS
    return ok & (np.bitwise_count(x) <= DISTANCE)


class _Stars:
    """Union-find over row numbers."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                return
            low, high = np.minimum(la[apart], lb[apart]), np.maximum(la[apart], lb[apart])
            to = np.arange(len(label))
            np.minimum.at(to, high, low)
            while (to[to] != to).any():
                to = to[to]
            label[:] = to[label]


def _link_run(stars: _Stars, at: int, fp: np.ndarray, salt: np.ndarray, i: int, j: int, start: int, near: Callable, block: int = 1024) -> None:
    """Link the rows of one long run, which begins at row ``at``; two salts are compared with each other only."""
    left, right = np.flatnonzero(salt == i), np.flatnonzero(salt == j)
    own = _Stars(len(fp))
    for p in range(0, len(left), block):
        rows = left[p : p + block]
        for q in range(0, len(right), block):
            cols = right[q : q + block]
            if i == j and cols[-1] <= rows[0]:
                continue
            a, b = np.nonzero(near(fp[rows][:, None], fp[cols][None, :], start))
            own.link(rows[a], cols[b])
    stars.label[at : at + len(fp)] = own.label + at


def _link_sorted(key: np.ndarray, i: np.ndarray, j: np.ndarray, salt: np.ndarray, name: np.ndarray, fp: np.ndarray, near: Callable) -> tuple[np.ndarray, np.ndarray]:
    """A star per component of whole runs, on its least name; rows are sorted by key, tiles and name."""
    new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
    length = np.diff(np.append(new, len(key)))
    start = (key >> 32) // 3 % SEGMENTS
    stars = _Stars(len(key))
    last = np.repeat(new + length, length)  # end of each row's run
    short = np.repeat(length <= SHORT, length)
    same = i == j
    src, dst = [], []
    for d in range(1, SHORT):
        at = np.flatnonzero(short & (np.arange(len(key)) + d < last))
        if not len(at):
            break
        at = at[same[at] | (salt[at] != salt[at + d])]
        hit = at[near(fp[at], fp[at + d], start[at])]
        src.append(hit)
        dst.append(hit + d)
    if src:
        stars.link(np.concatenate(src), np.concatenate(dst))
    for r in np.flatnonzero(length > SHORT):
        own = slice(new[r], new[r] + length[r])
        _link_run(stars, int(new[r]), fp[own], salt[own], int(i[new[r]]), int(j[new[r]]), int(start[new[r]]), near)
    on = np.flatnonzero(stars.label != np.arange(len(key)))
    pairs = np.unique(np.stack([name[on], name[stars.label[on]]], axis=1), axis=0)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def _paired(keys: DataFrame, tile: int) -> DataFrame:
    """``(k, i, j, salt, name)`` of the keys that several names have, a row for each pair of tiles a name is in."""
    full = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = keys.join(full, "k").select("k", "name", F.ceil(F.col("n") / F.lit(tile)).cast("int").alias("t"))
    rows = rows.select("k", "name", "t", F.pmod(F.xxhash64("name"), F.col("t")).cast("int").alias("salt"))
    rows = rows.select("k", "name", "salt", F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("other"))
    return rows.select("k", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), "salt", "name")


def _linked(rows: DataFrame, near: Callable) -> DataFrame:
    """``(src, dst)`` edges between names of rows ``(k, i, j, salt, name, fp)`` that are near each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] | None = None

        def emit(fields: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _link_sorted(*fields, near)], names=["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            fields = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("k", "i", "j", "salt", "name")]
            fp = batch.column("fp")
            flat = fp.to_numpy().view(np.uint64) if pa.types.is_int64(fp.type) else np.frombuffer(b"".join(fp.to_pylist()), "<u8")
            fields.append(flat.reshape(batch.num_rows, -1))
            if left is not None:
                fields = [np.concatenate(x) for x in zip(left, fields, strict=True)]
            k, i, j = (x != x[-1] for x in fields[:3])
            change = np.flatnonzero(k | i | j)
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut:
                yield emit([x[:cut] for x in fields])
            left = [x[cut:].copy() for x in fields]
        if left is not None and len(left[0]):
            yield emit(left)

    return rows.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "name").mapInArrow(tidy(run), "src long, dst long")


def fingerprint_links(fps: DataFrame, tile: int = TILE) -> DataFrame:
    """``(src, dst)`` edges that join all fingerprints (distinct longs in ``fp``) within three bits."""
    rows = _paired(fps.select(F.col("fp").alias("name"), F.explode(ring_keys("fp")).alias("k")), tile)
    return _linked(rows.withColumn("fp", F.col("name")), _near)


def _components(fps: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """``(id, fp, component)`` from ``(id, name, fp)``, ``(name, rep)`` and edges between names."""
    forest = star_forest(links)
    roots = classes.join(forest.select(F.col("v").alias("name"), F.col("u").alias("root")), "name", "left")
    roots = roots.select("name", "rep", F.coalesce("root", "name").alias("root"))
    named = roots.groupBy("root").agg(F.min("rep").alias("component"))
    by_name = roots.join(named, "root").select("name", "component")
    return fps.join(by_name, "name").select("id", "fp", "component")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp, component)``: one row per document; component is the least id reachable over links.

    Fingerprints link at three or fewer differing bits. Equal fingerprints are linked at
    distance zero, documents without words among them. Repeated rows stay rows. A null id is
    never a component's name; a component of null ids only is named null. Very long texts are read
    whole. Other columns are not looked at, whatever their names; an empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle).withColumn("name", F.col("fp")), "fingerprints")
    classes = materialize(fps.groupBy("name").agg(F.min("id").alias("rep")), "classes")
    return _components(fps, classes, fingerprint_links(classes.select(F.col("name").alias("fp"))))


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8
) -> DataFrame:
    """``docs`` with one row per group of near-duplicates: the one with the least id.

    Groups are those of :func:`cognatus.llm.jaccard.similar_groups`: every pair of texts with a Jaccard similarity of
    ``similarity`` or more is linked, and no other. A repeated id keeps one row, the first by a hash of
    the whole row. Rows without an id cannot be named and are kept as they are. Documents without words,
    null texts among them, are one group; very long texts are compared whole. Other columns stay as they
    are, whatever their names; an empty table stays empty.
    """
    from cognatus.llm.jaccard import similar_groups  # which pairs keys with this module

    groups = similar_groups(docs.where(F.col(id_col).isNotNull()), id_col, text_col, shingle, similarity)
    told = groups.groupBy("id").agg(F.bool_or(F.col("id") == F.col("component")).alias("keep"), F.count(F.lit(1)).alias("n"))
    # only ids that go or are repeated; the planner broadcasts them while the table's files are small
    odd = materialize(told.where("NOT keep OR n > 1").select(F.col("id").alias("__odd"), "keep"), "odd")
    kept = docs.join(odd, F.col(id_col) == F.col("__odd"), "left_anti")
    again = odd.where("keep")
    if again.isEmpty():
        return kept
    whole = [f.name for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
    first = Window.partitionBy(id_col).orderBy(F.xxhash64(*whole))
    repeated = docs.join(again, F.col(id_col) == F.col("__odd"), "left_semi").withColumn("__k", F.row_number().over(first))
    return kept.unionByName(repeated.where("__k = 1").drop("__k"))
