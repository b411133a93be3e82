"""Removal of long strings that an earlier document has as well, by distributed prefix doubling.

Every position of every text has a rank at length h, which stands for the h bytes from there on. The rank at
twice the length is that of the pair of ranks h apart, so ranks grow from 8 bytes to 16, to 32 and past
the threshold of ``width`` bytes by an overlapping pair. A rank is a 64-bit mix of its pair, the same in every
task, so no sort has to send ranks back to all positions; what Spark sorts, round after round, are the
ranks of the positions still in play, to find those that only one document has. They leave at once.

1. *Seeds*, 16 bytes. A window of ``width`` bytes is in play through its seed, the position in it with the least
   rank at 16 bytes (the first of equals): equal windows have equal seeds at equal distances. About a
   seventeenth of all positions are seeds. Seeds that one document alone has leave with all their windows.
2. *Blocks*. Windows that start up to ``BLOCK`` positions apart and share a seed have a core in common and lie in a
   whole (43 and 57 bytes of 50). A core that one document alone has leaves. If all documents that have a
   core also have its whole, the windows of later ones are found, past the threshold and without being sorted.
3. *Windows*, ``width`` bytes: where wholes differ, which is at the ends of repeated passages, each is ranked.

Scale: equal texts are merged first, with map-side combine; later copies lose everything. Texts are dealt to parts of about
``PART_BYTES`` and bucketed by part once; no later round shuffles text. A part sends each rank
once, however often it has it, so a passage that a third of all documents share is a row a part, and
gets back those that others have too. Tasks hold a part and hash it in slices. Nothing is collected or broadcast.

Ranks are compared in pairs (a whole with its core, a window with its core), which together differ for different
strings but for a probability of about 2^-64 for each pair of strings with equal cores. Seeds alone only keep positions in play.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cognatus.llm.text import give_back, ragged, small_batches
from cognatus.session import discard, materialize, shared_path

WIDTH = 50
#: Starts of windows, relative to the seed, that are judged together.
BLOCK = 8
#: Bytes of text in a part, about; buckets are as many as the parts, up to a number that a cluster can shuffle to.
PART_BYTES, MOST_BUCKETS = 8 << 20, 20_000
#: Positions hashed at a time; their numbers fit into 16 bits.
SLICE, CUT = 60_000, 40_000
LOW = np.uint64(0xFFFF)
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def pair_rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of the pairs of ranks ``(a, b)``."""
    h = a * MIX[0]
    h ^= h >> np.uint64(32)
    h += b
    h *= MIX[1]
    h ^= h >> np.uint64(29)
    h *= MIX[2]
    h ^= h >> np.uint64(32)
    return h


def doubled(ranks: np.ndarray, length: int) -> np.ndarray:
    """From ranks at ``length`` those at twice the length."""
    return pair_rank(ranks[:-length], ranks[length:])


def ranks_at(ranks: np.ndarray, known: int, at: np.ndarray, length: int) -> np.ndarray:
    """Ranks at ``length`` of some positions, from all positions' ranks at the ``known`` length, which is shorter."""
    out, done = ranks[at], known
    while done < length:
        done = min(done + known, length)
        out = pair_rank(out, ranks[at + (done - known)])
    return out


@dataclass
class Plan:
    """Lengths that follow from the width."""

    width: int

    def __post_init__(self) -> None:
        if self.width < 24:
            raise ValueError("repeats shorter than 24 bytes are not looked for")
        self.seed = 16 if self.width >= 40 else 8
        self.core, self.whole = self.width - BLOCK + 1, self.width + BLOCK - 1
        self.known = 1 << (self.core.bit_length() - 1)


@dataclass
class Blocks:
    """A slice's blocks: runs of windows that share a seed and a distance to it, up to ``BLOCK``."""

    ranks: np.ndarray  # at plan.known bytes, of all positions of the slice
    text: np.ndarray  # the blocks' texts in the part
    seed: np.ndarray  # ranks of their seeds
    low: np.ndarray  # first and last window, as positions in the slice
    high: np.ndarray
    core: np.ndarray  # where the core starts
    step: np.ndarray  # number of the distance
    first: np.ndarray  # where the text, or what the slice has of it, begins and ends
    last: np.ndarray
    shift: np.ndarray  # from positions in the slice to those in the text

    def take(self, rows: np.ndarray) -> Blocks:
        return Blocks(self.ranks, *(getattr(self, f)[rows] for f in ("text", "seed", "low", "high", "core", "step", "first", "last", "shift")))

    def cores(self, plan: Plan) -> np.ndarray:
        return pair_rank(pair_rank(ranks_at(self.ranks, plan.known, self.core, plan.core), self.seed), self.step.astype(np.uint64))

    def wholes(self, plan: Plan) -> np.ndarray:
        """Zero where the whole would reach over an end of the text."""
        start = self.core - (BLOCK - 1)
        inside = (start >= self.first) & (start + plan.whole <= self.last)
        out = np.zeros(len(start), np.uint64)
        out[inside] = ranks_at(self.ranks, plan.known, start[inside], plan.whole)
        return out


def _pieces(sizes: np.ndarray, width: int) -> Iterator[list[tuple[int, int, int]]]:
    """Slices, as lists of ``(text, first window, end of windows)``."""
    own, total = [], 0
    for i in np.flatnonzero(sizes >= width).tolist():
        windows = int(sizes[i]) - width + 1
        for start in range(0, windows, CUT):
            end = min(start + CUT, windows)
            if own and total + end - start + width + 2 * BLOCK > SLICE:
                yield own
                own, total = [], 0
            own.append((i, start, end))
            total += end - start + width + 2 * BLOCK
    if own:
        yield own


def blocks_of(data: np.ndarray, offsets: np.ndarray, plan: Plan) -> Iterator[Blocks]:
    """All windows of the texts ``data[offsets[i]:offsets[i + 1]]``, block by block."""
    sizes = np.diff(offsets)
    for own in _pieces(sizes, plan.width):
        text, start, end = (np.array(c, np.int64) for c in zip(*own, strict=True))
        low = np.maximum(0, start - BLOCK + 1)
        high = np.minimum(sizes[text], end - 1 + plan.width + BLOCK - 1)
        base = np.cumsum(high - low) - (high - low)
        buf = np.concatenate([data[offsets[t] + a : offsets[t] + b] for t, a, b in zip(text.tolist(), low.tolist(), high.tolist(), strict=True)])
        ranks, length = np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,)).astype(np.uint64), 8
        seeds = None
        while length < plan.known or length < plan.seed:
            if length == plan.seed:
                seeds = ranks
            ranks, length = doubled(ranks, length), 2 * length
        seeds = ranks if seeds is None else seeds
        # the least rank in each window, with its position in the low bits
        least = (seeds & ~LOW) | np.arange(len(seeds), dtype=np.uint64)
        reach, many = 1, plan.width - plan.seed + 1
        while reach < many:
            by = min(reach, many - reach)
            least = np.minimum(least[:-by], least[by:])
            reach += by
        windows = ragged(base + start - low, end - start)
        seed = (least[windows] & LOW).astype(np.int64)
        step = (seed - windows) // BLOCK
        new = np.flatnonzero((seed[1:] != seed[:-1]) | (step[1:] != step[:-1])) + 1
        firsts, lasts = np.concatenate(([0], new)), np.concatenate((new - 1, [len(windows) - 1]))
        segment = np.searchsorted(base, windows[firsts], side="right") - 1
        seed, step = seed[firsts], step[firsts]
        yield Blocks(
            ranks, text[segment], seeds[seed], windows[firsts], windows[lasts], seed - BLOCK * step, step, base[segment], (base + high - low)[segment], (low - base)[segment]
        )


# -- what goes from parts to the sort, and back -------------------------------------------------------

#: A rank, what it is compared with besides, the least id that has it, whether several ids of the part have it, and the whole of a core: what each round needs of these.
SENT = {
    1: "part int, name long, multi boolean",
    2: "part int, name long, multi boolean, m long, whole long",
    3: "part int, name long, multi boolean, m long, tag long",
}
BACK = "part int, round int, name long, tag long, m long, mixed boolean"
BACK_NAMES = [f.split()[0] for f in BACK.split(", ")]


def _sent(number: int, part: int, name: np.ndarray, m: np.ndarray, tag: np.ndarray | None = None, whole: np.ndarray | None = None) -> pa.Table:
    """A row a rank (and tag), whatever its occurrences in the part."""
    tag = np.zeros(len(name), np.uint64) if tag is None else tag
    order = np.lexsort((name, tag)) if tag.any() else np.argsort(name, kind="stable")
    name, tag, m = name[order], tag[order], m[order]
    starts = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (tag[1:] != tag[:-1])))) if len(name) else np.zeros(0, np.int64)
    over = lambda f, x: f.reduceat(x, starts) if len(starts) else x[:0]
    least = over(np.minimum, m)
    columns = {"part": np.full(len(starts), part, np.int32), "name": name[starts].view(np.int64), "multi": least != over(np.maximum, m)}
    if number > 1:
        columns["m"] = least
    if number == 2:
        whole = whole[order]
        low, high = over(np.minimum, whole), over(np.maximum, whole)
        columns["whole"] = np.where(low == high, low, 0).astype(np.uint64).view(np.int64)
    if number == 3:
        columns["tag"] = tag[starts].view(np.int64)
    return pa.table({c: pa.array(v) for c, v in columns.items()})


def judge(rows: DataFrame, number: int) -> DataFrame:
    """Sort ranks and return to their parts those that several ids have, with the least of the ids.

    ``mixed``: the parts know of more than one whole.
    """

    keys = ["name", "tag"] if "tag" in rows.columns else ["name"]

    def groups(columns: list[np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
        own = dict(zip(rows_of, columns, strict=True))
        sizes = np.diff(np.append(starts, len(own["name"])))
        shared = (sizes > 1) | np.logical_or.reduceat(own["multi"], starts)
        keep = np.repeat(shared, sizes)
        none, spread = np.zeros(int(keep.sum()), np.int64), lambda x: np.repeat(x, sizes)[keep]
        least = spread(np.minimum.reduceat(own["m"], starts)) if "m" in own else none
        mixed = none.astype(bool)
        if "whole" in own:
            low, high = np.minimum.reduceat(own["whole"], starts), np.maximum.reduceat(own["whole"], starts)
            mixed = spread((low != high) | (low == 0))
        out = [own["part"][keep], np.full(len(none), number, np.int32), own["name"][keep], own["tag"][keep] if "tag" in own else none, least, mixed]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=BACK_NAMES)

    rows_of = rows.columns
    at = [rows_of.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the rows of the last, unended group
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held and all(now[k][-1] == held[0][k][0] for k in at):
                held.append(now)
                continue
            now = [np.concatenate([*(h[k] for h in held), now[k]]) for k in range(len(now))]
            starts = np.concatenate(([0], np.flatnonzero(np.logical_or.reduce([now[k][1:] != now[k][:-1] for k in at])) + 1))
            if starts[-1]:
                yield groups([c[: starts[-1]] for c in now], starts[:-1])
            held = [[c[starts[-1] :] for c in now]]
        if held:
            yield groups([np.concatenate([h[k] for h in held]) for k in range(len(held[0]))], np.zeros(1, np.int64))

    return rows.repartition("name").sortWithinPartitions(*keys).mapInArrow(run, BACK)


class Known:
    """What has come back to a part, by round."""

    def __init__(self, table: pa.Table | None) -> None:
        self.rounds: dict[int, tuple[np.ndarray, ...]] = {}
        if table is None:
            return
        columns = [table.column(c).to_numpy() for c in ("round", "name", "tag", "m", "mixed")]
        for number in np.unique(columns[0]).tolist():
            name, tag, m, mixed = (c[columns[0] == number] for c in columns[1:])
            name, tag = name.view(np.uint64), tag.view(np.uint64)
            order = np.lexsort((tag, name))
            self.rounds[number] = name[order], tag[order], m[order], mixed[order]

    def find(self, number: int, name: np.ndarray, tag: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``(found, place)`` of the names in a round."""
        if number not in self.rounds or not len(name):
            return np.zeros(len(name), bool), np.zeros(len(name), np.int64)
        names, tags = self.rounds[number][:2]
        place = np.searchsorted(names, name)
        inside = lambda: (place < len(names)) & (names[np.minimum(place, len(names) - 1)] == name)
        if tag is not None:
            while (other := inside() & (tags[np.minimum(place, len(names) - 1)] != tag)).any():
                place = place + other
        return inside(), np.minimum(place, len(names) - 1)


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    texts = table.column("text").combine_chunks().cast(pa.large_binary())
    texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def _found(table: pa.Table, known: Known, plan: Plan) -> Iterator[tuple[Blocks, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: the blocks still in play after round 2, their cores, least ids, whether mixed, and the ids of their texts."""
    data, offsets = _texts(table)
    ids = table.column("m").to_numpy()
    for blocks in blocks_of(data, offsets, plan):
        blocks = blocks.take(known.find(1, blocks.seed)[0])
        cores = blocks.cores(plan)
        found, place = known.find(2, cores)
        blocks, place = blocks.take(found), place[found]
        if len(place):
            yield blocks, cores[found], known.rounds[2][2][place], known.rounds[2][3][place], ids[blocks.text]


def seeds(table: pa.Table, plan: Plan) -> pa.Table:
    data, offsets = _texts(table)
    ids, part = table.column("m").to_numpy(), table.column("part")[0].as_py()
    some = [(b.seed, ids[b.text]) for b in blocks_of(data, offsets, plan)]
    name, m = (np.concatenate([s[k] for s in some]) if some else np.zeros(0, t) for k, t in ((0, np.uint64), (1, np.int64)))
    return _sent(1, part, name, m)


def cores(table: pa.Table, known: Known, plan: Plan) -> pa.Table:
    data, offsets = _texts(table)
    ids, part = table.column("m").to_numpy(), table.column("part")[0].as_py()
    some = []
    for blocks in blocks_of(data, offsets, plan):
        blocks = blocks.take(known.find(1, blocks.seed)[0])
        some.append((blocks.cores(plan), ids[blocks.text], blocks.wholes(plan)))
    name, m, whole = (np.concatenate([s[k] for s in some]) if some else np.zeros(0, t) for k, t in ((0, np.uint64), (1, np.int64), (2, np.uint64)))
    return _sent(2, part, name, m, whole=whole)


def windows(table: pa.Table, known: Known, plan: Plan) -> pa.Table:
    part, some = table.column("part")[0].as_py(), []
    for blocks, core, _, mixed, ids in _found(table, known, plan):
        size = np.where(mixed, blocks.high - blocks.low + 1, 0)
        at = ragged(blocks.low, size)
        some.append((ranks_at(blocks.ranks, plan.known, at, plan.width), np.repeat(ids, size), np.repeat(core, size)))
    name, m, tag = (np.concatenate([s[k] for s in some]) if some else np.zeros(0, t) for k, t in ((0, np.uint64), (1, np.int64), (2, np.uint64)))
    return _sent(3, part, name, m, tag=tag)


def repeats(table: pa.Table, known: Known, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, start, end)`` of the maximal runs of bytes that earlier texts have, in order."""
    some = [np.zeros((3, 0), np.int64)]
    for blocks, core, least, mixed, ids in _found(table, known, plan):
        done = ~mixed & (least < ids)
        some.append(np.stack([blocks.text[done], (blocks.low + blocks.shift)[done], (blocks.high + blocks.shift)[done] + plan.width]))
        size = np.where(mixed, blocks.high - blocks.low + 1, 0)
        at = ragged(blocks.low, size)
        owner = np.repeat(np.arange(len(size)), size)
        found, place = known.find(3, ranks_at(blocks.ranks, plan.known, at, plan.width), core[owner])
        at, owner, place = at[found], owner[found], place[found]
        if len(at):
            earlier = known.rounds[3][2][place] < ids[owner]
            at, owner = at[earlier] + blocks.shift[owner[earlier]], owner[earlier]
            some.append(np.stack([blocks.text[owner], at, at + plan.width]))
    text, start, end = np.concatenate(some, axis=1)
    order = np.lexsort((start, text))
    text, start, end = text[order], start[order], end[order]
    if not len(text):
        return text, start, end
    far = int(end.max()) + 2  # texts are put one behind the other, with a gap
    reach = np.maximum.accumulate(end + text * far)
    new = np.concatenate(([True], start[1:] + text[1:] * far > reach[:-1]))
    firsts = np.flatnonzero(new)
    return text[firsts], start[firsts], reach[np.append(firsts[1:] - 1, len(reach) - 1)] - text[firsts] * far


RESULT = "digest binary, m long, spans array<struct<start: long, length: long>>, kept_sha256 string"


def _results(table: pa.Table, known: Known, plan: Plan) -> pa.Table:
    text, start, end = repeats(table, known, plan)
    data, offsets = _texts(table)
    bounds = np.searchsorted(text, np.arange(len(table) + 1)).tolist()
    digests = []
    for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        h, at = hashlib.sha256(), int(offsets[i])
        for k in range(a, b):
            h.update(data[at : offsets[i] + start[k]])
            at = int(offsets[i] + end[k])
        h.update(data[at : offsets[i + 1]])
        digests.append(h.hexdigest())
    spans = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(start), pa.array(end - start)], names=["start", "length"]))
    return pa.table([table.column("digest").combine_chunks(), table.column("m").combine_chunks(), spans, pa.array(digests, pa.string())], names=["digest", "m", "spans", "kept_sha256"])


# -- the whole ----------------------------------------------------------------------------------


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes a query's shuffle files as soon as its table is written, instead of some time later."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _bucketed(docs: DataFrame, id_col: str, text_col: str, part_bytes: int) -> tuple[DataFrame, str]:
    """Distinct texts ``(m, text, digest, part)`` with their least ids, bucketed by part; and the table's name."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = size // part_bytes + 1
    distinct = rows.where("id IS NOT NULL").groupBy("text").agg(F.min("id").alias("m"))
    distinct = distinct.withColumn("digest", F.unhex(F.sha2("text", 256)))
    distinct = distinct.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int"))
    buckets, name = min(parts, MOST_BUCKETS), f"texts_{uuid.uuid4().hex}"
    path = shared_path(spark, name)
    distinct.repartition(buckets, "part").write.bucketBy(buckets, "part").option("path", path).option("compression", "zstd").saveAsTable(name)
    texts = spark.table(name)
    texts._cognatus_path = path
    return texts, name


def _round(send: Callable[..., pa.Table], texts: DataFrame, back: DataFrame | None, plan: Plan, schema: str) -> DataFrame:
    if back is None:

        def alone(table: pa.Table) -> pa.Table:
            try:
                return send(table, plan)
            finally:
                give_back()

        return texts.groupBy("part").applyInArrow(alone, schema)

    def both(table: pa.Table, known: pa.Table) -> pa.Table:
        try:
            return send(table, Known(known), plan)
        finally:
            give_back()

    return texts.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(both, schema)


def repeated_strings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(id, n_bytes, spans, kept_sha256)`` per row: the maximal runs of bytes covered by strings of ``width`` bytes
    that also start in a row with a smaller id, and the SHA-256 of the other bytes.

    Texts count as UTF-8, null as empty; matches never cross texts, and all are judged on the texts as
    given. Rows with equal ids do not remove from each other; repeated rows get equal results. A null id is neither smaller nor greater
    than another, so such rows lose nothing and remove nothing. Texts shorter than ``width`` stay as they are. A text may be
    longer than a part, which its task then holds. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    plan = Plan(width)
    with shuffles_deleted(spark):
        texts, name = _bucketed(docs, id_col, text_col, part_bytes)
        back, tables = None, []
        for number, send in enumerate((seeds, cores, windows), 1):
            tables.append(materialize(judge(_round(send, texts, back, plan, SENT[number]), number), "ranks", compression="zstd"))
            back = tables[-1] if back is None else back.unionByName(tables[-1])
        found = materialize(_round(_results, texts, back, plan, RESULT), "repeats")
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry; the files lie in the shared folder
    for table in [*tables, texts]:
        discard(table)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    rows = rows.withColumn("__digest", F.unhex("whole")).join(found, F.col("__digest") == F.col("digest"), "left")
    first, gone = F.col("id") == F.col("m"), (F.col("id") > F.col("m")) & (F.col("n_bytes") >= width)
    none = F.array().cast("array<struct<start: bigint, length: bigint>>")
    every = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("length")))
    return rows.select(
        "id",
        "n_bytes",
        F.when(first, F.col("spans")).when(gone, every).otherwise(none).alias("spans"),
        F.when(first, F.col("kept_sha256")).when(gone, F.sha2(F.lit(""), 256)).otherwise(F.col("whole")).alias("kept_sha256"),
    )
