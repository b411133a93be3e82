"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

``P(word | context) = P(class | context) * P(slot | class, context) * P(word | slot)``. Both
softmaxes have their own hashed weights over the same n-gram and skip features of the three words
before; the second one's features are crossed with the class. The commonest words have a slot each,
so theirs is a softmax over words; rarer words share slots by topic and frequency, within which the
maximum-entropy distribution given the words' counts is the add-one unigram. One class is that of
words seen once and never: half of it, as Good and Turing estimate, is the one event of an unseen
word. The probabilities of all words and this event add up to one whatever the weights.

A word's topic is the cluster of texts that most of its tokens stand in. The clusters (a mixture of multinomials
over hashed words) are started from about ``SAMPLE`` texts and fitted to all in a round of their own. Rare words act as features by their slot.

Scale, step by step:

- The text is read twice, besides the sample: for the clusters, whose counts are added up by cell, and for all else. Each slice of about 2 MB becomes a *part*: one row with
  its tokens as codes into its own sorted vocabulary of 64-bit word hashes.
- Counts: every part sends its vocabulary to hash buckets, whose number follows the amount
  sent; a bucket adds up its words over all parts and sends each part its counts back. No
  word is a row, and a frequent word is one entry per part.
- Training: parts lie in groups of about ``GROUP_TOKENS`` tokens and are dealt into rounds. In a
  round each task runs AdaGrad over its parts from the common weights and sends the rows it
  touched; they are added up row by row in a stream, averaged by how often each was touched.
  The number of rows follows the vocabulary, up to ``MOST_BITS``, for every task holds them.
- Scoring is a scan of the parts in numpy batches.

Word hashes are XXH64: two of a hundred million distinct words collide with a probability of
about 3e-4, and would then share a count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cognatus.llm.text import slices, small_batches, split_words, tidy
from cognatus.session import discard, materialize

PART_BYTES = 2 << 20
#: Vocabulary entries a hash bucket takes in, on average.
BUCKET_ENTRIES = 1 << 20
#: Training tokens that a training task sees over all rounds, about.
GROUP_TOKENS = 6_000_000
CLASSES, SLOTS = 32, 32
#: The last class: words seen once, a slot for each topic, and the unseen word.
ONCE = CLASSES - 1
HEADS = 720
TOPICS, BINS_OF_WORDS, SAMPLE = 8, 1024, 2000
FEATURES = 5
#: Rows of weights for each feature template, as a power of two: a 512th of the vocabulary, within these.
LEAST_BITS, MOST_BITS = 11, 15
#: Words counted less often act as features by their slot.
KNOWN_FEATURE = 4
ROUNDS = 4
RATE = 0.3
#: What AdaGrad starts its sums of squares from: a row seen once moves by its gradient, not by a full step.
PRIOR = 1.0
#: Tokens to a batch: a ``STEPS``-th of what a task has in a round, within these.
LEAST_BATCH, MOST_BATCH, STEPS = 1 << 10, 1 << 14, 64
BLOCKS = 64
#: Bins of word counts: so many to a doubling.
FINE = 8
BINS = 64 * FINE
_U = np.uint32


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 1)


#: The end of a text; no word is empty.
END = word_hash(b"")


def learns_from(id_col: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    """Whether crc32 of the id's text leaves another remainder than ``fold``; a null id is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds != fold, F.lit(False))


def _hashed(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(tokens, lengths, hashes)`` of texts: codes into the sorted hashes of the distinct words, ends included."""
    codes, words, offsets = split_words(piece.column("text"), "ascii")
    lengths = np.diff(offsets) + 1
    ends = np.cumsum(lengths)
    tokens = np.full(int(ends[-1]), len(words), np.int64)
    inner = np.ones(len(tokens), bool)
    inner[ends - 1] = False
    tokens[inner] = codes
    hashes = [word_hash(w) for w in words.cast(pa.binary()).to_pylist()]
    hashes = np.array([*hashes, END], np.uint64)
    order = np.argsort(hashes)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[tokens], lengths, hashes[order]


def _word_bins(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(17)) % np.uint64(BINS_OF_WORDS)).astype(np.int64)


def fit_topics(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Log probabilities of hashed words, a column for each cluster of texts; ``docs`` has id, text and trains.

    A round of hard EM over all texts learned from, started by :func:`first_topics`: each text goes to its likeliest cluster, and a
    cluster's probabilities are those of the words of all its texts. Tasks send whole counts per cluster and bin, so the order of sums changes nothing.
    """
    start = first_topics(docs, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(TOPICS * BINS_OF_WORDS, np.int64)
        for batch in batches:
            for piece in slices(batch, "text", PART_BYTES):
                tokens, lengths, hashes = _hashed(piece)
                bins = _word_bins(hashes)
                close = np.add.reduceat(start[bins][tokens], np.cumsum(lengths) - lengths, axis=0)
                cell = np.repeat(np.argmax(close, axis=1), lengths) * BINS_OF_WORDS + bins[tokens]
                sums += np.bincount(cell, minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], names=["cell", "n"])

    counted = docs.where("trains").select("text").mapInArrow(tidy(run), "cell long, n long")
    sums = np.zeros(TOPICS * BINS_OF_WORDS)
    for row in counted.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # as many as there are cells at most
        sums[row["cell"]] = row["n"]
    return _log_p(sums.reshape(TOPICS, -1)) if sums.any() else start


def _log_p(sums: np.ndarray) -> np.ndarray:
    sums = sums + 0.1
    return np.ascontiguousarray(np.log(sums / sums.sum(axis=1, keepdims=True)).T, np.float32)


def first_topics(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Where :func:`fit_topics` starts.

    Hard EM over a sample of about ``sample`` of the texts learned from. Rows are picked, by a hash of the id and the row's place, so that
    an id on many rows brings no more of them than other ids do, and the sample stays as small.
    """
    step = max(1, docs.count() // sample)
    some = docs.withColumn("pick", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(step)))
    some = some.where(F.col("trains") & (F.col("pick") == 0)).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", PART_BYTES):
                tokens, lengths, hashes = _hashed(piece)
                cell = np.repeat(np.arange(len(lengths)), lengths) * BINS_OF_WORDS + _word_bins(hashes)[tokens]
                counts = np.bincount(cell, minlength=len(lengths) * BINS_OF_WORDS).reshape(len(lengths), -1)
                yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f4").tobytes() for x in counts], pa.binary())], names=["counts"])

    rows = sorted(r["counts"] for r in some.mapInArrow(tidy(run), "counts binary").collect())
    if not rows:
        return np.zeros((BINS_OF_WORDS, TOPICS), np.float32)
    return cluster(np.frombuffer(b"".join(rows), "<f4").reshape(len(rows), -1))


def cluster(counts: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Log probabilities of a mixture of ``TOPICS`` multinomials, bins by clusters, from far apart rows."""
    unit = np.sqrt(counts / counts.sum(axis=1, keepdims=True))
    close = unit @ unit.mean(axis=0)
    seeds = [int(np.argmax(close))]
    nearest = unit @ unit[seeds[0]]
    for _ in range(1, TOPICS):
        seeds.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, unit @ unit[seeds[-1]])
    label = np.argmax(unit @ unit[seeds].T, axis=1)
    for _ in range(rounds):
        sums = np.stack([counts[label == g].sum(axis=0) for g in range(TOPICS)]) + 0.1
        log_p = np.log(sums / sums.sum(axis=1, keepdims=True))
        again = np.argmax(counts @ log_p.T, axis=1)
        if (again == label).all():
            break
        label = again
    return np.ascontiguousarray(log_p.T, np.float32)


def tokenize(docs: DataFrame, topics: np.ndarray) -> DataFrame:
    """One row per part: ids, who is learned from, token codes, and the vocabulary with counts and topics.

    A part's topic of a word is that of most of the word's training tokens there.
    """
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, "text", PART_BYTES):
                tokens, lengths, hashes = _hashed(piece)
                train = piece.column("trains").to_numpy(zero_copy_only=False)
                close = np.add.reduceat(topics[_word_bins(hashes)][tokens], np.cumsum(lengths) - lengths, axis=0)
                topic = np.argmax(close, axis=1)
                learned = np.repeat(train, lengths)
                cell = tokens[learned] * TOPICS + np.repeat(topic, lengths)[learned]
                split = np.bincount(cell, minlength=len(hashes) * TOPICS).reshape(-1, TOPICS)
                width = 2 if len(hashes) <= 1 << 16 else 4
                row = [
                    pa.array([task << 24 | k], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), piece.column("id")),
                    pa.array([train.tolist()], pa.list_(pa.bool_())),
                    pa.array([lengths.astype("<u4").tobytes()], pa.binary()),
                    pa.array([width], pa.int32()),
                    pa.array([tokens.astype(f"<u{width}").tobytes()], pa.binary()),
                    pa.array([hashes.astype("<u8").tobytes()], pa.binary()),
                    pa.array([split.sum(axis=1).astype("<u4").tobytes()], pa.binary()),
                    pa.array([np.argmax(split, axis=1).astype(np.uint8).tobytes()], pa.binary()),
                    pa.array([len(hashes)], pa.int64()),
                    pa.array([len(tokens)], pa.int64()),
                ]
                k += 1
                yield pa.RecordBatch.from_arrays(row, names=["part", "ids", "trains", "lengths", "width", "codes", "hashes", "counts", "topics", "entries", "tokens"])

    schema = f"part long, ids array<{id_type}>, trains array<boolean>, lengths binary, width int, codes binary, hashes binary, counts binary, topics binary, entries long, tokens long"
    return docs.mapInArrow(tidy(run), schema)


def _bin(counts: np.ndarray) -> np.ndarray:
    return np.floor(FINE * np.log2(np.maximum(counts, 1))).astype(np.int64)


def count_words(parts: DataFrame) -> DataFrame:
    """Word counts and topics over all parts.

    Rows ``(part, bucket, counts, count_width, topics, cells, words, mass, top, top_n, top_topic)``: with
    a part, the bucket's counts and topics of that part's words, in its order; without one, the
    bucket's histogram over topics and bins of counts, and its commonest words.
    """
    entries = parts.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]
    buckets = max(8, -(-entries // BUCKET_ENTRIES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
        for batch in batches:
            for part, hashes, counts, topics in zip(*(batch.column(c).to_pylist() for c in ("part", "hashes", "counts", "topics")), strict=True):
                h = np.frombuffer(hashes, "<u8")
                cuts = [0, *np.searchsorted(h, borders).tolist(), len(h)]
                some = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
                cut = lambda raw, width: pa.array([raw[width * cuts[b] : width * cuts[b + 1]] for b in some], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(some), pa.int64()), pa.array(some, pa.int32()), cut(hashes, 8), cut(counts, 4), cut(topics, 1)],
                    names=["part", "bucket", "hashes", "counts", "topics"],
                )

    longs = pa.list_(pa.int64())
    out = pa.schema(
        [("part", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), ("count_width", pa.int32()), ("topics", pa.binary())]
        + [(c, longs) for c in ("cells", "words", "mass", "top", "top_n", "top_topic")]
    )

    def add(table: pa.Table) -> pa.Table:
        read = lambda c, kind: [np.frombuffer(x, kind) for x in table.column(c).to_pylist()]
        hashes, counts = read("hashes", "<u8"), np.concatenate(read("counts", "<u4"))
        known, which = np.unique(np.concatenate(hashes), return_inverse=True)
        split = np.bincount(which * TOPICS + np.concatenate(read("topics", np.uint8)), weights=counts, minlength=len(known) * TOPICS).reshape(-1, TOPICS)
        total, topic = split.sum(axis=1).astype(np.int64), np.argmax(split, axis=1)
        ends = np.cumsum([len(h) for h in hashes])[:-1]
        seen = np.flatnonzero(total > 0)
        cell = topic[seen] * BINS + _bin(total[seen])
        words, mass = np.bincount(cell), np.bincount(cell, weights=total[seen]).astype(np.int64)
        cells = np.flatnonzero(words)
        first = seen[np.lexsort((known[seen], -total[seen]))[:HEADS]]
        width = 4 if total.max(initial=0) < 1 << 32 else 8
        n, bucket = len(hashes), table.column("bucket")[0].as_py()
        columns = {
            "part": [*table.column("part").to_pylist(), None],
            "bucket": [bucket] * (n + 1),
            "counts": [*(x.astype(f"<u{width}").tobytes() for x in np.split(total[which], ends)), None],
            "count_width": [width] * (n + 1),
            "topics": [*(x.astype(np.uint8).tobytes() for x in np.split(topic[which], ends)), None],
            "cells": [None] * n + [cells.tolist()],
            "words": [None] * n + [words[cells].tolist()],
            "mass": [None] * n + [mass[cells].tolist()],
            "top": [None] * n + [known[first].view(np.int64).tolist()],
            "top_n": [None] * n + [total[first].tolist()],
            "top_topic": [None] * n + [topic[first].tolist()],
        }
        return pa.table(columns, schema=out)

    dealt = parts.select("part", "hashes", "counts", "topics").mapInArrow(tidy(deal), "part long, bucket int, hashes binary, counts binary, topics binary")
    schema = "part long, bucket int, counts binary, count_width int, topics binary, " + ", ".join(f"{c} array<long>" for c in ("cells", "words", "mass", "top", "top_n", "top_topic"))
    return dealt.groupBy("bucket").applyInArrow(add, schema)


@dataclass
class Vocabulary:
    """What turns a count and a topic into a slot and a probability within it. Fixed size."""

    tokens: int
    words: int
    heads: dict[int, int]  # hash of a word with a slot of its own -> slot
    slot_of_cell: np.ndarray  # topic and bin of counts -> slot, as class * SLOTS + place
    mass: np.ndarray  # per slot, counts plus one each
    unseen: float  # mass of the unseen word, in the last class

    @property
    def bits(self) -> int:
        return int(np.clip(np.log2(max(1, self.words)) - 9, LEAST_BITS, MOST_BITS))

    def place(self, counts: np.ndarray, topics: np.ndarray, at: list[int], head: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each word, and the natural log of its probability within; ``at`` are the places of words with slots of their own.

        The unseen word has the last class's last slot, which no other word is in; its probability is that within the class.
        """
        slot = self.slot_of_cell[topics.astype(np.int64) * BINS + _bin(counts)]
        inner = np.log(counts + 1.0) - np.log(np.maximum(self.mass[slot], 1e-300))
        once, never = counts == 1, counts == 0
        rest = self.mass[ONCE * SLOTS :].sum()
        if rest:
            inner[once] = np.log(rest / 2 / (rest / 2 + self.unseen)) - np.log(self.mass[slot[once]] / 2)
        slot[never], inner[never] = CLASSES * SLOTS - 1, np.log(self.unseen / (rest / 2 + self.unseen))
        slot[at], inner[at] = head, 0.0
        return slot, inner

    def biases(self) -> tuple[np.ndarray, np.ndarray]:
        """Logs of the classes' shares and of the slots' shares in their class; an empty slot has none."""
        mass = self.mass.reshape(CLASSES, SLOTS)
        whole = mass.sum(axis=1)
        whole[ONCE] = whole[ONCE] / 2 + self.unseen
        share = mass / np.maximum(mass.sum(axis=1, keepdims=True), 1e-300)
        log = lambda x: np.where(x > 0, np.log(np.maximum(x, 1e-300)), -1e4).astype(np.float32)
        return log(whole / whole.sum()), log(share)


def make_vocabulary(counted: DataFrame) -> Vocabulary:
    """Slots from the buckets' histograms: their sums, and the commonest words of all."""
    stats = counted.where("part IS NULL")
    sums = stats.select(F.explode(F.arrays_zip("cells", "words", "mass")).alias("s")).groupBy("s.cells").agg(F.sum("s.words").alias("w"), F.sum("s.mass").alias("m"))
    words, mass = np.zeros(TOPICS * BINS, np.int64), np.zeros(TOPICS * BINS, np.int64)
    for r in sums.collect():  # at most TOPICS * BINS rows
        words[r["cells"]], mass[r["cells"]] = r["w"], r["m"]
    top = stats.select(F.explode(F.arrays_zip("top", "top_n", "top_topic")).alias("t")).select("t.top", "t.top_n", "t.top_topic")
    top = top.where("top_n > 1").orderBy(F.desc("top_n"), "top").limit(HEADS).collect()
    return lay_out(words, mass, [(int(np.array([r["top"]], np.int64).view(np.uint64)[0]), r["top_n"], r["top_topic"]) for r in top])


def lay_out(words: np.ndarray, mass: np.ndarray, top: list[tuple[int, int, int]]) -> Vocabulary:
    """Classes of about equal mass: each topic's words from common to rare, cut where the mass reaches a share.

    In a class the common words take a slot each; the bins of the others share what is left.
    """
    total, distinct = int(mass.sum()), int(words.sum())
    left = (words + mass).astype(float)  # add one
    for _, n, g in top:
        left[g * BINS + int(_bin(np.array([n]))[0])] -= n + 1
    left = np.maximum(left, 0).reshape(TOPICS, BINS)
    once = left[:, 0].copy()
    left[:, 0] = 0
    units: list[list[tuple[float, int, int]]] = []  # per topic: mass, head's hash or -1, bin
    for g in range(TOPICS):
        own = [(n + 1.0, h, int(_bin(np.array([n]))[0])) for h, n, t in top if t == g]
        units.append(own + [(left[g, b], -1, b) for b in range(BINS - 1, 0, -1) if left[g, b] > 0])
    whole = np.array([sum(u[0] for u in own) for own in units])
    classes = np.where(whole > 0, 1, 0)
    while classes.sum() < ONCE and whole.any():
        classes[np.argmax(whole / np.maximum(classes, 1e-9) * (whole > 0))] += 1
    slot_of_cell = np.full((TOPICS, BINS), CLASSES * SLOTS - 1)
    sizes, heads, c = np.zeros(CLASSES * SLOTS), {}, 0
    for g, own in enumerate(units):
        todo = own[::-1]
        for k in range(classes[g]):
            share = sum(u[0] for u in todo) / (classes[g] - k)
            alone, bins, full = [], [], 0.0
            while todo and (full + todo[-1][0] / 2 < share or k == classes[g] - 1 or not full):
                if todo[-1][1] >= 0 and len(alone) == SLOTS - 1:
                    if k < classes[g] - 1:
                        break
                    m, _, b = todo.pop()  # no class is left for the topic's head: back to its bin
                    todo = [(u[0] + m, u[1], u[2]) if u[2] == b and u[1] < 0 else u for u in todo] if any(u[2] == b and u[1] < 0 for u in todo) else [(m, -1, b), *todo]
                    continue
                (bins if todo[-1][1] < 0 else alone).append(todo[-1])
                full += todo.pop()[0]
            for place, u in enumerate(alone):
                heads[u[1]] = c * SLOTS + place
                sizes[c * SLOTS + place] = u[0]
            if bins:
                place = len(alone)
                free = SLOTS - place
                middle = np.cumsum([u[0] for u in bins]) - np.array([u[0] for u in bins]) / 2
                for u, to in zip(bins, np.minimum((middle / sum(u[0] for u in bins) * free).astype(int), free - 1), strict=True):
                    slot_of_cell[g, u[2]] = c * SLOTS + place + to
                    sizes[c * SLOTS + place + to] += u[0]
            c += 1
    slot_of_cell[:, 0] = ONCE * SLOTS + np.arange(TOPICS)
    sizes[ONCE * SLOTS : ONCE * SLOTS + TOPICS] = once
    return Vocabulary(total, distinct, heads, slot_of_cell.ravel(), sizes, max(1.0, once.sum() / 2))


def find_heads(parts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``(part, at, head, features)``: where in each part's vocabulary the words are that have a slot of their own, and 32 bits of every word's hash."""
    wanted = np.array(sorted(vocabulary.heads), np.uint64)
    of = np.array([vocabulary.heads[h] for h in wanted.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, head, features = [], [], []
            for hashes in batch.column("hashes").to_pylist():
                h = np.frombuffer(hashes, "<u8")
                features.append((h >> np.uint64(20)).astype("<u4").tobytes())
                place = np.searchsorted(h, wanted)
                hit = h[np.minimum(place, len(h) - 1)] == wanted
                at.append(place[hit].tolist())
                head.append(of[hit].tolist())
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (at, head)]
            yield pa.RecordBatch.from_arrays([batch.column("part"), *lists, pa.array(features, pa.binary())], names=["part", "at", "head", "features"])

    return parts.select("part", "hashes").mapInArrow(tidy(run), "part long, at array<long>, head array<long>, features binary")


def code_parts(parts: DataFrame, counted: DataFrame, vocabulary: Vocabulary, groups: int) -> DataFrame:
    """Parts with each word's slot and feature, in ``groups`` files, and the documents' sums that need no context."""
    deal = lambda df: df.repartition(groups, "part")
    back = deal(counted.where("part IS NOT NULL").select("part", F.struct("bucket", "counts", F.col("count_width").alias("width"), "topics").alias("b")))
    back = back.groupBy("part").agg(F.array_sort(F.collect_list("b")).alias("back"))
    joined = deal(parts.select("part", "ids", "trains", "lengths", "width", "codes")).join(back, "part").join(deal(find_heads(parts, vocabulary)), "part")
    id_type = parts.schema["ids"].dataType.simpleString()
    floor = float(np.log10(vocabulary.tokens + vocabulary.words + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                get = lambda c: row.column(c)[0].as_py()  # noqa: B023, E731
                lengths = np.frombuffer(get("lengths"), "<u4").astype(np.int64)
                back = get("back")
                counts = np.concatenate([np.frombuffer(x["counts"], f"<u{x['width']}").astype(np.int64) for x in back])
                topics = np.frombuffer(b"".join(x["topics"] for x in back), np.uint8)
                slot, inner = vocabulary.place(counts, topics, get("at"), get("head"))
                codes = np.frombuffer(get("codes"), f"<u{get('width')}")
                first = np.cumsum(lengths) - lengths
                add = lambda x: np.add.reduceat(x[codes], first)  # noqa: B023, E731
                columns = [
                    *(row.column(c) for c in ("part", "ids", "trains", "lengths", "width", "codes")),
                    pa.array([np.where(counts >= KNOWN_FEATURE, np.frombuffer(get("features"), "<u4"), slot + 1).astype("<u4").tobytes()], pa.binary()),
                    pa.array([slot.astype("<u2").tobytes()], pa.binary()),
                    pa.array([add(inner)], pa.list_(pa.float64())),
                    pa.array([add(np.log10(counts + 1.0) - floor)], pa.list_(pa.float64())),
                    pa.array([add((counts > 0).astype(np.int64))], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "ids", "trains", "lengths", "width", "codes", "features", "slots", "inner", "base", "n_known"])

    schema = f"part long, ids {id_type}, trains array<boolean>, lengths binary, width int, codes binary, features binary, slots binary, inner array<double>, base array<double>, n_known array<long>"
    return joined.mapInArrow(tidy(run), schema)


def mix(features: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Hashes of the contexts of the tokens from the fourth on, a row for each template; ``position`` is theirs in the text."""
    before = []
    for k in (1, 2, 3):
        prev = features[3 - k : len(features) - k].copy()
        prev[position < k] = 0  # before the text's start
        before.append(prev)
    one, two, three = before
    out = np.stack([one, two, three, one * _U(0x9E3779B1) ^ two, one * _U(0x85EBCA77) ^ three])
    out += (np.arange(FEATURES, dtype=np.uint32) * _U(0x3C6EF372))[:, None]
    out *= _U(0x2C1B3C6D)
    out ^= out >> _U(15)
    return out


def rows_of(mixed: np.ndarray, bits: int) -> np.ndarray:
    return ((mixed * _U(0x297A2D39)) >> _U(32 - bits)).astype(np.int64)


def crossed(mixed: np.ndarray, cls: np.ndarray, bits: int) -> np.ndarray:
    """Rows for the slots' softmax, other ones for every class."""
    out = mixed ^ ((cls.astype(np.uint32) + _U(1)) * _U(0x7FEB352D))
    out *= _U(0x846CA68B)
    out ^= out >> _U(16)
    return rows_of(out, bits)


class Part:
    """The tokens of a coded part, and their contexts batch by batch."""

    def __init__(self, row: pa.RecordBatch) -> None:
        get = lambda c: row.column(c)[0].as_py()
        codes = np.frombuffer(get("codes"), f"<u{get('width')}")
        self.lengths = np.frombuffer(get("lengths"), "<u4").astype(np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.features = np.concatenate((np.zeros(3, np.uint32), np.frombuffer(get("features"), "<u4")[codes]))
        self.slots = np.frombuffer(get("slots"), "<u2")[codes]
        self.position = np.arange(len(codes)) - np.repeat(self.first, self.lengths)
        self.learned = np.repeat(np.array(get("trains"), bool), self.lengths)

    def __len__(self) -> int:
        return len(self.slots)

    def batch(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(mixed, class, place in the class)`` of the tokens a to b."""
        slot = self.slots[a:b].astype(np.int64)
        return mix(self.features[a : b + 3], self.position[a:b]), slot // SLOTS, slot % SLOTS


def logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = np.take(weights[0], rows[0], axis=0, mode="clip")
    part = np.empty_like(z)
    for k in range(1, FEATURES):
        np.take(weights[k], rows[k], axis=0, out=part, mode="clip")
        z += part
    z += bias
    return np.minimum(z, 60, out=z)  # exp stays finite


def _descend(weights: np.ndarray, square: np.ndarray, touched: np.ndarray, bias: np.ndarray, rows: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One AdaGrad step on a batch of tokens, in place."""
    z = logits(weights, bias, rows)
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], np.float32))[:, None]
    z[np.arange(len(target)), target] -= 1
    columns = np.ascontiguousarray(z.T)
    size = weights.shape[1]
    gradient = np.empty((size, z.shape[1]), np.float32)
    for k in range(FEATURES):
        for c, column in enumerate(columns):
            gradient[:, c] = np.bincount(rows[k], weights=column, minlength=size)
        touched[k] += np.bincount(rows[k], minlength=size)
        square[k] += gradient * gradient
        gradient /= np.sqrt(square[k] + np.float32(PRIOR))
        weights[k] -= np.float32(rate) * gradient


Model = tuple[np.ndarray, np.ndarray]  # weights of the classes and of the slots: templates, rows, outcomes


def blank(bits: int) -> Model:
    return np.zeros((FEATURES, 1 << bits, CLASSES), np.float32), np.zeros((FEATURES, 1 << bits, SLOTS), np.float32)


def learn(parts: Iterator[Part], start: Model, biases: tuple[np.ndarray, np.ndarray], batch: int, rate: float = RATE) -> tuple[Model, list[np.ndarray]]:
    """Weights after one pass over the parts' training tokens, and how often each row was touched."""
    bits = start[0].shape[1].bit_length() - 1
    own = tuple(w.astype(np.float32) for w in start)
    square = [np.zeros_like(w) for w in own]
    touched = [np.zeros(w.shape[:2], np.int64) for w in own]
    flat = biases[1]
    for part in parts:
        for a in range(0, len(part), batch):
            b = min(len(part), a + batch)
            on = part.learned[a:b]
            if not on.any():
                continue
            mixed, cls, place = part.batch(a, b)
            mixed, cls, place = mixed[:, on], cls[on], place[on]
            _descend(own[0], square[0], touched[0], biases[0], rows_of(mixed, bits), cls, rate)
            _descend(own[1], square[1], touched[1], flat[cls], crossed(mixed, cls, bits), place, rate)
    return own, touched


def score_part(part: Part, model: Model, biases: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Natural logs of the probabilities of each token's slot."""
    bits = model[0].shape[1].bit_length() - 1
    ones = np.ones(CLASSES, np.float32)
    out = np.empty(len(part))
    for a in range(0, len(part), MOST_BATCH):
        b = min(len(part), a + MOST_BATCH)
        mixed, cls, place = part.batch(a, b)
        at = np.arange(b - a)
        z = logits(model[0], biases[0], rows_of(mixed, bits))
        out[a:b] = z[at, cls] - np.log(np.exp(z, out=np.empty_like(z)) @ ones)
        seen = np.flatnonzero(part.slots[a:b] != CLASSES * SLOTS - 1)  # the unseen word is none of its class's slots
        z = logits(model[1], biases[1][cls[seen]], crossed(mixed[:, seen], cls[seen], bits))
        out[a + seen] += z[np.arange(len(seen)), place[seen]] - np.log(np.exp(z, out=np.empty_like(z)) @ ones)
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Part(batch.slice(i, 1))


def train(coded: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, rate: float = RATE, groups: int = 1 << 30) -> Model:
    """Weights, by rounds of local AdaGrad and averaging, each of at most ``groups`` tasks; every part is used once."""
    biases, context = vocabulary.biases(), coded.sparkSession.sparkContext
    start = blank(vocabulary.bits)
    rows = start[0].shape[0] * start[0].shape[1]
    tall = 2 * rows // BLOCKS  # rows of both tables to a block
    group = min(GROUP_TOKENS, max(1, vocabulary.tokens))
    batch = int(np.clip(group // rounds // STEPS, LEAST_BATCH, MOST_BATCH))
    shape = start[0].shape

    for r in range(rounds):
        shared = context.broadcast(np.concatenate([w.reshape(rows, -1) for w in start]).astype(np.float16))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            base = shared.value.astype(np.float32)
            own, touched = learn(_parts(batches), (base[:rows].reshape(shape), base[rows:].reshape(shape)), biases, batch, rate)
            change = np.concatenate([w.reshape(rows, -1) for w in own]) - base
            counts = np.concatenate([t.ravel() for t in touched])
            for block in range(BLOCKS):
                on = block * tall + np.flatnonzero(counts[block * tall : (block + 1) * tall])
                if len(on):
                    fields = [(on - block * tall).astype("<u4"), change[on].astype("<f2"), counts[on].astype("<u4")]
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in fields)], names=["block", "rows", "change", "touched"])

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for part in batches:
                for block, at, change, touched in zip(*(part.column(c).to_pylist() for c in ("block", "rows", "change", "touched")), strict=True):
                    own = sums.setdefault(block, np.zeros((tall, SLOTS + 1)))
                    at, n = np.frombuffer(at, "<u4"), np.frombuffer(touched, "<u4").astype(float)
                    own[at, :SLOTS] += np.frombuffer(change, "<f2").reshape(len(n), -1) * n[:, None]
                    own[at, SLOTS] += n
            for block, own in sums.items():
                mean = (own[:, :SLOTS] / np.maximum(own[:, SLOTS:], 1)).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([mean.tobytes()], pa.binary())], names=["block", "change"])

        some = coded.where(F.pmod(F.xxhash64("part"), F.lit(rounds)) == r).select("trains", "lengths", "width", "codes", "features", "slots")
        changes = some.coalesce(groups).mapInArrow(tidy(run), "block int, rows binary, change binary, touched binary")
        changes = changes.repartition(BLOCKS, "block").mapInArrow(tidy(total), "block int, change binary")
        step = np.zeros((BLOCKS, tall, SLOTS), np.float32)
        for row in changes.collect():  # as many rows as blocks, of fixed size
            step[row["block"]] = np.frombuffer(row["change"], "<f4").reshape(tall, SLOTS)
        step = step.reshape(2, *shape)
        start = (start[0] + step[0], start[1] + step[1])
        shared.unpersist()
    return start


def score_parts(coded: DataFrame, vocabulary: Vocabulary, model: Model) -> DataFrame:
    """One row per document: ``id, trains, n_tokens, n_known, base_score, score``."""
    biases = vocabulary.biases()
    shared = coded.sparkSession.sparkContext.broadcast(tuple(w.astype(np.float16) for w in model))
    id_type = coded.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tuple(w.astype(np.float32) for w in shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                part = Part(row)
                inner = row.column("inner").flatten().to_numpy()
                score = (np.add.reduceat(score_part(part, own, biases), part.first) + inner) / np.log(10)
                flat = [row.column(c).flatten() for c in ("ids", "trains", "n_known", "base")]
                yield pa.RecordBatch.from_arrays([flat[0], flat[1], pa.array(part.lengths), flat[2], flat[3], pa.array(score)], names=["id", "trains", "n_tokens", "n_known", "base_score", "score"])

    return coded.mapInArrow(tidy(run), f"id {id_type}, trains boolean, n_tokens long, n_known long, base_score double, score double")


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", trains: Column | None = None) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``.

    Learns from the rows where ``trains`` holds (by default those of :func:`learns_from`). Tokens
    are the words, A-Z lower-cased, and an end; null and empty texts are an end alone. Scores
    are log10 probabilities of whole texts, ``base_score`` under the add-one unigram. With
    nothing to learn from every score is 0. Repeated rows and null ids are rows like any other;
    a very long text is a part of its own, whose contexts are made batch by batch. Other columns
    are not looked at, whatever their names; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    trains = learns_from(id_col) if trains is None else trains
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(trains, F.lit(False)).alias("trains"))
    parts = materialize(tokenize(docs, fit_topics(docs)), "parts", compression="zstd")
    counted = materialize(count_words(parts), "counts", compression="zstd")
    vocabulary = make_vocabulary(counted)
    groups = -(-(parts.agg(F.sum("tokens")).first()[0] or 1) // GROUP_TOKENS)
    coded = materialize(code_parts(parts, counted, vocabulary, groups), "coded", compression="zstd")
    discard(parts)
    discard(counted)
    model = train(coded, vocabulary, groups=groups)
    return score_parts(coded, vocabulary, model).select(
        "id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
