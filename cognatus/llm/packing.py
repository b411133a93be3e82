"""Packing tokenized documents into windows by non-negative least squares.

A document is cut into whole windows, one main piece that is a multiple of ``step`` tokens and
a tail shorter than ``step``. All combinations of up to ``depth`` main lengths that fill a
window exactly are enumerated; non-negative least squares finds how often to repeat each so
that together they use up the histogram of main lengths. Repeat counts are rounded down. What
they leave is packed greedily: by the longest pieces first, as long as windows fill exactly,
and the rest end to end, cut at window borders (say, where a third of all documents are copies
of one length). Tails, whose ids travel with them, are laid end to end as well.

Scale: the text is read and tokenized once, and never shuffled. Each scan task numbers its
pieces per length; a small table of counts per task and length gives every piece its global
rank, and the plan, of at most a few hundred rows whatever the input, maps rank to sequence
and offset. The driver sees the histogram only (one row per length).
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cognatus.llm.text import ragged, slices, small_batches, split_words, tidy
from cognatus.session import materialize

#: Words whose ids a worker remembers.
CACHE = 500_000
#: Scripts from here on may hold letters that one Unicode version knows and another does not.
LATER = "\u0590"
#: Bytes of text handled at a time.
SLICE = 8 << 20


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _lean_tokenizer(path: str):
    """The same merges for words of letters that normalizing would not change."""
    from tokenizers import Tokenizer

    config = json.loads(_tokenizer(path).to_str())
    config["normalizer"] = None
    bytes_of = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    config["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, bytes_of]}
    return Tokenizer.from_str(json.dumps(config))


class WordIds:
    """Token ids by white-space-delimited word, for tokenizers that drop white space.

    Unknown words are encoded many at a time with a mark of a single id between them, which
    costs less than a call for each.
    """

    MARK = "\u0001"

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        self.mark = self._encode([self.MARK])[0]
        letters = "abcdefghijklmnopqrstuvwxyz"
        lower, upper = self._encode([letters, letters.upper()])
        self.folds_case = np.array_equal(lower, upper)
        signs = {x: self._encode([x, letters + x]) for x in ".,"}
        sample = f"{letters} {self.MARK} \u00e9t\u00e9"
        lean = _lean_tokenizer(path)
        self.lean = lean if lean.encode(sample, add_special_tokens=False).ids == self._encode([sample])[0].tolist() else None
        self.signs = {x: one for x, (one, both) in signs.items() if len(one) == 1 and np.array_equal(both, np.append(lower, one))}
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _several(self, words: list[str], letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """Concatenated ids of the words, and how many each has. ``letters``: they are lower-case letters only."""
        if len(self.mark) == 1:
            text = f" {self.MARK} ".join(words)
            if letters and self.lean and unicodedata.is_normalized("NFC", text):
                ids = np.array(self.lean.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            else:
                ids = self._encode([text])[0]
            is_mark = ids == self.mark[0]
            cuts = np.flatnonzero(is_mark)
            if len(cuts) == len(words) - 1:
                return ids[~is_mark], np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1
        each = self._encode(words)  # a word holds the mark itself
        return np.concatenate(each), np.array([len(x) for x in each])

    def _look_up(self, words: list[str]) -> np.ndarray:
        """Place and number of each word's ids in ``flat``, packed into one integer."""
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > CACHE:
            self._clear()
            known, new = self.known, words
        alike = [[], []]
        for w in new:
            alike[w.isalpha() and w.islower() and (w.isascii() or max(w) < LATER)].append(w)
        for some, letters in [(x[at : at + 1000], k) for k, x in enumerate(alike) for at in range(0, len(x), 1000)]:
            ids, lengths = self._several(some, bool(letters))
            end = self.used + len(ids)
            if end > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(end, len(self.flat)), np.uint32)])
            self.flat[self.used : end] = ids
            starts = self.used + np.cumsum(lengths) - lengths
            known.update(zip(some, (starts << 32 | lengths).tolist(), strict=True))
            self.used = end
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(flat, starts, lengths)``: word i has the ids ``flat[starts[i] : starts[i] + lengths[i]]``.

        Where the tokenizer splits a full stop or comma from the letter before it, the words with
        and without it share an entry.
        """
        mark = np.zeros(len(words), np.uint32)
        stems = words
        for sign, ids in self.signs.items():
            ends = pc.match_substring_regex(words, f"[a-z][{sign}]$")
            mark[ends.to_numpy(zero_copy_only=False)] = ids[0] + 1
            stems = pc.if_else(ends, pc.utf8_slice_codeunits(words, 0, -1), stems)
        coded = stems.dictionary_encode()
        packed = self._look_up(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        if not mark.any():
            return self.flat, packed >> 32, packed & 0xFFFFFFFF
        lengths = packed & 0xFFFFFFFF
        longer = lengths + (mark > 0)
        ends = np.cumsum(longer)
        flat = np.empty(int(ends[-1]), np.uint32)
        flat[ragged(ends - longer, lengths)] = self.flat[ragged(packed >> 32, lengths)]
        flat[ends[mark > 0] - 1] = mark[mark > 0] - 1
        return flat, ends - longer, longer


def token_rows(
    docs: DataFrame, tokenizer_path: str, window: int, step: int, end_id: int, id_col: str, text_col: str, keep_ids: bool
) -> DataFrame:
    """One row per document: its length, its pieces' checksums, and its ranks within the task."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["doc", "part", "n", "fulls", "full_at", "cls", "rank", "tail", "tail_at", "crcs", "steps", "ids"]
    schema = f"doc {id_type}, part int, n long, fulls long, full_at long, cls int, rank long, tail binary, tail_at long, crcs array<long>, steps array<long>, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordIds(tokenizer_path)
        part = TaskContext.get().partitionId()
        ranks, full_at, tail_at = Counter(), 0, 0
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                # case does not matter to the tokenizer, but for the names of special tokens
                plain = not pc.any(pc.match_substring(piece.column("text"), "<|")).as_py()
                codes, words, offsets = split_words(piece.column("text"), "ascii" if plain and encode.folds_case else None)
                flat, first, length = encode(words)
                rows: dict[str, list] = {k: [] for k in names[2:]}
                for d in range(piece.num_rows):
                    own = codes[offsets[d] : offsets[d + 1]]
                    ids = np.append(flat[ragged(first[own], length[own])], np.uint32(end_id)).astype("<u4")
                    n = len(ids)
                    fulls, rest = divmod(n, window)
                    cls = rest // step
                    cuts = [*range(0, fulls * window + 1, window), fulls * window + cls * step]
                    crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
                    tail = ids[cuts[-1] :]
                    main = memoryview(ids[fulls * window : cuts[-1]].tobytes())
                    steps = [zlib.crc32(main[a : a + 4 * step]) for a in range(0, len(main), 4 * step)]
                    for k, v in zip(names[2:], (n, fulls, full_at, cls, ranks[cls], tail.tobytes(), tail_at, crcs, steps, ids.tobytes() if keep_ids else None), strict=True):
                        rows[k].append(v)
                    full_at += fulls
                    ranks[cls] += 1
                    tail_at += len(tail)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
                arrays = [piece.column("id"), pa.array(np.full(piece.num_rows, part, np.int32))]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(rows[k], t) for k, t in zip(names[2:], types, strict=True)], names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), schema)


def join_crcs(parts: list[int], size: int) -> int:
    """Checksum of parts of ``size`` bytes each, one after another, from theirs.

    Going on from a checksum is linear in it: over zeros it tells what the bytes so far become.
    """
    zeros = bytes(size)
    empty, out = zlib.crc32(zeros), parts[0]
    for crc in parts[1:]:
        out = zlib.crc32(zeros, out) ^ empty ^ crc
    return out


def combinations(width: int, depth: int, least: int = 1, most: int | None = None) -> list[tuple[int, ...]]:
    """All multisets of up to ``depth`` lengths, as non-increasing tuples, that add up to ``width``."""
    most = width if most is None else most
    out = [(width,)] if least <= width <= most else []
    if depth > 1:
        for first in range(min(most, width - least), 0, -1):
            if first * depth < width:
                break
            out += [(first, *rest) for rest in combinations(width - first, depth - 1, least, first)]
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """``argmin |a x - b|`` over ``x >= 0``, by the active-set method of Lawson and Hanson."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tiny = 1e-9 * max(1.0, float(np.abs(b).max(initial=0.0)))
    for _ in range(rounds):
        gain = np.where(passive, -np.inf, a.T @ (b - a @ x))
        j = int(gain.argmax())
        if gain[j] <= tiny:
            break
        passive[j] = True
        while True:
            on = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[on] = s
                break
            bad = s <= 0
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(bad, x[on] / (x[on] - s), np.inf)
            move = float(np.nanmin(ratio))
            x[on] += move * (s - x[on])
            passive[on[(x[on] <= tiny * 1e-3) & bad]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


@dataclass
class Slot:
    """Pieces of one length from rank ``first`` on: ``each`` per sequence, from sequence ``sequence`` on.

    If ``each`` is 0 they lie end to end from step ``start`` on, counted from that sequence's beginning.
    """

    cls: int
    first: int
    count: int
    each: int
    sequence: int
    start: int


def plan_slots(histogram: dict[int, int], width: int, depth: int) -> tuple[list[Slot], int]:
    """Slots for all main pieces (lengths in steps, windows of ``width`` steps), and the sequences used.

    A sequence holds one pattern, which fills it exactly, or a stretch of the rest.
    """
    left = {c: n for c, n in histogram.items() if c > 0 and n > 0}
    patterns: list[tuple[tuple[int, ...], int]] = []
    combos = [c for c in combinations(width, depth, most=width - 1) if all(x in left for x in c)]
    if combos:
        rows = sorted(left)
        at = {c: i for i, c in enumerate(rows)}
        a = np.zeros((len(rows), len(combos)))
        for j, combo in enumerate(combos):
            for c in combo:
                a[at[c], j] += 1
        for j, x in enumerate(nnls(a, np.array([left[c] for c in rows], float))):
            uses = Counter(combos[j])
            repeats = min([int(x), *(left[c] // m for c, m in uses.items())])
            if repeats > 0:
                patterns.append((combos[j], repeats))
                for c, m in uses.items():
                    left[c] -= m * repeats
    while any(left.values()):
        room, pattern = width, []
        for c in sorted(left, reverse=True):
            take = min(left[c], room // c)
            pattern += [c] * take
            room -= take * c
        if room:
            break
        uses = Counter(pattern)
        repeats = min(left[c] // m for c, m in uses.items())
        patterns.append((tuple(pattern), repeats))
        for c, m in uses.items():
            left[c] -= m * repeats
    slots, used, sequence = [], Counter(), 0
    for pattern, repeats in patterns:
        start = 0
        for c, m in sorted(Counter(pattern).items(), reverse=True):
            slots.append(Slot(c, used[c], m * repeats, m, sequence, start))
            used[c] += m * repeats
            start += m * c
        sequence += repeats
    start = 0
    for c, n in sorted(left.items(), reverse=True):
        if n:
            slots.append(Slot(c, used[c], n, 0, sequence, start))
            start += n * c
    return slots, sequence - (-start // width)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    window: int = 2048,
    step: int = 32,
    depth: int = 3,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents, with their sequences.

    Columns: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, with
    ``keep_ids``, ``ids array<int>``. Each id of a document, the end id included, lies in one
    piece; a sequence's pieces lie gapless from offset 0. A null or empty text is its end id
    alone. Repeated rows and null ids are rows like any other; a very long text is cut into whole windows
    and a rest. Other columns are not looked at, whatever their names; an empty table gives no pieces.
    The tokenizer must drop white space, for its ids are looked up word by word.
    """
    if window % step:
        raise ValueError("window must be a multiple of step")
    width = window // step
    rows = materialize(token_rows(docs, tokenizer_path, window, step, end_id, id_col, text_col, keep_ids), "tokens")
    per_class = rows.groupBy("part", "cls").agg(F.count(F.lit(1)).alias("n"))
    per_part = rows.groupBy("part").agg(F.sum("fulls").alias("fulls"), F.sum(F.octet_length("tail") / 4).cast("long").alias("tails"))
    histogram = {r["cls"]: r["n"] for r in per_class.groupBy("cls").agg(F.sum("n").alias("n")).collect()}
    fulls = per_part.agg(F.coalesce(F.sum("fulls"), F.lit(0))).first()[0]
    slots, mains = plan_slots(histogram, width, depth)
    by_class: dict[int, list[Slot]] = {}
    for s in slots:
        by_class.setdefault(s.cls, []).append(s)
    firsts = {c: np.array([s.first for s in x]) for c, x in by_class.items()}
    tails_from = fulls + mains

    before = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    class_from = per_class.select("part", "cls", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_from"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    part_from = per_part.select("part", F.coalesce(F.sum("fulls").over(before), F.lit(0)).alias("full_from"), F.coalesce(F.sum("tails").over(before), F.lit(0)).alias("tail_from"))
    placed = rows.join(class_from, ["part", "cls"]).join(part_from, "part").select(
        "doc", "n", "fulls", (F.col("full_at") + F.col("full_from")).alias("full_at"), "cls", (F.col("rank") + F.col("rank_from")).alias("rank"),
        "tail", (F.col("tail_at") + F.col("tail_from")).alias("tail_at"), "crcs", "steps", "ids",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_of, out, ids_out = [], [], []

            def put(d: int, start: int, length: int, crc: int, n: int, sequence: int, offset: int, ids: bytes | None) -> None:
                docs_of.append(d)
                out.append((start, length, crc, n, sequence, offset))
                ids_out.append(None if ids is None else np.frombuffer(ids, "<u4")[start : start + length].astype(np.int32))

            for d, r in enumerate(batch.drop_columns(["doc"]).to_pylist()):
                n, ids, crcs, cls = r["n"], r["ids"], r["crcs"], r["cls"]
                for k in range(r["fulls"]):
                    put(d, k * window, window, crcs[k], n, r["full_at"] + k, 0, ids)
                at = r["fulls"] * window
                if cls:
                    slot = by_class[cls][int(np.searchsorted(firsts[cls], r["rank"], side="right")) - 1]
                    if slot.each:
                        turn, place = divmod(r["rank"] - slot.first, slot.each)
                        put(d, at, cls * step, crcs[-1], n, fulls + slot.sequence + turn, (slot.start + place * cls) * step, ids)
                    else:
                        lies, done = slot.start + (r["rank"] - slot.first) * cls, 0
                        while done < cls:
                            sequence, offset = divmod(lies + done, width)
                            take = min(cls - done, width - offset)
                            crc = join_crcs(r["steps"][done : done + take], 4 * step)
                            put(d, at + done * step, take * step, crc, n, fulls + slot.sequence + sequence, offset * step, ids)
                            done += take
                    at += cls * step
                tail, pos, done = r["tail"], r["tail_at"], 0
                while done < len(tail) // 4:
                    sequence, offset = divmod(pos + done, window)
                    take = min(len(tail) // 4 - done, window - offset)
                    put(d, at + done, take, zlib.crc32(tail[4 * done : 4 * (done + take)]), n, tails_from + sequence, offset, ids)
                    done += take
            columns = [pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 6)]
            arrays = [batch.column("doc").take(pa.array(docs_of, pa.int64())), *columns]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if keep_ids:
                arrays, names = [*arrays, pa.array(ids_out, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(tidy(run), schema + (", ids array<int>" if keep_ids else ""))
