"""Main text of web pages, with host suffix arrays against repeated boilerplate.

The blocks of every page are read in one pass, each with what its place tells: outside the
article, open to doubt, or of a marked article. The token streams of all blocks of a host are
searched for runs of at least ``least`` tokens that distinct pages repeat. An open block loses each run
that another page of the host has anywhere, and goes if it is shorter and recurs whole. An
article keeps passages that articles share; it loses runs that stand outside articles on most of the
host's pages, which are the host's furniture wherever they stand. Unique runs are the text. Pages
with equal text are copies and count as one page, so copies erase nothing of each other.

The array is dealt out by its suffixes' first ``least`` tokens: of the grams in these the least hash
is the suffix's *anchor*, so suffixes that agree in them have one anchor, and neighbours share theirs
(minimizers). Anchors are counted first, with map-side combine. Only those that can matter go on, with the
stretch of tokens whose suffixes they stand for; equal stretches are merged and counted, and tasks
of up to about ``shard`` stretches sort the suffixes. Which task sorts a suffix changes nothing.

Scale: a page is parsed once. A run that a third of all pages have is a row a task in both counts. No
host is a group: a hot host's anchors lie in as many tasks as others. Tables of anchors, stretches
and cuts join by broadcast only while their files are small, as the planner measures them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cognatus.llm.htmltext import ARTICLE, OPEN, OUTSIDE, read_page
from cognatus.llm.text import ragged, slices, small_batches, tidy
from cognatus.session import discard, materialize

LEAST = 10
#: Tokens of the grams that anchors are chosen among.
GRAM = 4
#: Stretches whose suffixes a task sorts, about.
SHARD = 1 << 16
#: Furniture stands on so many pages of the host at least, and on more than half of them.
FURNITURE = 5
_ODD = 0x9E3779B97F4A7C15


def host_of(url: Column | str) -> Column:
    """Lower-cased host of a URL, without user and port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[^/?#]*//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix by its first ``depth`` tokens; suffixes that agree there share a rank."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    done = 1
    while done < depth:
        step = min(done, depth - done)
        after = np.full(len(rank), -1, np.int64)
        after[: len(rank) - step] = rank[step:]
        pair = (rank << 32) | (after + 1)
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        done += step
    return rank


def recurring(tokens: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
    """Which suffixes' first ``depth`` tokens are found on two pages or more.

    Negative tokens are separators, each of which is its own; no run reaches over one. ``low`` and
    ``high`` are the least and greatest page that a token's stretch stands on.
    """
    n = len(tokens)
    if n < depth:
        return np.zeros(n, bool)
    stop = np.flatnonzero(tokens < 0)
    tokens = tokens.copy()
    tokens[stop] = tokens.max() + 1 + np.arange(len(stop))
    order = np.argsort(rank := suffix_ranks(tokens, depth), kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(rank[order]) != 0)))
    apart = np.minimum.reduceat(low[order], first) != np.maximum.reduceat(high[order], first)
    out = np.empty(n, bool)
    out[order] = np.repeat(apart, np.diff(np.append(first, n)))
    out[n - depth + 1 :] = False
    return out


def repeated(tokens: np.ndarray, page: np.ndarray, depth: int) -> np.ndarray:
    """Which tokens lie in a run of ``depth`` tokens found on two pages or more."""
    starts = np.zeros(len(tokens) + 1, np.int64)
    begin = np.flatnonzero(recurring(tokens, page, page, depth))
    np.add.at(starts, begin, 1)
    np.add.at(starts, begin + depth, -1)
    return np.cumsum(starts[:-1]) > 0


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def stretches(blocks: pa.Array, salt: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(block, start, length, anchor, words)``: maximal stretches of tokens whose suffixes share an anchor.

    A stretch of n tokens stands for its n - least + 1 suffixes; a block of fewer tokens is a stretch
    whole, with an anchor of its own kind. ``start`` and ``length`` are in tokens of the block; ``words`` are the
    32-bit hashes of all tokens, block after block. ``salt`` keeps hosts' anchors apart.
    """
    lists = pc.split_pattern(blocks, " ")
    coded = lists.flatten().dictionary_encode()
    digests = np.array([xxhash.xxh64_intdigest(w.as_buffer()) for w in coded.dictionary], np.uint64)
    t = digests[coded.indices.to_numpy(zero_copy_only=False)]
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    size, n = np.diff(offsets), len(t)
    gram = min(GRAM, least)
    block = np.repeat(np.arange(len(size)), size)
    padded = np.concatenate((t, np.zeros(least, np.uint64)))
    g = np.zeros(n + least - gram, np.uint64)
    for k in range(gram):
        g[:n] += padded[k : k + n] * np.uint64(pow(_ODD, k + 1, 1 << 64))
    g[:n] = _mixed(g[:n] ^ salt[block])
    best, at = g[:n].copy(), np.arange(n)
    for k in range(1, least - gram + 1):
        better = g[k : k + n] <= best
        best[better], at[better] = g[k : k + n][better], np.flatnonzero(better) + k
    s = np.flatnonzero(np.arange(n) + least <= offsets[1:][block]) if n else np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate(([True], (at[s][1:] != at[s][:-1]) | (block[s][1:] != block[s][:-1])))) if len(s) else s
    count = np.diff(np.append(new, len(s)))
    short = np.flatnonzero((size < least) & (size > 0))
    whole = np.zeros(len(short), np.uint64)
    for k in range(least - 1):
        here = size[short] > k
        whole[here] += t[offsets[short][here] + k] * np.uint64(pow(_ODD, k + 1, 1 << 64))
    whole = _mixed(whole ^ salt[short] ^ np.uint64(0x5851F42D4C957F2D) ^ size[short].astype(np.uint64))
    of = np.concatenate((block[s[new]], short))
    start = np.concatenate((s[new], offsets[short])) - offsets[of]
    length = np.concatenate((count + least - 1, size[short]))
    return of, start, length, np.concatenate((best[s[new]], whole)), (t >> np.uint64(32)).astype("<u4")


def _parsed(rows: DataFrame, id_type: str) -> DataFrame:
    """``(row, id, url, host, page, blocks, kinds)``; ``page`` is a hash of the host and the text that may be kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, "html"):
                found = [read_page(x) for x in piece.column("html").to_pylist()]
                hosts = [xxhash.xxh64_intdigest(h.encode()) for h in piece.column("host").to_pylist()]
                own = ["\n".join(b for b, x in zip(p.blocks, p.kinds, strict=True) if x != OUTSIDE) or "\n".join(p.blocks) for p in found]
                page = [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), h) for x, h in zip(own, hosts, strict=True)]
                arrays = [
                    pa.array(range(task << 33 | k, (task << 33 | k) + len(found)), pa.int64()),
                    piece.column("id"),
                    piece.column("url"),
                    pa.array(np.array(hosts, np.uint64).view(np.int64)),
                    pa.array(np.array(page, np.uint64).view(np.int64)),
                    pa.array([p.blocks for p in found], pa.list_(pa.string())),
                    pa.array([bytes(p.kinds) for p in found], pa.binary()),
                ]
                k += len(found)
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "id", "url", "host", "page", "blocks", "kinds"])

    return rows.mapInArrow(tidy(run), f"row long, id {id_type}, url string, host long, page long, blocks array<string>, kinds binary")


def _flat(piece: pa.RecordBatch, least: int) -> tuple[np.ndarray, ...]:
    """``(page, j, kind, start, length, anchor, words, begin)`` of the stretches of all blocks; begin is that of a stretch among the words."""
    lists = piece.column("blocks")
    sizes = np.diff(lists.offsets.to_numpy())
    page = np.repeat(np.arange(piece.num_rows), sizes)
    j = np.arange(len(page)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kinds = np.frombuffer(b"".join(piece.column("kinds").to_pylist()), np.uint8)
    blocks = lists.flatten()
    of, start, length, anchor, words = stretches(blocks, piece.column("host").to_numpy().view(np.uint64)[page], least)
    tokens = pc.add(pc.count_substring(blocks, " "), 1).to_numpy(zero_copy_only=False)
    return page[of], j[of], kinds[of], start, length, anchor, words, (np.cumsum(tokens) - tokens)[of] + start


def _by_size(batch: pa.RecordBatch, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Slices of about so many blocks."""
    ends = np.cumsum(pc.list_value_length(batch.column("blocks")).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _anchors(parsed: DataFrame, least: int) -> DataFrame:
    """``(anchor)`` of stretches that may cost a page something: on two rows, in an open block or both in an article and outside one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _by_size(batch):
                page, _, kind, _, _, anchor, _, _ = _flat(piece, least)
                order = np.lexsort((anchor, page))
                page, anchor, flag = page[order], anchor[order], np.left_shift(1, kind[order].astype(np.int32))
                first = np.flatnonzero(np.concatenate(([True], (page[1:] != page[:-1]) | (anchor[1:] != anchor[:-1])))) if len(page) else order
                flag = np.bitwise_or.reduceat(flag, first) if len(first) else flag
                rows = piece.column("row").to_numpy()[page[first]]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[first].view(np.int64)), pa.array(rows), pa.array(flag.astype(np.int32))], names=["anchor", "row", "flag"])

    # rows, not pages: copies pass here and are told later, and numbers of rows travel in fewer bytes than hashes
    found = parsed.select("row", "host", "blocks", "kinds").mapInArrow(tidy(run), "anchor long, row long, flag int")
    flags = F.bit_or("flag").alias("flag")
    found = found.groupBy("anchor").agg(F.min("row").alias("low"), F.max("row").alias("high"), flags).where("low <> high")
    has = lambda kind: F.col("flag").bitwiseAND(F.lit(1 << kind)) != 0
    return found.where(has(OPEN) | (has(ARTICLE) & has(OUTSIDE))).select("anchor")


def _occurrences(parsed: DataFrame, least: int) -> DataFrame:
    """``(anchor, run, host, page, row, j, kind, start)`` of all stretches; ``run`` holds the tokens' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _by_size(batch):
                page, j, kind, start, length, anchor, words, begin = _flat(piece, least)
                raw = words[ragged(begin, length)].tobytes()
                ends = np.concatenate(([0], np.cumsum(4 * length))).astype(np.int32)
                runs = pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
                take = piece.select(["host", "page", "row"]).take(pa.array(page))
                arrays = [pa.array(anchor.view(np.int64)), runs, *take.columns, *(pa.array(x.astype(np.int32)) for x in (j, kind, start))]
                yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "run", "host", "page", "row", "j", "kind", "start"])

    return parsed.select("host", "page", "row", "blocks", "kinds").mapInArrow(tidy(run), "anchor long, run binary, host long, page long, row long, j int, kind int, start int")


def _gone(found: DataFrame, parsed: DataFrame, least: int, shard: int) -> DataFrame:
    """``(anchor, run, suffixes, furniture)`` of the stretches of ``found`` that cost something: which of their suffixes recur, as bits."""
    outside = F.when(F.col("kind") == OUTSIDE, F.col("page"))
    each = found.groupBy("host", "anchor", "run", "page").agg(F.min(outside).alias("outside"))
    runs = each.groupBy("host", "anchor", "run").agg(F.min("page").alias("low"), F.max("page").alias("high"), F.count("outside").alias("n"))
    pages = parsed.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    runs = materialize(runs.join(pages, "host"), "stretches")
    tasks = max(1, -(-runs.count() // shard))

    def sort(table: pa.Table) -> pa.Table:
        raw = table.column("run").to_pylist()
        length = np.array([len(x) // 4 for x in raw])
        anchor, low, high = (table.column(c).to_numpy() for c in ("anchor", "low", "high"))
        ends = np.cumsum(length + 1)
        first = ends - length - 1
        stream = np.full(int(ends[-1]), -1, np.int64)
        stream[ragged(first, length)] = np.frombuffer(b"".join(raw), "<u4")
        # an anchor is of one host; its name keeps equal tokens of other hosts apart
        stream = np.where(stream < 0, -1, np.repeat(np.unique(anchor, return_inverse=True)[1], length + 1) << 32 | stream)
        hit = recurring(stream, np.repeat(low, length + 1), np.repeat(high, length + 1), least)
        bits = np.zeros(len(raw), np.int64)
        for k in range(least):
            on = length - least >= k
            bits[on] |= hit[first[on] + k].astype(np.int64) << k
        bits[(length < least) & (low != high)] = 1
        n, pages = table.column("n").to_numpy(), table.column("pages").to_numpy()
        furniture = (n >= FURNITURE) & (2 * n > pages)
        on = pa.array((bits > 0) | furniture)
        return pa.table([table.column("anchor"), table.column("run"), pa.array(bits), pa.array(furniture)], names=["anchor", "run", "suffixes", "furniture"]).filter(on)

    dealt = runs.withColumn("task", F.pmod(F.xxhash64("anchor"), F.lit(tasks)).cast("int"))
    return dealt.groupBy("task").applyInArrow(sort, "anchor long, run binary, suffixes long, furniture boolean")


def main_texts(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, shard: int = SHARD
) -> DataFrame:
    """``(id, url, text)`` for every row of ``pages``.

    Null html has an empty text; a null or odd URL belongs to the empty host. Rows that repeat a
    page, and pages with equal text, are rows, but count as one page when runs are looked for. Blocks
    stand in page order, joined by line feeds, and so do the runs left of a block. Very long pages are
    read like others, one at a time. Other columns are not looked at, whatever their names. An empty
    table gives no rows. ``shard`` bounds what a task sorts and changes no text.
    """
    small_batches(pages.sparkSession)
    id_type = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    parsed = materialize(_parsed(rows.withColumn("host", host_of("url")), id_type), "pages", compression="zstd")
    anchors = materialize(_anchors(parsed, least), "anchors")
    found = materialize(_occurrences(parsed, least).join(anchors, "anchor", "left_semi"), "occurrences")
    gone = materialize(_gone(found, parsed, least, shard), "gone")
    size = F.octet_length("run") / 4
    hits = found.where(F.col("kind") != OUTSIDE).join(gone, ["anchor", "run"])
    hits = hits.where(((F.col("kind") == OPEN) & (F.col("suffixes") > 0)) | ((F.col("kind") == ARTICLE) & F.col("furniture")))
    bits = F.when(F.col("kind") == OPEN, F.col("suffixes")).otherwise(F.lit(-1).cast("long"))
    cuts = hits.groupBy("row").agg(F.collect_list(F.struct("j", "start", size.cast("int").alias("length"), bits.alias("bits"))).alias("cuts"))
    cuts = materialize(cuts, "cuts")
    for table in (anchors, found, gone):
        discard(table)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("blocks", "kinds", "cuts"))
            text = ["\n".join(_left(b, k, c or [], least)) for b, k, c in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(text, pa.string())], names=["id", "url", "text"])

    return parsed.join(cuts, "row", "left").select("id", "url", "blocks", "kinds", "cuts").mapInArrow(tidy(clean), f"id {id_type}, url string, text string")


def _left(blocks: list[str], kinds: bytes, cuts: list[dict], least: int) -> list[str]:
    """What the cuts leave of a page's blocks that may be kept, run by run."""
    by: dict[int, list[dict]] = {}
    for c in cuts:
        by.setdefault(c["j"], []).append(c)
    out = []
    for j, (block, kind) in enumerate(zip(blocks, kinds, strict=True)):
        if kind == OUTSIDE:
            continue
        if j not in by:
            out.append(block)
            continue
        words = block.split(" ")
        keep = [True] * len(words)
        for c in by[j]:
            for k in range(max(1, c["length"] - least + 1)):
                if c["bits"] >> k & 1:
                    a, b = c["start"] + k, c["start"] + k + min(least, c["length"])
                    keep[a:b] = [False] * (b - a)
        run: list[str] = []
        for word, stays in zip([*words, ""], [*keep, False], strict=True):
            if stays:
                run.append(word)
            elif run:
                out.append(" ".join(run))
                run = []
    return out
