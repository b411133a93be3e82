"""Penalised change points of daily series, by Dijkstra's algorithm over the day DAG.

A series of n days is a path from node 0 to node n; an edge from i to j is a segment of the days
i to j - 1 and costs ``length * floor(1000 * ln(V))``, V one more than the whole part of the
variance of its daily totals. Costs are not negative, and every edge but the first pays the penalty
of a cut. The heap is keyed by cost, then by the number of segments; a node's edges come into being
when it leaves the heap, so those of nodes dearer than the end never do. Equal keys keep the
earliest predecessor. Keys grow along every edge, so all predecessors that give a node its key have left the
heap before it, and the kept one is the earliest of all.

Scale: rows are summed up by key and day before anything is shuffled, so a key with a third of all rows
sends a row per day and task. A task then holds one key's days; its time grows with the square of
the days from the key's first to its last (150 days: 3 ms), not with rows. Keys are dealt by
hash. Nothing goes to the driver and nothing is broadcast.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Exact sums leave 64-bit integers for Python's own beyond this.
EXACT = 1 << 62
LONG = 1 << 63


def _logs(spread: np.ndarray) -> np.ndarray:
    """``floor(1000 * ln(V))`` of whole numbers."""
    if spread.dtype == object:
        return np.array([math.floor(1000 * math.log(v)) for v in spread], np.int64)
    return (1000 * np.log(spread)).astype(np.int64)  # not negative, so cut off is rounded down


class Series:
    """Daily totals with running sums, for exact costs of any segment."""

    def __init__(self, totals: list[int]) -> None:
        n, most = len(totals), max(map(abs, totals), default=0)
        kind = np.int64 if most * most * n * n < EXACT else object
        x = np.array(totals, kind)
        zero = np.zeros(1, kind)
        self.s, self.q = (np.concatenate((zero, np.cumsum(v))) for v in (x, x * x))

    def spreads(self, i: int, ends: np.ndarray) -> np.ndarray:
        """V of the segments from day i up to each of ``ends``, the end itself not included."""
        return _spreads(ends - i, self.s[ends] - self.s[i], self.q[ends] - self.q[i])

    def costs(self, i: int, ends: np.ndarray) -> np.ndarray:
        return (ends - i) * _logs(self.spreads(i, ends))


def _spreads(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    """V of segments of n days with sum s and sum of squares q, which is overwritten."""
    if s.dtype == object:
        n = n.astype(object)
    q *= n
    s *= s
    q -= s
    q //= n * n
    q += 1
    return q


def cheapest_cuts(totals: list[int], least: int = 14, penalty: int = 40000) -> tuple[list[int], int]:
    """``(borders, cost)``: nodes 0 to n of the cheapest path, and its cost with penalties."""
    n = len(totals)
    series = Series(totals)
    base = n + 1  # one number holds cost and count: cost * base + count
    nodes = np.append(np.arange(least, n - least + 1), n)  # nodes nearer to an end are on no path
    key, before = np.full(len(nodes), np.iinfo(np.int64).max), np.zeros(len(nodes), np.int64)
    firsts = np.searchsorted(nodes, nodes + least).tolist()  # the least place in nodes that an edge from a node reaches
    sums, squares = series.s[nodes], series.q[nodes]
    heap, settled = [(0, -1)], [False] * len(nodes)
    while heap:
        k, at = heapq.heappop(heap)
        if at == len(nodes) - 1:
            break
        if at >= 0 and settled[at]:
            continue
        if at >= 0:
            settled[at] = True
        i, a = (int(nodes[at]), firsts[at]) if at >= 0 else (0, 0)
        length = nodes[a:] - i
        reached = _logs(_spreads(length, sums[a:] - series.s[i], squares[a:] - series.q[i]))
        reached *= length
        if i:
            reached += penalty
        reached *= base
        reached += k + 1
        for to in np.flatnonzero(reached <= key[a:]).tolist():
            value, to = int(reached[to]), a + to
            if value == key[to]:
                before[to] = min(before[to], i)
            elif value < key[-1] or to == len(nodes) - 1:  # else dearer than the end as known: on no cheapest path
                key[to], before[to] = value, i
                heapq.heappush(heap, (value, to))
    place = dict(zip(nodes.tolist(), before.tolist(), strict=True))
    borders = [n]
    while borders[-1]:
        borders.append(place[borders[-1]])
    return borders[::-1], int(key[-1]) // base


def _segments(days: list[int], sums: list[int], least: int, penalty: int) -> Iterator[tuple[int, ...]]:
    """Rows of one series, from its days that have rows, in order."""
    totals = [0] * (days[-1] - days[0] + 1)
    for day, s in zip(days, sums, strict=True):
        totals[day - days[0]] = s
    borders, best = cheapest_cuts(totals, least, penalty)
    series = Series(totals)
    for k, (i, j) in enumerate(zip(borders, borders[1:], strict=False), 1):
        ends = np.array([j])
        yield k, days[0] + i, j - i, int(series.s[j] - series.s[i]), int(series.spreads(i, ends)[0]), int(series.costs(i, ends)[0]), len(borders) - 1, best


FIELDS = "segment_no int, first_day long, n_days long, total long, spread long, cost long, n_segments long, best_cost long"


def change_points(rows: DataFrame, *, key: str, value: str, at: str, least: int = 14, penalty: int = 40000) -> DataFrame:
    """``(key, segment_no, first_day, n_days, total, spread, cost, n_segments, best_cost)``, a row per segment.

    A key's series is the sum of ``value`` (whole numbers) per day of ``at`` (a date or timestamp), from its first to its
    last day; days between without rows count 0. Rows whose value or time is null are left out; repeated rows
    count as often as they occur; a null key is a series of its own, and keys without any taken row have none. A series shorter
    than ``least`` days, or than twice that, is one segment. Ties go to the fewest segments, then to the earliest starts from the
    last segment backwards. Sums are exact at any size; a total or spread beyond a long comes back null. Other columns
    are ignored, and an empty table gives no rows.
    """
    taken = rows.select(F.col(key).alias("k"), F.unix_date(F.col(at).cast("date")).cast("long").alias("day"), F.col(value).cast("decimal(38,0)").alias("v")).where("day IS NOT NULL AND v IS NOT NULL")
    if rows.schema[value].dataType.typeName() in ("byte", "short", "integer"):  # their sums fit into a long
        taken = taken.withColumn("v", F.col("v").cast("long"))
    daily = taken.groupBy("k", "day").agg(F.sum("v").alias("s"))
    series = daily.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("day", "s"))).alias("days"))
    schema = f"k {rows.schema[key].dataType.simpleString()}, {FIELDS}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = batch.column("k"), batch.column("days")
            flat, at = lists.flatten(), lists.offsets.to_pylist()
            days, sums = flat.field("day").to_pylist(), [int(s) for s in flat.field("s").to_pylist()]
            start = at[0]
            owners, found = [], []
            for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                for row in _segments(days[a - start : b - start], sums[a - start : b - start], least, penalty):
                    owners.append(i)
                    found.append([v if -LONG <= v < LONG else None for v in row])
            columns = list(zip(*found, strict=True)) or [()] * 8
            kinds = [pa.int32()] + [pa.int64()] * 7
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(owners, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["k", *(f.split()[0] for f in FIELDS.split(", "))])

    return series.mapInArrow(cut, schema).withColumnRenamed("k", key)
