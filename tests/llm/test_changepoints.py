"""Change points against brute force, and their odd rows."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from cognatus.llm import changepoints as cp

SCHEMA = "vendor_id long, quantity int, shipped_at timestamp_ntz"


def brute(totals, least=14, penalty=40000):
    """All predecessors of all days, keys compared as (cost, segments, starts from the last backwards)."""
    n, s, q = len(totals), [0], [0]
    for v in totals:
        s.append(s[-1] + v)
        q.append(q[-1] + v * v)

    def cost(i, j):
        m, a, b = j - i, s[j] - s[i], q[j] - q[i]
        return m * math.floor(1000 * math.log(1 + (m * b - a * a) // (m * m)))

    best = {0: (0, 0, ())}
    for j in range(1, n + 1):
        ways = [(best[i][0] + cost(i, j) + penalty * (i > 0), best[i][1] + 1, (i, *best[i][2])) for i in range(j) if i in best and (j - i >= least or (i == 0 and j == n))]
        if ways:
            best[j] = min(ways)
    return [*best[n][2][::-1], n], best[n][0]


@pytest.mark.parametrize("seed", range(6))
def test_cheapest_cuts(seed):
    pick = random.Random(seed)
    makes = [
        lambda i, n: pick.choice([0, 1]),
        lambda i, n: pick.randint(0, 50),
        lambda i, n: 0 if i < n // 2 else pick.randint(-3, 10 ** pick.randint(1, 4)),
        lambda i, n: 7,
        lambda i, n: 10**12 * pick.randint(0, 9),
    ]
    for _ in range(80):
        n, make = pick.randint(1, 60), pick.choice(makes)
        totals = [make(i, n) for i in range(n)]
        least, penalty = pick.randint(1, 15), pick.choice([0, 1, 100, 4000, 40000])
        assert cp.cheapest_cuts(totals, least, penalty) == brute(totals, least, penalty)


def day(n, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=hour)


def test_ties_take_fewest_segments_then_earliest_starts():
    assert cp.cheapest_cuts([5] * 60, 14, 0)[0] == [0, 60]
    step = [0] * 20 + [1000] * 20 + [0] * 20
    assert cp.cheapest_cuts(step, 14, 100)[0] == [0, 20, 40, 60]


def test_rows_of_any_kind(spark):
    pick = random.Random(2)
    rows = [(v, pick.randint(-2, 40), day(pick.randint(0, 90), pick.randint(0, 23))) for v in (1, 1, 1, 2, None) for _ in range(60)]
    rows += [(3, 5, day(4)), (4, None, day(4)), (5, 5, None), (6, 2**31 - 1, day(0)), (6, 2**31 - 1, day(0)), (6, 1, day(1)), rows[0], rows[0]]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("k", "v", "s", "day", "days", "total"):
        df = df.withColumn(name, F.lit("clash"))
    got = {}
    for r in cp.change_points(df, key="vendor_id", value="quantity", at="shipped_at").orderBy("vendor_id", "segment_no").collect():
        got.setdefault(r["vendor_id"], []).append(r)
    assert set(got) == {1, 2, 3, 6, None}
    for vendor, segments in got.items():
        taken = [((r[2] - day(0)).days, r[1]) for r in rows if r[0] == vendor and r[1] is not None and r[2] is not None]
        low, high = min(d for d, _ in taken), max(d for d, _ in taken)
        totals = [sum(q for d, q in taken if d == k) for k in range(low, high + 1)]
        borders, best = brute(totals)
        assert [r["first_day"] for r in segments] == [19723 + low + b for b in borders[:-1]]
        assert [r["segment_no"] for r in segments] == list(range(1, len(borders)))
        assert sum(r["n_days"] for r in segments) == len(totals) and sum(r["total"] for r in segments) == sum(totals)
        assert {(r["n_segments"], r["best_cost"]) for r in segments} == {(len(borders) - 1, best)}
        assert sum(r["cost"] for r in segments) + 40000 * (len(segments) - 1) == best
    assert cp.change_points(df.limit(0), key="vendor_id", value="quantity", at="shipped_at").count() == 0


def test_sums_beyond_a_long(spark):
    df = spark.createDataFrame([("a", 9 * 10**18, dt.date(2024, 1, 1)), ("a", 9 * 10**18, dt.date(2024, 1, 1)), ("a", 1, dt.date(2024, 1, 2))], "key string, v long, d date")
    (row,) = cp.change_points(df, key="key", value="v", at="d").collect()
    s, q = 18 * 10**18 + 1, (18 * 10**18) ** 2 + 1
    assert row["total"] is None and row["spread"] is None
    assert row["cost"] == 2 * math.floor(1000 * math.log(1 + (2 * q - s * s) // 4))
