"""Scored pairs within blocks, and pairs of common keys dealt to parts, against all pairs."""

import itertools
import random

import pytest

from cognatus.functions.similarity import indel_ratio
from cognatus.operators import blocks
from cognatus.plans import queries, tiers

SMALL = "/root/testdata/sf0.001"


def made(spark, n=70, seed=3):
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = [rng.choice(["alpha", "beta", "gamma", "delta " * 9]) for _ in range(rng.randrange(0, 12))]
        rows.append((f"{i * 37 % n:04d}", rng.choice(["A", "a", "B", None]), rng.choice([1000, 2000, 9_000_000]), rng.choice([" ".join(words), "same text", None]), rng.choice([[], None, ["f"], ["g", None], ["f", "g"], [None]]), rng.choice("st")))
    return rows, spark.createDataFrame(rows, "sha string, author_name string, author_date long, cleaned_body string, files array<string>, subject string")


def agree(f, g):
    return not f or not g or bool({x for x in f if x} & {x for x in g if x})


@pytest.mark.parametrize("kind", [{}, {"tile": 3}, {"chars": 150}])
def test_scored_pairs(spark, kind):
    rows, frame = made(spark)
    want = {}
    for a, b in itertools.combinations(sorted(r for r in rows if r[3] is not None), 2):
        x, y = a[3], b[3]
        least = 0.5 if a[1] and b[1] and a[1].lower() == b[1].lower() else 0.6
        if a[5] == b[5] and agree(a[4], b[4]) and abs(a[2] - b[2]) <= 1000 and min(len(x), len(y)) >= 0.4 * max(len(x), len(y)) and indel_ratio(x, y) >= least:
            want[a[0], b[0]] = (indel_ratio(x, y), len(x) + len(y))
    got = blocks.scored_pairs(frame, ["subject"], 0.5, 0.6, 0.4, 1000, **kind).collect()
    assert len(want) > 50 and len(got) == len(want) and {(r["src"], r["dst"]): (r["sim"], r["total"]) for r in got} == want
    ends = blocks.scored_pairs(frame, ["subject"], 0.5, 0.6, 0.4, 1000, ends=True, **kind).collect()
    assert sorted(r["sha"] for r in ends) == sorted({x for pair in want for x in pair})


def test_no_pair_of_messages_is_sent(spark):
    """A message goes to its block, not to a batch of pairs, each with two messages."""
    rows = queries.commits(spark, SMALL)
    for frame in (tiers.timestamp_pairs(rows), tiers.fuzzy_pairs(rows, spark.createDataFrame([], "src string, dst string"))):
        plan = frame._jdf.queryExecution().toString()
        assert "FlatMapGroupsInArrow" in plan and "ArrowEvalPython" not in plan


def test_strict_ends(spark):
    rows = queries.prepared(spark, "/root/testdata/sf0.01")
    pairs = tiers.timestamp_pairs(rows).unionByName(tiers.message_pairs(rows))
    ends = lambda frame: {r["sha"] for r in frame.select("sha").collect()}
    assert ends(tiers.strict_ends(rows)) == ends(tiers.ends_of(pairs)) != set()


@pytest.mark.parametrize("kind", [{}, {"tile": 3}, {"tile": 7, "chars": 900}])
def test_bands_and_copies(spark, monkeypatch, kind):
    """Texts of many lengths in many bands, some near the bound, and a text that many rows have."""
    monkeypatch.setattr(blocks, "SAME", 2)
    rng, rows = random.Random(9), []
    for i in range(60):
        text = "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([5, 60, 66, 80, 100, 150, 210, 300])))
        rows += [(f"{i:02d}-{k}", "A", 1000, "".join(c for c in text if rng.random() > k / 30) + "x" * k, [], rng.choice("ss" "t")) for k in range(rng.choice([1, 2, 5]))]
    rows += [(f"z{k}", "A", 1000, "a text of many rows", [], "s") for k in range(12)]
    want = {}
    for a, b in itertools.combinations(sorted(rows), 2):
        if a[5] == b[5] and indel_ratio(a[3], b[3]) >= 0.85:
            want[a[0], b[0]] = indel_ratio(a[3], b[3])
    frame = spark.createDataFrame(rows, "sha string, author_name string, author_date long, cleaned_body string, files array<string>, subject string")
    got = blocks.scored_pairs(frame, ["subject"], 0.85, **kind).collect()
    assert len(want) > 100 and len(got) == len(want) and {(r["src"], r["dst"]): r["sim"] for r in got} == want
