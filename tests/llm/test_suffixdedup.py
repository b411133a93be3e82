"""Repeated strings against brute force, on planted passages and odd rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cognatus.llm import suffixdedup as sd

SCHEMA = "doc_id long, text string"


def brute(rows, width=50):
    texts, first = [(i, (t or "").encode()) for i, t in rows], {}
    for i, b in texts:
        for p in range(len(b) - width + 1):
            if i is not None:
                s = b[p : p + width]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, b in texts:
        covered = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if i is not None and first[b[p : p + width]] < i:
                covered[p : p + width] = b"\1" * width
        runs, p = [], 0
        while p < len(b):
            q = p
            while q < len(b) and covered[q] == covered[p]:
                q += 1
            if covered[p]:
                runs.append((p, q - p))
            p = q
        out.append((i, len(b), tuple(runs), hashlib.sha256(bytes(x for x, c in zip(b, covered, strict=True) if not c)).hexdigest()))
    return sorted(out, key=str)


def corpus():
    pick = random.Random(3)
    words = ["".join(pick.choice("abcdeé") for _ in range(pick.randint(1, 8))) for _ in range(60)]
    prose = lambda n: " ".join(pick.choice(words) for _ in range(n))
    passages = [prose(pick.randint(8, 60)) for _ in range(12)]
    rows = []
    for _ in range(120):
        parts = []
        for _ in range(pick.randint(1, 6)):
            x = pick.random()
            some = pick.choice(passages)
            parts.append(some if x < 0.4 else some[pick.randint(0, 30) :][: pick.randint(30, 90)] if x < 0.5 else prose(pick.randint(1, 40)))
        rows.append((pick.randint(0, 400), pick.choice([" ", "\n", "", ". "]).join(parts)))
    long = prose(20_000)
    return rows + [
        (500, "x" * 3000), (501, "x" * 49), (502, "x" * 50), (503, "ab" * 2000), (3, "ab" * 500 + "c"), (504, None), (505, ""), (None, passages[0] * 3), (None, None),
        rows[0], rows[1], (rows[2][0], passages[3] * 2), (506, long), (507, prose(30)), (508, rows[5][1]), (509, rows[5][1]), (510, long[100:60_000]), (-5, long[50_000:80_000]),
    ]


def plain(found):
    return sorted(((r["id"], r["n_bytes"], tuple((s["start"], s["length"]) for s in r["spans"]), r["kept_sha256"]) for r in found.collect()), key=str)


@pytest.mark.parametrize(("part_bytes", "width"), [(1 << 30, 50), (20_000, 50), (20_000, 24), (20_000, 64)])
def test_equals_brute_force(spark, part_bytes, width):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "m", "digest", "part", "spans", "n_bytes", "name", "tag", "whole", "kept_sha256"):
        docs = docs.withColumn(name, F.lit("clash"))
    assert plain(sd.repeated_strings(docs, width=width, part_bytes=part_bytes)) == brute(rows, width)


def test_empty_and_all_alike(spark):
    assert sd.repeated_strings(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(i, "one passage of more than fifty bytes that everyone has " * 2) for i in range(300)]
    found = plain(sd.repeated_strings(spark.createDataFrame(rows, SCHEMA)))
    assert [r[2] for r in found if r[0] == 0] == [()]
    assert {r[2] for r in found if r[0]} == {((0, len(rows[0][1])),)}


def test_hot_passage_in_many_parts(spark):
    pick = random.Random(5)
    line = "this line stands in every single document of the table, word for word"
    rows = [(i, f"{pick.random()} {pick.random()} {line} {pick.random()} {pick.random()}") for i in range(400)]
    found = plain(sd.repeated_strings(spark.createDataFrame(rows, SCHEMA), part_bytes=2000))
    assert found == brute(rows)
    assert sum(bool(r[2]) for r in found) == 399


def test_width_is_checked():
    with pytest.raises(ValueError, match="24 bytes"):
        sd.Plan(20)


def test_ranks_tell_strings_apart():
    data = np.frombuffer(random.Random(1).randbytes(500) * 2, np.uint8)
    ranks = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,)).astype(np.uint64)
    for length in (8, 16):
        ranks = sd.doubled(ranks, length)
    at = np.arange(450)
    for length in (32, 43, 50, 57, 64, 100):
        got = sd.ranks_at(ranks, 32, at, length)
        assert (got[:400] == sd.ranks_at(ranks, 32, at[:400] + 500, length)).all()
        assert len(np.unique(got)) == len({bytes(data[i : i + length]) for i in at})


def test_groups_over_several_batches(spark):
    rows = [(part, 7, False, part, 0, 1) for part in range(50)] + [(1, 8, False, 1, 0, 1), (2, 9, True, 5, 0, 1), (3, 7, False, 5, 1, 1)]
    rows = spark.createDataFrame(rows, "part int, name long, multi boolean, m long, tag long, whole long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = sd.judge(rows, 2).collect()
        seeds = sd.judge(rows.drop("m", "tag", "whole"), 1).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r["part"], r["name"], r["m"], r["mixed"]) for r in got) == sorted([(p, 7, 0, False) for p in range(50)] + [(2, 9, 5, False)])
    assert sorted((r["part"], r["name"]) for r in seeds) == sorted([(p, 7) for p in range(50)] + [(2, 9), (3, 7)])


def test_reply_is_found_by_rank_and_tag():
    table = pa.table({"part": [1, 1, 1], "round": [3, 3, 3], "name": [5, 5, 6], "tag": [1, 2, 1], "m": [10, 20, 30], "mixed": [False] * 3})
    known = sd.Known(table)
    u = lambda *x: np.array(x, np.uint64)
    found, place = known.find(3, u(5, 5, 5, 6, 7), u(1, 2, 3, 1, 1))
    assert found.tolist() == [True, True, False, True, False]
    assert known.rounds[3][2][place[:2]].tolist() == [10, 20]
