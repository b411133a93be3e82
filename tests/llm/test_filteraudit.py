"""The filter audit against documents filtered one by one."""

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from cognatus.llm import filteraudit as fa

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(rows, i):
    id_, text, _ = rows[i]
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = set()
    out |= {"A"} if len(words) < 200 else set()
    out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
    out |= {"D"} if re.search("[#$%&*|]", text) else set()
    out |= {"E"} if any(j is not None and id_ is not None and j < id_ and (t or "") == text for j, t, _ in rows) else set()
    return out


def brute(rows, labels):
    marks = [fails(rows, i) for i in range(len(rows))]
    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    out = []
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], m) for r, m in zip(rows, marks, strict=True) if (r[2] or "") == part]
        steps = []
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                redundant = sum(f in m and bool(m & set(order[: k - 1])) for _, m in own)
                left = [x for x in left if f not in x[1]]
                steps.append(("".join(order), k, f, len(left), len(gone), redundant, sum(m == {f} for _, m in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)))
        out += [(part, *s[:2], *s[3:], sum(t[4] for t in steps if t[2] == s[2])) for s in steps]
    return sorted(out)


def corpus():
    pick = random.Random(4)
    rows = []
    for i in range(60):
        n = pick.choice([3, 150, 199, 200, 260])
        words = [pick.choice(["one", "Two", "THREE", "four", "fünf", "A", "#"][: pick.randint(1, 7)]) if pick.random() < 0.5 else f"w{pick.randint(0, 400)}" for _ in range(n)]
        rows.append((i, pick.choice([" ", "\n", "\t "]).join(words), pick.choice(["en", "de", None, ""])))
    rows += [(100 + i, rows[i][1], "en") for i in range(0, 60, 3)] + [(200 + i, rows[0][1], pick.choice(["en", "xx"])) for i in range(40)]
    rows += [rows[0], rows[5], (5, "other text of the same id", "en"), (300, None, "en"), (301, "", "de"), (302, None, None), (None, None, "en"), (None, rows[1][1], "en"), (None, rows[1][1], "en"), (303, "| " * 50_000, "long"), (-1, rows[7][1], "en")]
    labels = [(i, pick.randint(0, 1), pick.randint(0, 1)) for i in range(0, 320, 2)] + [(0, 1, None), (0, 0, 1), (None, 1, 1), (999, 1, 1), (6, None, None)]
    return rows, labels


def test_equals_brute_force(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    for name in ("id", "part", "mask", "digest", "n", "quality", "toxic", "apart", "key", "least", "low"):
        docs = docs.withColumn(name, F.lit("clash"))
    marks = marks.withColumns({c: F.lit("clash") for c in ("lang", "text", "mask", "id", "part")})
    got = fa.audit(docs, marks)
    assert set(got.columns) == set(COLUMNS)
    assert sorted(tuple(r) for r in got.select(COLUMNS).collect()) == brute(rows, labels)


def test_empty_tables(spark):
    docs, marks = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert fa.audit(docs, marks).count() == 0
    one = spark.createDataFrame([(1, "x", "en")], DOCS)
    got = fa.audit(one, marks)
    assert got.count() == 600 and got.where("good_lost + toxic_lost > 0").count() == 0
    assert {r["shapley"] for r in got.where("removed = 1").collect()} == {120}


def test_orders_cover_all_masks(spark):
    dim = fa.orders(spark)
    assert dim.count() == 120 * 5 * 32
    once = dim.groupBy("filter_order", "mask").agg(F.sum("removed").alias("r")).where("r <> CASE WHEN mask = 0 THEN 0 ELSE 1 END")
    assert once.count() == 0
