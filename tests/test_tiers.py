"""The tiers' rules, case by case, and against a brute-force version."""

import itertools
import random

from cognatus.functions.similarity import indel_ratio
from cognatus.plans import queries, tiers

DAY = 86400
LONG = "this body is longer than thirty characters"


def frame(spark, rows):
    full = []
    for i, r in enumerate(rows):
        d = {"sha": f"{i:040x}", "author_name": "A", "author_date": 1000, "committer_date": 0, "subject": "s", "body": "", "cleaned_body": "", "files": []} | r
        full.append(tuple(d[k] for k in ("sha", "author_name", "author_date", "committer_date", "subject", "body", "cleaned_body", "files")))
    return spark.createDataFrame(full, tiers.COMMIT_SCHEMA)


def found(df):
    return {(int(r["src"], 16), int(r["dst"], 16)) for r in df.collect()}


def all_tiers(spark, rows):
    c = frame(spark, rows)
    two, three = tiers.timestamp_pairs(c), tiers.message_pairs(c)
    return found(two), found(three), found(tiers.fuzzy_pairs(c, two.unionByName(three)))


def test_same_date_same_body(spark):
    assert all_tiers(spark, [{"cleaned_body": LONG}] * 2) == ({(0, 1)}, set(), set())
    assert all_tiers(spark, [{}] * 2) == ({(0, 1)}, set(), set())
    assert all_tiers(spark, [{"cleaned_body": LONG}, {}]) == (set(), set(), set())


def test_message_length(spark):
    for n, want in ((31, (set(), {(0, 1)}, set())), (30, (set(), set(), {(0, 1)}))):
        assert all_tiers(spark, [{"cleaned_body": "x" * n}, {"cleaned_body": "x" * n, "author_date": 2000}]) == want


def test_guards(spark):
    gap = 6_480_000
    for extra, hit in ((0, True), (1, False)):
        assert bool(all_tiers(spark, [{"cleaned_body": LONG}, {"cleaned_body": LONG, "author_date": 1000 + gap + extra}])[1]) is hit
    assert all_tiers(spark, [{"cleaned_body": LONG, "author_date": 0}] * 2) == (set(), set(), set())
    assert all_tiers(spark, [{"cleaned_body": LONG, "files": ["a"]}, {"cleaned_body": LONG, "files": ["b"]}]) == (set(), set(), set())
    assert all_tiers(spark, [{"cleaned_body": LONG, "files": ["a"]}, {"cleaned_body": LONG}])[0] == {(0, 1)}


def test_fuzzy(spark):
    a = "a" * 87 + "b" * 13
    b = "a" * 87 + "c" * 13
    assert all_tiers(spark, [{"cleaned_body": a, "author_name": "X"}, {"cleaned_body": b, "author_name": "x", "author_date": 5}])[2] == {(0, 1)}
    assert all_tiers(spark, [{"cleaned_body": a, "author_name": "X"}, {"cleaned_body": b, "author_name": "Y", "author_date": 5}])[2] == set()


def test_fuzzy_window(spark):
    for n in (50, 51):
        rows = [{"cleaned_body": f"message number {i:03d} " + "z" * 200, "author_date": 1000 + i} for i in range(n)]
        assert len(all_tiers(spark, rows)[2]) == (n * (n - 1) // 2 if n == 50 else 0)


def test_tag_matched_rows_stay_fuzzy_candidates(spark):
    c = frame(spark, [{"cleaned_body": "x" * 20, "body": f"(cherry picked from commit {'e' * 40})"}, {"cleaned_body": "x" * 20, "author_date": 5}])
    assert tiers.tag_edges(c).count() == 1
    assert found(tiers.fuzzy_pairs(c, tiers.timestamp_pairs(c).unionByName(tiers.message_pairs(c)))) == {(0, 1)}


def test_patch_tier(spark):
    c = frame(spark, [{"files": ["a"]}, {"files": ["b"], "author_date": 400 * DAY}, {"subject": "other"}])
    ids = spark.createDataFrame([("p", f"{i:040x}") for i in range(3)], "patch_id string, sha string")
    assert found(tiers.patch_edges(ids, c)) == {(0, 1)}


def test_evidence_and_counters(spark):
    e = spark.createDataFrame([("a", "b", 3, None), ("b", "c", 1, None), ("c", "d", 5, None)], "src string, dst string, detection_type int, sim double")
    assert {r["sha"]: r["detection_type"] for r in tiers.evidence(e).collect()} == {"a": 3, "b": 1, "c": 1, "d": 5}
    new = spark.createDataFrame([("a",), ("b",)], "sha string")
    assert {tuple(r) for r in tiers.counters(e, new).collect()} == {(3, 1, 2), (1, 1, 1)}


def test_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(60):
        words = [rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(0, 9))]
        rows.append({"subject": rng.choice(["s", "t", ""]), "author_name": rng.choice("ABa"), "author_date": rng.choice([0, 1000, 2000, 9_000_000]), "cleaned_body": " ".join(words), "files": rng.choice([[], ["f"], ["g"]])})
    two, three, four, matched = set(), set(), set(), set()
    guard = lambda a, b: a["subject"] == b["subject"] != "" and (not a["files"] or not b["files"] or set(a["files"]) & set(b["files"])) and a["author_date"] and b["author_date"] and abs(a["author_date"] - b["author_date"]) <= 75 * DAY
    pairs = list(itertools.combinations(range(60), 2))
    for i, j in pairs:
        a, b = rows[i], rows[j]
        if guard(a, b):
            x, y = a["cleaned_body"], b["cleaned_body"]
            sim = 1.0 if not x and not y else 0.0 if not x or not y else indel_ratio(x, y)
            if a["author_date"] == b["author_date"] and sim >= 0.75:
                two.add((i, j))
            elif x == y and len(x) > 30:
                three.add((i, j))
            else:
                continue
            matched |= {i, j}
    for s in ("s", "t"):
        left = [i for i, r in enumerate(rows) if r["subject"] == s and r["cleaned_body"] and i not in matched]
        if 2 <= len(left) <= 50:
            for i, j in itertools.combinations(left, 2):
                a, b = rows[i], rows[j]
                x, y = a["cleaned_body"], b["cleaned_body"]
                need = 0.85 if a["author_name"].lower() == b["author_name"].lower() else 0.9
                if guard(a, b) and min(len(x), len(y)) / max(len(x), len(y)) >= 0.7 and indel_ratio(x, y) >= need:
                    four.add((i, j))
    assert all_tiers(spark, rows) == (two, three, four)


def labels(n, pairs):
    least = list(range(n))

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        least[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_message_links_connect_what_pairs_do(spark):
    for seed in range(4):
        pick = random.Random(seed)
        dates = [0, -5, -5 + 86400 * 75, 1000, 1000 + 86400 * 30, 1001 + 86400 * 75, 5, 86400 * 200] + [86400 * pick.randint(1, 900) + pick.randint(0, 3) for _ in range(25)]
        rows = [
            {"subject": pick.choice(["s", "t", ""]), "cleaned_body": LONG + pick.choice("ab"), "author_date": pick.choice(dates), "files": pick.choice([[], ["a"], ["b"], ["a", "c"], ["d", "b"], ["e"]][: pick.randint(2, 6)])}
            for _ in range(90)
        ]
        c = frame(spark, rows)
        pairs, links = found(tiers.message_pairs(c)), found(tiers.message_links(c))
        assert links <= pairs
        assert labels(len(rows), links) == labels(len(rows), pairs)


def test_common_message_takes_linear_links(spark):
    n = 4000
    rows = [{"cleaned_body": LONG, "author_date": 1_600_000_000 + 3600 * (i // 2), "files": ["f"] if i % 3 else ["f", "g"]} for i in range(n)]
    links = found(tiers.message_links(frame(spark, rows)))
    assert len(links) < 4 * n and set(labels(n, links)) == {0}


def test_common_subject_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(tiers, "DEALT", 4)
    rows = [(f"{i * 7 % 41:02d}", "s", i % 3 * 5_000_000 + 1) for i in range(41)] + [("x", "t", 1), ("y", "t", 0), ("z", "", 1)]
    pairs = tiers.subject_pairs(spark.createDataFrame(rows, "sha string, subject string, author_date long"), files=False, banded=True)
    want = [(a[0], b[0]) for a, b in itertools.combinations(sorted(rows), 2) if a[1] == b[1] != "" and a[2] and b[2] and abs(a[2] - b[2]) <= 6_480_000]
    assert sorted((r["sha_a"], r["sha_b"]) for r in pairs.select("sha_a", "sha_b").collect()) == sorted(want)
    assert pairs.groupBy("subject_a", "bucket_b", "part_a", "part_b").count().agg({"count": "max"}).collect()[0][0] < len(want) / 4


def test_fuzzy_pairs_of_every_subject(spark, monkeypatch):
    """The query compares subjects of any number of rows; a scan leaves out those of more than 50."""
    rows = [{"cleaned_body": f"message number {i:03d} " + "z" * 200, "author_date": 1000 + i} for i in range(51)]
    c = frame(spark, rows)
    monkeypatch.setattr(queries, "prepared", lambda spark, d: c)
    assert len(found(queries.tier4_fuzzy_pairs(spark, ""))) == 51 * 50 // 2
    assert found(tiers.fuzzy_pairs(c, tiers.timestamp_pairs(c))) == set()


def test_subjects_do_not_travel_with_pairs(spark):
    """What meets in a part has a short key: a subject of any length is sent once, not with each part."""
    rows = [(f"{i:02d}", "a long subject " * 50, 1000 + i) for i in range(9)] + [("x", None, 1), ("y", "a", 1000), ("z", "a", 1001)]
    pairs = tiers.subject_pairs(spark.createDataFrame(rows, "sha string, subject string, author_date long"), files=False, banded=True).select("sha_a", "sha_b")
    assert pairs.count() == 9 * 8 // 2 + 1
    joined = pairs._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1]
    assert "key_a" in joined and "subject_a" not in joined
