"""Scores, saving, lookups and verification."""

import itertools
import threading

import pytest
from pyspark.sql import functions as F

from cognatus.functions import similarity
from cognatus.functions.similarity import indel_ratio
from cognatus.plans import queries, scoring, store, verify
from cognatus.plans.store import LookupFailed, Store
from cognatus.sources import lists

SHA = [f"{i:02x}" * 20 for i in range(16)]


def rows(spark, data):
    return spark.createDataFrame(data, store.HASHES_SCHEMA)


def scored(spark, members, diffs):
    m = spark.createDataFrame(members, "sha string, component string")
    d = spark.createDataFrame(diffs, "sha string, diff string")
    return {r["sha"]: r["similarity"] for r in scoring.group_similarity(m, d).collect()}


def test_scores(spark):
    assert scored(spark, [("a", "g"), ("b", "g")], [("a", "x"), ("b", "x")]) == {"a": 1.0, "b": 1.0}
    assert scored(spark, [("a", "g"), ("b", "g")], [("a", ""), ("b", "")]) == {"a": 1.0, "b": 1.0}
    assert scored(spark, [("a", "g"), ("b", "g")], [("a", "x")]) == {"a": 0.0, "b": 0.0}
    four = [(c, "g") for c in "abcdp"]
    assert scored(spark, four, [(c, "same") for c in "abcd"]) == {**dict.fromkeys("abcd", 0.75), "p": 0.0}
    assert scored(spark, four[1:], [(c, "same") for c in "bcd"]) == {**dict.fromkeys("bcd", 0.6667), "p": 0.0}
    assert scored(spark, [("a", "g")], [("a", "x")]) == {}


def saved(spark, members, scores, stored, types=()):
    m = spark.createDataFrame(members, "sha string, component string")
    s = spark.createDataFrame(scores, "sha string, similarity double")
    old = rows(spark, stored)
    kept = store.retained(m, s, old)
    top = max([g for _, g, _, _ in stored], default=0)
    t = spark.createDataFrame(list(types), "sha string, detection_type int")
    records = store.new_records(kept, store.assign_group_ids(kept, top), t)
    return {r["sha"]: (r["group_id"], r["detection_type"], r["similarity"]) for r in store.upsert(old, records).collect()}


def test_new_groups_numbered_by_least_hash(spark):
    members = [(SHA[3], "x"), (SHA[4], "x"), (SHA[1], "y"), (SHA[2], "y")]
    got = saved(spark, members, [(s, 1.0) for s, _ in members], [], [(SHA[1], 2)])
    assert got == {SHA[1]: (1, 2, 1.0), SHA[2]: (1, 1, 1.0), SHA[3]: (2, 1, 1.0), SHA[4]: (2, 1, 1.0)}


def test_merge_takes_least_id(spark):
    stored = [(SHA[1], 3, 1, 0.9), (SHA[2], 3, 1, 0.9), (SHA[3], 7, 2, 0.9), (SHA[4], 7, 2, 0.9)]
    got = saved(spark, [(s, "x") for s in SHA[1:5]], [(s, 0.8) for s in SHA[1:5]], stored, [(s, 1) for s in SHA[1:5]])
    assert {g for g, _, _ in got.values()} == {3}


def test_stale_row_stays(spark):
    stored = [(SHA[1], 3, 1, 0.9), (SHA[2], 3, 1, 0.9)]
    got = saved(spark, [(s, "x") for s in SHA[1:4]], [(SHA[1], 0.6), (SHA[2], 0.8), (SHA[3], 0.8)], stored)
    assert got[SHA[1]] == (3, 1, 0.9) and got[SHA[2]][2] == 0.8 and got[SHA[3]][0] == 3


def test_one_retained_stored_member_is_written(spark):
    got = saved(spark, [(SHA[1], "x"), (SHA[2], "x")], [(SHA[1], 0.8), (SHA[2], 0.1)], [(SHA[1], 4, 1, 0.9)])
    assert got == {SHA[1]: (4, 1, 0.8)}


def test_below_threshold(spark):
    assert saved(spark, [(SHA[1], "x"), (SHA[2], "x")], [(SHA[1], 0.0), (SHA[2], 0.0)], []) == {}
    assert saved(spark, [], [], [(SHA[1], 4, 1, None), (SHA[2], 4, 1, 0.5)]) == {SHA[1]: (4, 1, None)}


@pytest.fixture
def small(spark, tmp_path):
    excluded = tmp_path / "excluded.txt"
    excluded.write_text(f"  {SHA[3].upper()} \n\n")
    s = Store.create(spark, f"file://{tmp_path}/store", f"file://{excluded}")
    data = [(SHA[1], 5, 1, 0.9), (SHA[2], 5, 2, None), (SHA[3], 5, 2, 0.8), ("1042" + "f" * 36, 8, 4, 1.0), ("10" + "e" * 38, 8, 9, 1.0)]
    s.save(rows(spark, data), spark.createDataFrame([("last_commit", SHA[1])], store.STATE_SCHEMA))
    return s


def test_lookups(small):
    shas = lambda df: [r["sha"] for r in df.collect()]
    assert small.resolve("0101") == 5 and small.resolve(SHA[2]) == 5
    for bad in ("xyz", "ff", "10", SHA[3], "03"):
        with pytest.raises(LookupFailed):
            small.resolve(bad)
    assert shas(small.siblings(SHA[1])) == [SHA[2]]
    assert shas(small.lookup("g5")) == shas(small.lookup("#5")) == shas(small.lookup("5")) == [SHA[1], SHA[2]]
    assert shas(small.lookup("1042")) == ["10" + "e" * 38]
    assert shas(small.group(99)) == []
    assert small.same_group(SHA[1], SHA[2]) and not small.same_group(SHA[1], "1042") and not small.same_group("zz", SHA[1])
    assert small.last_commit() == SHA[1]


def test_reports(small, spark):
    stats = small.stats()
    assert tuple(stats["totals"].first()) == (4, 2)
    assert stats["store"].first()["excluded"] == 1 and stats["store"].first()["size"].endswith("KB")
    assert [(r["code"], r["cnt"]) for r in stats["types"].orderBy("code").collect()] == [(1, 1), (2, 1), (3, 0), (4, 1), (5, 0), (9, 1)]
    assert tuple(stats["sizes"].first()) == (2, 2, 2.0)
    assert [tuple(r) for r in stats["top"].collect()] == [(5, 2), (8, 2)]
    assert [tuple(r) for r in small.groups().collect()] == [(5, 3, "partial", "[1 BLK]"), (8, 2, "none", "")]
    assert [r["cnt"] for r in small.groups(kind=2, hide_excluded=True).collect()] == [1]
    members = small.members(5).collect()
    assert [(r["label"], r["shown"], r["is_excluded"]) for r in members] == [("CHERRY_PICK_TAG", "0.90", False), ("SUBJECT_AND_TIMESTAMP", "", False), ("SUBJECT_AND_TIMESTAMP", "0.80", True)]


def test_message_search(small, spark):
    commits = spark.createDataFrame([(SHA[1], "Fix Parser", "body"), ("f" * 40, "other", "line\nthe parser")], "sha string, subject string, body string")
    found, n, known = small.search_message(commits, "^fix|the PARSER$")
    assert (n, known) == (2, 1)
    assert [r["group_id"] for r in small.groups(matches=found).collect()] == [5]
    assert small.search_message(commits, " ") == (None, 0, 0)


def test_toggle(small):
    shas = lambda: {r["sha"] for r in small.excluded.collect()}
    small.toggle(gid=5)
    assert shas() == set(SHA[1:4])
    small.toggle(gid=5)
    assert shas() == set()
    small.toggle(sha=SHA[2])
    assert shas() == {SHA[2]}
    small.toggle(gid=12345)
    assert shas() == {SHA[2]}


def test_missing_store(spark, tmp_path):
    with pytest.raises(LookupFailed):
        Store.open(spark, f"file://{tmp_path}/none")
    assert lists.read_exclusions(spark, f"file://{tmp_path}/none.txt").count() == 0


def test_verify(spark, tmp_path):
    known = rows(spark, [(SHA[1], 5, 1, 1.0), (SHA[2], 5, 1, 1.0), (SHA[4], 6, 1, 1.0)])
    text = {
        "ok": f"Git-commit: {SHA[1]}\nAlt-commit: {SHA[2]}\n",
        "altonly": f"Alt-commit: {SHA[1]}\n",
        "noalt": f"Git-commit: {SHA[9]}\n",
        "split": f"Git-commit: {SHA[1]}\nAlt-commit: {SHA[4]}\n",
        "missing": "".join(f"Alt-commit: {s}\n" for s in SHA[8:13]),
    }
    for name, value in text.items():
        (tmp_path / f"{name}.patch").write_text(value)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.patch").write_text(text["ok"])
    (tmp_path / "readme.txt").write_text(text["split"])
    summary, failures = verify.verify(spark, f"file://{tmp_path}", known)
    assert summary.first().asDict() == {"files": 5, "alt_tagged": 4, "compliant": 2, "non_compliant": 2}
    reasons = {r["path"].rsplit("/")[-1]: r["reason"] for r in failures.collect()}
    assert reasons["missing.patch"] == f"Missing from DB: {', '.join(SHA[8:11])} (+2 more)"
    assert reasons["split.patch"] == f"Split across multiple groups ({SHA[1][:10]}->GID:5, {SHA[4][:10]}->GID:6)"
    assert verify.verify(spark, f"file://{tmp_path}", known, recursive=True)[0].first()["files"] == 6


def test_saves_do_not_lose_each_other(spark, tmp_path):
    s = Store.create(spark, f"file://{tmp_path}/s")
    rows = [spark.createDataFrame([(c * 40, 1, 1, 1.0)], store.HASHES_SCHEMA) for c in "abc"]
    base = s.version()
    s.save(rows[0], s.state, base)
    with pytest.raises(store.Conflict):
        s.save(rows[1], s.state, base)
    assert [r["sha"] for r in s.hashes.collect()] == ["a" * 40]
    for row in rows[1:]:
        s.save(row, s.state, s.version())
    assert [r["sha"] for r in s.hashes.collect()] == ["c" * 40]
    assert len(list((tmp_path / "s").glob("v-*"))) == 2


def test_scores_are_the_same_for_any_tile(spark):
    members = [(SHA[i], "c" if i < 12 else "d") for i in range(16)]
    diffs = [(SHA[i], "abcdefgh"[: i % 5 + 2] * (i % 3 + 1)) for i in range(15)]
    m = spark.createDataFrame(members, "sha string, component string")
    d = spark.createDataFrame(diffs, "sha string, diff string")
    one, two, three = ({r["sha"]: r["similarity"] for r in scoring.group_similarity(m, d, **kind).collect()} for kind in ({}, {"tile": 2}, {"tile": 5, "chars": 20}))
    assert one == two == three and len(one) == 16 and 0 == min(one.values()) < max(one.values()) < 1


def test_scores_of_whole_texts(spark, monkeypatch):
    """The query compares texts to their ends; a scan the first 10,000 characters, as it is told."""
    bodies = ["x" * 12_000 + end * 4_000 for end in "yz"]
    rows = spark.createDataFrame([(SHA[i], "s", body) for i, body in enumerate(bodies)], "sha string, subject string, body string")
    edges = spark.createDataFrame([(SHA[0], SHA[1])], "src string, dst string")
    monkeypatch.setattr(queries, "_linked", lambda *args: (rows, edges))
    assert {r["similarity"] for r in queries.group_similarity(spark, "").collect()} == {round(12_002 / 16_002, 4)}
    members = rows.select("sha", F.lit("c").alias("component"))
    assert {r["similarity"] for r in scoring.group_similarity(members, rows.withColumnRenamed("body", "diff"), prefix=10_000).collect()} == {1.0}


def run_names(s):
    return [r["name"] for r in s._manifest()["runs"]]


def many(spark, n, gid=1):
    return spark.range(n).selectExpr("sha1(cast(id AS string)) AS sha", f"cast({gid} AS long) AS group_id", "1 AS detection_type", "1.0D AS similarity")


def test_appends_write_what_they_put(spark, tmp_path):
    s = Store.create(spark, f"file://{tmp_path}/s")
    s.save(many(spark, 50_000), s.state)
    whole = s.size()
    (base,) = run_names(s)
    sha = s.hashes.orderBy("sha").first()["sha"]
    s.append(rows(spark, [(sha, 9, 2, 0.9), ("f" * 40, 9, 2, 0.8)]), state={"last_commit": SHA[1]})
    s.append(rows(spark, [("e" * 40, 9, 2, 0.8)]), spark.createDataFrame([("f" * 40,)], "sha string"))
    assert run_names(s)[0] == base and s.size() - whole < whole / 100
    got = {r["sha"]: r["group_id"] for r in s.hashes.where("group_id <> 1").collect()}
    assert got == {sha: 9, "e" * 40: 9}
    assert s.hashes.count() == 50_001 and s.last_commit() == SHA[1]
    assert s.hashes.where(f"sha = '{sha}'").collect()[0]["detection_type"] == 2


def test_small_runs_are_merged(spark, tmp_path):
    assert [store.first_to_merge(x) for x in ([5], [100, 10], [39, 10], [1000, 39, 10], [1000, 60, 10, 9], [10, 500])] == [0, 1, 0, 1, 1, 0]
    s = Store.create(spark, f"file://{tmp_path}/s")
    for k in range(6):
        s.append(rows(spark, [(SHA[k], k, 1, 1.0), (SHA[15], k, 1, 1.0)]), spark.createDataFrame([(SHA[k - 1],)], "sha string") if k % 2 else None)
    assert {r["sha"]: r["group_id"] for r in s.hashes.collect()} == {SHA[1]: 1, SHA[3]: 3, SHA[5]: 5, SHA[15]: 5}
    assert len(run_names(s)) < 6
    on_disk = {p.name for p in (tmp_path / "s").glob("v-*")}
    assert on_disk == set(run_names(s)) | {r["name"] for r in s._manifest(s.version() - 1)["runs"]}
    assert len(list((tmp_path / "s").glob("m-*"))) == 2


def test_of_two_writers_one_learns_of_the_other(spark, tmp_path):
    s = Store.create(spark, f"file://{tmp_path}/s")
    results, start = [], threading.Barrier(4)

    def write(k):
        start.wait()
        try:
            s.append(rows(spark, [(SHA[k], k, 1, 1.0)]), base=1)
            results.append(k)
        except store.Conflict:
            results.append(None)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [k for k in results if k is not None]
    assert len(results) == 4 and len(won) == 1
    assert [r["group_id"] for r in s.hashes.collect()] == won and s.version() == 2
    assert {p.name for p in (tmp_path / "s").glob("v-*")} == set(run_names(s))


def test_a_manifest_is_never_overwritten(spark, tmp_path):
    assert lists.write_new(spark, f"file://{tmp_path}/d/x.json", "one")
    assert not lists.write_new(spark, f"file://{tmp_path}/d/x.json", "two")
    assert lists.read_text(spark, f"file://{tmp_path}/d/x.json") == "one"
    assert lists.names(spark, f"file://{tmp_path}/d") == ["x.json"] and lists.names(spark, f"file://{tmp_path}/none") == []


def test_many_are_resolved_as_one_by_one(small, spark):
    asked = ["0101", SHA[2], SHA[2].upper(), " 0202 ", "xyz", "ff", "10", "1042", SHA[3], "03", "", None, "0101"]
    got = {r["target"]: (r["outcome"], r["gid"]) for r in store.resolve_all(spark.createDataFrame([(a,) for a in asked], "target string"), small.hashes, small.excluded).collect()}
    assert set(got) == set(asked)
    for a in set(asked) - {None}:
        try:
            assert got[a] == ("found", small.resolve(a))
        except LookupFailed as problem:
            said = {"malformed": "hexadecimal", "missing": "no commit", "ambiguous": "ambiguous"}[got[a][0]]
            assert said in str(problem) and got[a][1] is None
    assert got[None] == ("malformed", None)
    assert store.resolve_all(spark.createDataFrame([], "target string"), small.hashes, small.excluded).count() == 0


def test_short_diffs_are_not_compared_one_by_one(monkeypatch):
    kinds = sorted({f"change {i * 7919 % 10007} of {i % 31}" for i in range(700)} | {"", "x" * 64, "y" * 65})
    rows = [(f"{i:04d}", text, 1 + i % 3) for i, text in enumerate(kinds)]
    short = [row for row in rows if len(row[1]) <= 64]

    def brute(pairs):
        out = {}
        for (a, x, n), (b, y, m) in pairs:
            ratio = indel_ratio(x, y)
            out[a], out[b] = out.get(a, 0.0) + ratio * m, out.get(b, 0.0) + ratio * n
        return out

    some = rows[::5] + rows[-2:]
    for left, right, pairs in ((some, None, itertools.combinations(some, 2)), (rows[:60], rows[600:], itertools.product(rows[:60], rows[600:]))):
        got, want = scoring._tile_sums(list(dict.fromkeys(left)), right), brute(dict.fromkeys(p for p in pairs if p[0] != p[1]))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    monkeypatch.setattr(similarity, "lcs_length", None)
    monkeypatch.setattr(similarity, "packs", None)
    assert len(scoring._tile_sums(short, None)) == len(short)
