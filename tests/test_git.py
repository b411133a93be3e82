"""End to end on repositories made here."""

import shutil
import subprocess

import pytest

from cognatus.plans.pipeline import scan
from cognatus.plans.store import Store
from cognatus.sources import git
from cognatus.streaming.incremental import follow, link_batch

pytestmark = pytest.mark.skipif(shutil.which("git") is None, reason="needs git")


class Repo:
    def __init__(self, path):
        self.path = str(path)
        self.run("init", "-q", "-b", "main")
        self.run("config", "user.name", "Test User")
        self.run("config", "user.email", "test@example.com")

    def run(self, *args):
        return subprocess.run(["git", "-C", self.path, *args], check=True, capture_output=True, text=True).stdout.strip()

    def commit(self, name, line, message):
        with open(f"{self.path}/{name}", "a") as f:
            f.write(line + "\n")
        self.run("add", name)
        self.run("commit", "-q", "-m", message)
        return self.run("rev-parse", "HEAD")


@pytest.fixture
def repo(tmp_path):
    (tmp_path / "r").mkdir()
    return Repo(tmp_path / "r")


@pytest.fixture
def store(spark, tmp_path):
    return Store.create(spark, f"file://{tmp_path}/store")


def test_tables(spark, repo):
    one = repo.commit("file.txt", "line 1", "Initial commit")
    two = repo.commit("file.txt", "line 2", "Second commit\n\nbody \x85 text")
    assert git.revisions(repo.path) == [one, two]
    rows = git.load(spark, repo.path, "revisions", chunk=1).orderBy("ord").collect()
    assert [r["sha"] for r in rows] == [one, two] and [r["ord"] for r in rows] == [0, 1]
    raw = git.load(spark, repo.path, "commits")
    assert raw.count() == 2
    first = git.clean_commits(raw.where(raw.sha == one)).first()
    assert (first["subject"], first["author_name"], first["files"]) == ("Initial commit", "Test User", ["file.txt"])
    assert first["author_date"] > 0
    diff = git.clean_diffs(git.load(spark, repo.path, "diffs")).where(f"sha = '{two}'").first()["diff"]
    assert "+line 2" in diff and "index " not in diff
    ids = git.load(spark, repo.path, "patch_ids").collect()
    assert {r["sha"] for r in ids} == {one, two} and all(r["patch_id"] for r in ids)
    assert [(r["subject"], "+line 2" in r["diff"]) for r in git.show(spark, repo.path, two.upper()).collect()] == [("Second commit", True)]
    assert git.show(spark, repo.path, "0" * 40).count() == 0
    with pytest.raises(git.RepositoryError):
        git.revisions(repo.path + "/none")


def test_odd_commits(spark, repo):
    one = repo.commit("a.txt", "x", "Title \x01 with \x02 marks\n\nbody \x03 and\n\nmore")
    repo.run("commit", "-q", "--allow-empty", "-m", "Nothing")
    two = repo.run("rev-parse", "HEAD")
    with open(f"{repo.path}/{'ab' * 20}", "w") as f:
        f.write("line\n")
    with open(f"{repo.path}/null.bin", "wb") as f:
        f.write(b"a\0b\n" * 3)
    with open(f"{repo.path}/.gitattributes", "w") as f:
        f.write("*.bin diff\n")
    repo.run("add", ".")
    repo.run("commit", "-q", "-m", "Names and nulls")
    three = repo.run("rev-parse", "HEAD")
    got = {r[0]: r for r in git.read_commits(repo.path, [one, two, three])}
    assert got[one][4:] == ("Title \x01 with \x02 marks", "body \x03 and\n\nmore\n", ["a.txt"])
    assert got[two][4:] == ("Nothing", "", [])
    assert got[three][6] == [".gitattributes", "ab" * 20, "null.bin"]
    diffs = dict(git.read_diffs(repo.path, [one, two, three]))
    assert "+x" in diffs[one] and diffs[two] == "" and "+a\0b" in diffs[three]
    with pytest.raises(git.RepositoryError):
        list(git.stream_git(repo.path, ["log", "--no-such-option"], [one], b"\0"))
    with pytest.raises(git.RepositoryError):
        list(git.stream_git(repo.path, ["log", "-p", "--stdin"], [one], b"\n", into=["no-such-command"]))


def test_all_refs_and_merges(spark, repo):
    base = repo.commit("a.txt", "x", "Base")
    repo.run("checkout", "-q", "-b", "side")
    side = repo.commit("b.txt", "y", "Side work")
    repo.run("checkout", "-q", "main")
    repo.commit("c.txt", "z", "Main work")
    repo.run("merge", "-q", "--no-ff", "-m", "Join the side", "side")
    merge = repo.run("rev-parse", "HEAD")
    repo.run("checkout", "-q", "-b", "other", base)
    other = repo.commit("d.txt", "w", "Elsewhere")
    repo.run("checkout", "-q", "main")
    rows = {r["sha"]: r["subject"] for r in git.every_message(spark, repo.path).collect()}
    assert rows[merge] == "Join the side" and rows[other] == "Elsewhere" and len(rows) == 5
    assert other not in git.revisions(repo.path) and merge not in git.revisions(repo.path)
    assert "b.txt | 1 +" in git.show_text(repo.path, side) and "Join the side" in git.show_text(repo.path, merge)


def groups(store):
    return {r["sha"]: r["group_id"] for r in store.hashes.collect()}


def test_cherry_pick_is_grouped(spark, repo, store):
    base = repo.commit("a.txt", "base", "Base commit")
    pick = repo.commit("a.txt", "candidate", "Cherry candidate")
    repo.run("checkout", "-q", "-b", "topic", base)
    repo.commit("b.txt", "other", "Other commit")
    repo.run("cherry-pick", "-x", pick)
    copy = repo.run("rev-parse", "HEAD")
    repo.run("checkout", "-q", "main")
    repo.run("merge", "-q", "--no-edit", "-s", "ours", "topic")
    scan(spark, repo.path, store)
    got = groups(store)
    assert got[pick] == got[copy] and base not in got


def test_revert_of_revert_is_not_grouped(spark, repo, store):
    repo.commit("a.txt", "base", "Base commit")
    one = repo.commit("a.txt", "line", "Feature")
    repo.run("revert", "--no-edit", "HEAD")
    repo.run("revert", "--no-edit", "HEAD")
    two = repo.run("rev-parse", "HEAD")
    scan(spark, repo.path, store)
    got = groups(store)
    assert one not in got or got.get(one) != got.get(two)


def test_incremental_equals_whole(spark, repo, store, tmp_path):
    repo.commit("a.txt", "base", "Base commit")
    one = repo.commit("b.txt", "same line", "Same subject")
    repo.commit("c.txt", "x", "Unrelated")
    scan(spark, repo.path, store)
    assert groups(store) == {}
    two = repo.commit("d.txt", "y", f"Port\n\n(cherry picked from commit {one})")
    three = repo.commit("e.txt", "y", f"Port again\n\n(cherry picked from commit {two})")
    query = follow(spark, repo.path, store, f"{tmp_path}/stream")
    query.awaitTermination(120)
    assert query.exception() is None
    assert store.last_commit() == three
    assert scan(spark, repo.path, store) is None
    other = Store.create(spark, f"file://{tmp_path}/other")
    scan(spark, repo.path, other)
    assert groups(other).keys() == groups(store).keys()


def partition(store):
    found = {}
    for sha, gid in groups(store).items():
        found.setdefault(gid, set()).add(sha)
    return sorted(sorted(v) for v in found.values())


def test_scan_reads_only_the_subjects_of_new_commits(spark, repo, tmp_path):
    message, long = "a message of more than thirty characters for all of them", "words of a line " * 20
    filler = lambda k: repo.commit(f"a{k}.txt", "1\n2\n3\n4", f"Filler of {k}")
    for k in range(3):
        for turn in range(2):
            filler(k)
            repo.commit(f"a{k}.txt", f"{long}{turn}", f"Subject {k}\n\n{message}")
        filler(k)
    repo.commit("z.txt", "z", "Alone")
    two = [Store.create(spark, f"file://{tmp_path}/{n}") for n in ("one", "two")]
    for s in two:
        scan(spark, repo.path, s)
    assert partition(two[0]) == partition(two[1]) != []
    known = s.indexed.where("subject_key IS NULL").count()
    assert known == 0
    newest = repo.commit("a2.txt", f"{long}2", f"Subject 2\n\n{message}")
    report = scan(spark, repo.path, two[0])
    stored_of_subject = sum(r["group_id"] == groups(two[0])[newest] for r in two[0].hashes.collect()) - 1
    assert report.read == 1 + stored_of_subject and report.compared == 1 + stored_of_subject
    whole = scan(spark, repo.path, two[1], rescan=True)
    assert whole.read > report.read
    assert partition(two[0]) == partition(two[1]) and newest in groups(two[0])
    assert {r["sha"]: r["detection_type"] for r in two[0].hashes.collect()} == {r["sha"]: r["detection_type"] for r in two[1].hashes.collect()}


def test_a_new_commit_merges_stored_groups(spark, repo, tmp_path):
    base = repo.commit("base.txt", "base", "Base")
    picks = []
    for k, branch in enumerate(("one", "two")):
        repo.run("checkout", "-q", "-b", branch, base)
        first = repo.commit(f"{branch}.txt", "line", f"Change {k}")
        picks.append((first, repo.commit(f"{branch}b.txt", "line", f"Port {k}\n\n(cherry picked from commit {first})")))
    repo.run("checkout", "-q", "main")
    repo.run("merge", "-q", "--no-edit", "-s", "ours", "one", "two")
    one, two = (Store.create(spark, f"file://{tmp_path}/{n}") for n in ("one", "two"))
    for s in (one, two):
        s.save(spark.createDataFrame([(x, g, 1, 1.0) for g, pair in enumerate(picks, 1) for x in pair], "sha string, group_id long, detection_type int, similarity double"), s.state)
        s.append(s.hashes.limit(0), state={"last_commit": repo.run("rev-parse", "HEAD")})
    bridge = repo.commit("two.txt", "line", f"Bridge\n\n(cherry picked from commit {picks[0][0]})")
    tail = repo.commit("one.txt", "line", f"Tail\n\n(cherry picked from commit {picks[1][1]})")
    repo.run("commit", "-q", "--allow-empty", "-m", f"Knot\n\n(cherry picked from commit {bridge})")
    scan(spark, repo.path, one)
    scan(spark, repo.path, two, rescan=True)
    assert partition(one) == partition(two)
    assert groups(one).get(bridge) in (1, None) and groups(one).get(tail) in (2, None)


def test_patch_ids_part_commits_as_git_does(spark, repo):
    base = repo.commit("a.txt", "\n".join(map(str, range(30))), "Base")
    repo.commit("b.txt", "one\r\ntwo", "Other base")

    def edit(text, files, message):
        for name, at in files:
            lines = open(f"{repo.path}/{name}", newline="").read().split("\n")
            lines.insert(at, text)
            with open(f"{repo.path}/{name}", "w", newline="") as f:
                f.write("\n".join(lines))
            repo.run("add", name)
        repo.run("commit", "-q", "-m", message)
        return repo.run("rev-parse", "HEAD")

    edit("new line\r", [("a.txt", 10)], "Once")
    repo.run("revert", "--no-edit", "HEAD")
    edit("first", [("a.txt", 0)], "Shift")
    edit("new line\r", [("a.txt", 11)], "Again, a line lower")
    repo.run("revert", "--no-edit", "HEAD")
    edit("new  line", [("a.txt", 11)], "Again, other white space")
    repo.run("revert", "--no-edit", "HEAD")
    edit("new line", [("a.txt", 11), ("b.txt", 1)], "In two files")
    repo.run("revert", "--no-edit", "HEAD")
    edit("index 12..34", [("b.txt", 1)], "Looks like a header")
    edit("@@ -1 +1 @@", [("b.txt", 1)], "Looks like a hunk")
    edit("diff --git a/q b/q", [("b.txt", 1)], "Looks like a file")
    repo.run("commit", "-q", "--allow-empty", "-m", "Nothing")
    with open(f"{repo.path}/c.txt", "w") as f:
        f.write("no end of line")
    repo.run("add", "c.txt")
    repo.run("mv", "a.txt", "d.txt")
    repo.run("commit", "-q", "-m", "Add and move")
    repo.run("revert", "--no-edit", "HEAD")
    repo.run("checkout", "-q", "-b", "side", base)
    edit("new line\r", [("a.txt", 10)], "On another branch")
    repo.run("checkout", "-q", "main")
    repo.run("merge", "-q", "--no-edit", "-s", "ours", "side")

    def parts(rows):
        found = {}
        for r in rows.collect():
            found.setdefault(r["patch_id"], set()).add(r["sha"])
        return sorted(sorted(v) for v in found.values())

    asked = git.load(spark, repo.path, "revisions").select("sha")
    own = parts(git.patch_ids_of(git.read_given(asked, repo.path, "diffs")))
    assert own == parts(git.read_given(asked, repo.path, "patch_ids"))
    assert max(map(len, own)) == 4


def test_git_searches_messages(spark, repo, store):
    one = repo.commit("a.txt", "x", "Fix the Parser\n\nsome body of [text]")
    two = repo.commit("a.txt", "y", "Other\n\nline one\nthe PARSER again")
    repo.run("checkout", "-q", "-b", "side", one)
    three = repo.commit("b.txt", "z", "Side parser work")
    repo.run("checkout", "-q", "main")
    shas = lambda df: {r["sha"] for r in df.collect()}
    assert shas(git.search(spark, repo.path, "parser")) == {one, two, three}
    assert shas(git.search(spark, repo.path, "^the pars")) == {two}
    assert shas(git.search(spark, repo.path, "nothing of the kind")) == set()
    raw = git.load(spark, repo.path, "commits")
    assert shas(raw.where(raw.body.contains("of [text]"))) == {one}
    assert shas(raw.where(raw.subject.contains("Parser"))) == {one} and raw.where(raw.body.contains("Other")).count() == 0
    reader = git.GitReader(repo.path, "commits", "HEAD", 10, False, None)
    kept = list(reader.pushFilters([git.StringContains(("body",), "of [text]"), git.StringContains(("body",), "two\nlines")]))
    assert len(kept) == 2 and reader.parts == ["of [text]"]
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == [one]
    assert [r["ord"] for r in git.load(spark, repo.path, "revisions", grep="PARSER again").collect()] == [1]
    store.save(spark.createDataFrame([(one, 4, 1, 1.0), ("a" * 40, 4, 1, 1.0)], "sha string, group_id long, detection_type int, similarity double"), store.state)
    found, n, known = store.search_repository(repo.path, "parser")
    assert (n, known) == (3, 1) and [r["group_id"] for r in store.groups(matches=found).collect()] == [4]
    assert store.search_repository(repo.path, "  ") == (None, 0, 0)
    with pytest.raises(git.RepositoryError):
        list(git.read_revisions(repo.path, [one], only=("--grep=[",)))


def test_stats_of_files(spark, repo):
    repo.commit("a.txt", "x", "One")
    with open(f"{repo.path}/sp ace\u00e9.txt", "w") as f:
        f.write("1\n2\n")
    with open(f"{repo.path}/bin", "wb") as f:
        f.write(bytes(range(256)))
    repo.run("rm", "-q", "a.txt")
    repo.run("add", ".")
    repo.run("commit", "-q", "-m", "Two")
    two = repo.run("rev-parse", "HEAD")
    assert sorted(git.read_stats(repo.path, [two])) == [(two, "a.txt", 0, 1), (two, "bin", None, None), (two, "sp ace\u00e9.txt", 2, 0)]
    (row,) = git.show(spark, repo.path, two).collect()
    assert [tuple(x) for x in row["stat"]] == [("a.txt", 0, 1), ("bin", None, None), ("sp ace\u00e9.txt", 2, 0)]


def test_batches_link_their_own_rows_once(spark, repo, tmp_path):
    one = repo.commit("a.txt", "x", "Same")
    repo.commit("b.txt", "x", f"Port\n\n(cherry picked from commit {one})")
    two = [repo.commit("c.txt", "x", "Later"), repo.commit("d.txt", "x", "Unlike")]
    three = repo.commit("e.txt", "x", f"Later port\n\n(cherry picked from commit {two[0]})")
    streamed, whole = (Store.create(spark, f"file://{tmp_path}/{n}") for n in ("streamed", "whole"))
    shas = git.revisions(repo.path)
    rows = spark.createDataFrame(list(enumerate(shas)), "ord long, sha string")
    parts = [rows.where("ord < 2"), rows.where("ord BETWEEN 2 AND 3"), rows.where("ord > 3")]
    for number, part in enumerate(parts):
        assert link_batch(part, number, repo.path, streamed, "s")
        assert streamed.last_commit() == shas[(1, 3, 4)[number]]
    before = streamed.version()
    assert not link_batch(parts[2], 2, repo.path, streamed, "s") and streamed.version() == before
    assert not link_batch(rows.limit(0), 3, repo.path, streamed, "s")
    scan(spark, repo.path, whole)
    assert partition(streamed) == partition(whole) and three in groups(streamed)
    assert link_batch(parts[2], 0, repo.path, streamed, "s")  # numbers start anew with a new checkpoint folder
    assert partition(streamed) == partition(whole)
