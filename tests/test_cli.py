"""The command line's parsing and exits, without a session of its own."""

import shutil
import subprocess

import pytest

from cognatus import cli
from cognatus.plans import store
from cognatus.plans.store import Store


def test_help(capsys):
    assert cli.main([]) == 0
    assert "scan" in capsys.readouterr().out


@pytest.fixture
def filled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda **kind: spark)
    s = Store.create(spark, f"file://{tmp_path}/store")
    s.save(spark.createDataFrame([("a" * 40, 1, 1, 1.0), ("b" * 40, 1, 1, 1.0), ("c" * 40, 2, 1, 1.0)], store.HASHES_SCHEMA), spark.createDataFrame([], store.STATE_SCHEMA))
    return ["--store", s.path]


def test_lookup(filled, capsys):
    assert cli.main(["lookup", "aaaa", *filled]) == 0
    assert capsys.readouterr().out.split() == ["b" * 40]
    assert cli.main(["lookup", "-g", "2", *filled]) == 0
    assert capsys.readouterr().out.split() == ["c" * 40]
    assert cli.main(["lookup", "aa", "bb", *filled]) == 0
    assert cli.main(["lookup", "aa", "cc", *filled]) == 1
    assert cli.main(["lookup", "dd", *filled]) == 1
    assert cli.main(["lookup", "stats", *filled]) == 0
    assert cli.main(["lookup", "aa", "--store", "/nowhere"]) == 1


def test_verify(filled, tmp_path, capsys):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.patch").write_text(f"Alt-commit: {'a' * 40}\nAlt-commit: {'c' * 40}\n")
    assert cli.main(["verify", f"file://{tmp_path}/p", *filled]) == 0
    assert "Split across multiple groups" in capsys.readouterr().out


def test_lists(filled, tmp_path, capsys):
    out = tmp_path / "excluded.txt"
    also = [*filled, "--exclusions", f"file://{out}"]
    assert cli.main(["groups", *filled]) == 0
    assert capsys.readouterr().out.splitlines() == ["g1\t2", "g2\t1"]
    assert cli.main(["toggle", "g1", *also]) == 0
    assert capsys.readouterr().out == "2 hashes excluded\n"
    assert cli.main(["toggle", "A" * 40, *also]) == 0
    assert cli.main(["groups", *also]) == 0
    assert capsys.readouterr().out.splitlines()[1:] == ["g1\t2\t[1 BLK]", "g2\t1"]
    assert cli.main(["members", "1", *also]) == 0
    assert capsys.readouterr().out.splitlines() == [f"{'a' * 40}\tCHERRY_PICK_TAG\t1.00", f"{'b' * 40}\tCHERRY_PICK_TAG\t1.00\texcluded"]
    assert cli.main(["groups", "--hide-excluded", "--type", "1", *also]) == 0
    assert capsys.readouterr().out.splitlines() == ["g1\t1\t[1 BLK]", "g2\t1"]
    assert cli.main(["members", "x1", *also]) == 1


@pytest.mark.skipif(shutil.which("git") is None, reason="needs git")
def test_scan_and_search(filled, tmp_path, capsys):
    repo = tmp_path / "r"
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True, text=True).stdout
    repo.mkdir()
    git("init", "-q")
    git("commit", "-q", "--allow-empty", "-m", "Fix parser")
    first = git("rev-parse", "HEAD").strip()
    git("commit", "-q", "--allow-empty", "-m", f"Port it\n\n(cherry picked from commit {first})")
    assert cli.main(["scan", str(repo), *filled]) == 0
    said = capsys.readouterr().out
    assert "Explicit Cherry-Pick Tag        : 2 commits (1 links)" in said and "2 commits read" in said
    assert cli.main(["search", str(repo), "PARSER", *filled]) == 0
    assert capsys.readouterr().out.splitlines() == ["1 commits match, 1 of them stored", "g3\t1"]
