"""Git histories as tables: a Python data source, and reads of given commits on executors.

``spark.read.format("gitlog").option("repo", path).option("table", name)`` with the tables
``revisions`` (ord, sha), ``commits``, ``diffs``, ``stats`` and ``patch_ids``. The driver lists the revisions of
``range`` (``HEAD`` by default) and plans one partition per chunk of them; equality and IN filters
on ``sha`` are pushed, so that only those commits are asked of git. So is what ``subject`` or ``body`` has to
contain, and the option ``grep``, a pattern that git itself looks for in the lines of messages, case aside: each task has
git search its chunk, and no message without a match leaves git. The repository must lie where every executor can reach it.
"""

from __future__ import annotations

import re
import subprocess
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, SimpleDataSourceStreamReader, StringContains
from pyspark.sql.types import StructType

from cognatus.functions import text

CHUNK = 2000
TABLES = {
    "revisions": "ord long, sha string",
    "commits": "sha string, author_name string, author_date string, committer_date string, subject string, body string, files array<string>",
    "diffs": "sha string, diff string",
    "stats": "sha string, file string, added long, removed long",
    "patch_ids": "patch_id string, sha string",
}
#: Bytes read from git at a time.
READ_BYTES = 1 << 16


class RepositoryError(ValueError):
    """The path is no git repository, or git refused."""


def run_git(repo: str, *args: str, stdin: str | None = None) -> str:
    """Output of a git command as text, undecodable bytes replaced."""
    done = subprocess.run(["git", "-C", repo, *args], input=None if stdin is None else stdin.encode(), capture_output=True, check=False)
    if done.returncode:
        raise RepositoryError(f"git {args[0]}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout.decode(errors="replace")


def check_repository(repo: str) -> str:
    run_git(repo, "rev-parse", "--git-dir")
    return repo


def has_commit(repo: str, sha: str) -> bool:
    """Whether a stored checkpoint still names a commit."""
    try:
        run_git(repo, "cat-file", "-e", f"{sha}^{{commit}}")
    except RepositoryError:
        return False
    return True


def revisions(repo: str, span: str = "HEAD", merges: bool = False) -> list[str]:
    """Commits, by default those that are no merges, oldest first; the span ``--all`` covers every ref."""
    return [x for x in run_git(repo, "rev-list", "--reverse", "--topo-order", *([] if merges else ["--no-merges"]), span).split() if len(x) == 40]


def _records(out: BinaryIO, end: bytes) -> Iterator[bytes]:
    """What stands before each ``end``, one byte, and what is left after the last; read piece by piece."""
    pieces: list[bytes] = []  # of the record under way
    while piece := out.read(READ_BYTES):
        *whole, rest = piece.split(end)
        for record in whole:
            yield b"".join([*pieces, record])
            pieces = []
        pieces.append(rest)
    if last := b"".join(pieces):
        yield last


def stream_git(repo: str, args: list[str], shas: list[str], end: bytes, into: list[str] | None = None) -> Iterator[bytes]:
    """Records of a git command that reads commits from its input, as they come; ``into`` is a second command fed with the first's output.

    Output is never held as a whole. A command that fails raises, whatever it has put out before.
    """
    with tempfile.TemporaryFile() as asked, tempfile.TemporaryFile() as said:
        asked.write("\n".join(shas).encode())
        asked.seek(0)
        running = [subprocess.Popen(["git", "-C", repo, *args], stdin=asked, stdout=subprocess.PIPE, stderr=said)]
        if into:
            running.append(subprocess.Popen(["git", "-C", repo, *into], stdin=running[0].stdout, stdout=subprocess.PIPE, stderr=said))
            running[0].stdout.close()
        try:
            yield from _records(running[-1].stdout, end)
            failed = [p for p in running if p.wait()]
        finally:
            for p in running:
                p.kill()
                p.wait()
            running[-1].stdout.close()
        if failed:
            said.seek(0)
            raise RepositoryError(f"git {args[0]}: {said.read().decode(errors='replace').strip()}")


def _log(merges: bool, only: tuple[str, ...] = ()) -> list[str]:
    return ["log", "--no-walk=unsorted", *([] if merges else ["--no-merges"]), "--ignore-missing", "--stdin", "--no-color", "--no-renames", *only]


def matching(pattern: str | None, parts: list[str]) -> tuple[str, ...]:
    """Git's options for messages with a line that has the pattern, case aside, and with each of the parts, as they stand; a part need not lie in one line with another."""
    if pattern:
        return "-i", f"--grep={pattern}"
    return ("-F", "--all-match", *(f"--grep={part}" for part in parts)) if parts else ()


def read_revisions(repo: str, shas: list[str], merges: bool = False, only: tuple[str, ...] = ()) -> Iterator[tuple]:
    for token in stream_git(repo, [*_log(merges, only), "--format=%H"], shas, b"\n"):
        yield (token.decode(),)


def read_stats(repo: str, shas: list[str], merges: bool = False, only: tuple[str, ...] = ()) -> Iterator[tuple]:
    """Lines added to and removed from each file; null for a binary one."""
    sha = None
    for token in stream_git(repo, [*_log(merges, only), "--numstat", "-z", "--format=%x00%H%x00"], shas, b"\0"):
        name = token.decode(errors="replace").lstrip("\n")
        if re.fullmatch("[0-9a-f]{40}", name):
            sha = name
        elif found := re.fullmatch(r"([0-9]+|-)\t([0-9]+|-)\t(.+)", name, re.DOTALL):
            yield sha, found[3], *(None if n == "-" else int(n) for n in found.groups()[:2])


def read_commits(repo: str, shas: list[str], merges: bool = False, only: tuple[str, ...] = ()) -> Iterator[tuple]:
    """Null bytes end fields and names, for neither can hold one; an empty name is the start of the next commit."""
    form = "%x00%H%x00%an%x00%at%x00%ct%x00%s%x00%b%x00"
    fields: list[str] = []
    for token in stream_git(repo, [*_log(merges, only), "--name-only", "-z", f"--format={form}"], shas, b"\0"):
        text_ = token.decode(errors="replace")
        if len(fields) > 7 and not text_:  # after the fields, and the empty one that ends them, come names
            yield _commit_of(fields)
            fields = []
        fields.append(text_)
    if len(fields) > 6:
        yield _commit_of(fields)


def _commit_of(fields: list[str]) -> tuple:
    return (*fields[1:7], sorted({n for n in (x.strip("\n") for x in fields[7:]) if n}))


def read_diffs(repo: str, shas: list[str], merges: bool = False, only: tuple[str, ...] = ()) -> Iterator[tuple]:
    """A hash between null bytes starts a record; a diff of what git was told is text may hold null bytes itself."""
    sha, diff = None, []
    for token in stream_git(repo, [*_log(merges, only), "-p", "--format=%x00%H%x00"], shas, b"\0"):
        if re.fullmatch(rb"[0-9a-f]{40}", token):
            if sha:
                yield sha, _diff_of(diff)
            sha, diff = token.decode(), []
        else:
            diff.append(token)
    if sha:
        yield sha, _diff_of(diff)


def _diff_of(pieces: list[bytes]) -> str:
    return b"\0".join(pieces).decode(errors="replace").lstrip("\n")


def read_patch_ids(repo: str, shas: list[str], merges: bool = False, only: tuple[str, ...] = ()) -> Iterator[tuple]:
    for line in stream_git(repo, [*_log(merges, only), "-p"], shas, b"\n", into=["patch-id", "--stable"]):
        parts = line.decode(errors="replace").split()
        if len(parts) == 2 and len(parts[1]) == 40:
            yield parts[0], parts[1]


READERS = {"commits": read_commits, "diffs": read_diffs, "stats": read_stats, "patch_ids": read_patch_ids}


@dataclass
class Chunk(InputPartition):
    start: int
    shas: list[str]


class GitReader(DataSourceReader):
    def __init__(self, repo: str, table: str, span: str, chunk: int, merges: bool, grep: str | None) -> None:
        self.repo, self.table, self.span, self.chunk, self.only, self.merges, self.grep = check_repository(repo), table, span, chunk, None, merges, grep
        self.parts: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("sha",):
                wanted = set(f.value if isinstance(f, In) else [f.value])
                self.only = wanted if self.only is None else self.only & wanted
            else:
                if isinstance(f, StringContains) and f.attribute in (("subject",), ("body",)) and f.value and f.value.isascii() and f.value.isprintable():
                    self.parts.append(f.value)  # git leaves out most; Spark looks again, for git does not tell subject and body apart
                yield f

    def partitions(self) -> list[Chunk]:
        shas = revisions(self.repo, self.span, self.merges)
        rows = [(i, s) for i, s in enumerate(shas) if self.only is None or s in self.only]
        parts = [rows[i : i + self.chunk] for i in range(0, len(rows), self.chunk)]
        return [Chunk(p[0][0], [s for _, s in p]) for p in parts] or [Chunk(0, [])]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        only = matching(self.grep, self.parts)
        if self.table == "revisions":
            hit = {s for (s,) in read_revisions(self.repo, partition.shas, self.merges, only)} if only and partition.shas else None
            yield from ((partition.start + i, s) for i, s in enumerate(partition.shas) if hit is None or s in hit)
        elif partition.shas:
            yield from READERS[self.table](self.repo, partition.shas, self.merges, only)


class GitStream(SimpleDataSourceStreamReader):
    """New revisions since the last offset, a commit's hash; every start checks that it still exists."""

    def __init__(self, repo: str, start: str | None) -> None:
        self.repo, self.start = check_repository(repo), start or ""

    def initialOffset(self) -> dict:
        return {"sha": self.start, "ord": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        known = start["sha"] and has_commit(self.repo, start["sha"])
        shas = revisions(self.repo, f"{start['sha']}..HEAD" if known else "HEAD")
        end = {"sha": shas[-1], "ord": start["ord"] + len(shas)} if shas else start
        return iter([(start["ord"] + i, s) for i, s in enumerate(shas)]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        span = f"{start['sha']}..{end['sha']}" if start["sha"] and has_commit(self.repo, start["sha"]) else end["sha"]
        return iter([(start["ord"] + i, s) for i, s in enumerate(revisions(self.repo, span))]) if end["sha"] else iter([])

    def commit(self, end: dict) -> None:
        pass


class GitDataSource(DataSource):
    """Options: ``repo``, ``table`` (commits), ``range`` (HEAD), ``chunk`` (2000), ``merges`` (false), ``grep``; streams have the table revisions and ``start``."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def _table(self) -> str:
        table = self.options.get("table", "commits")
        if table not in TABLES:
            raise ValueError(f"no table {table}; there are {', '.join(TABLES)}")
        return table

    def schema(self) -> str:
        return TABLES[self._table()]

    def reader(self, schema: StructType) -> GitReader:
        return GitReader(self.options["repo"], self._table(), self.options.get("range", "HEAD"), int(self.options.get("chunk", CHUNK)), self.options.get("merges", "false").lower() == "true", self.options.get("grep"))

    def simpleStreamReader(self, schema: StructType) -> GitStream:
        if self._table() != "revisions":
            raise ValueError("a stream has the table revisions")
        return GitStream(self.options["repo"], self.options.get("start"))


def register(spark: SparkSession) -> None:
    """Make the source known; filters are pushed into Python sources from then on, in all of the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitDataSource)


def load(spark: SparkSession, repo: str, table: str, span: str = "HEAD", chunk: int = CHUNK, merges: bool = False, grep: str | None = None) -> DataFrame:
    register(spark)
    return spark.read.format("gitlog").options(repo=repo, table=table, range=span, chunk=chunk, merges=merges, **({"grep": grep} if grep else {})).load()


def search(spark: SparkSession, repo: str, pattern: str) -> DataFrame:
    """``(sha)`` of the commits of all refs, merges included, whose message has a line that matches git's basic regular expression, case aside."""
    return load(spark, repo, "revisions", "--all", merges=True, grep=pattern).select("sha")


def every_message(spark: SparkSession, repo: str) -> DataFrame:
    """``(sha, subject, body)`` of the commits of all refs, merges included: what a message search looks at."""
    return load(spark, repo, "commits", "--all", merges=True).select("sha", "subject", "body")


def read_given(shas: DataFrame, repo: str, table: str, chunk: int = CHUNK) -> DataFrame:
    """A table's rows for the commits in column ``sha``, read where the rows lie, chunk by chunk."""
    reader, schema = READERS[table], TABLES[table]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.list_(pa.string()) if n == "files" else pa.int64() if n in ("added", "removed") else pa.string() for n in names]
        for batch in batches:
            asked = batch.column("sha").to_pylist()
            for at in range(0, len(asked), chunk):
                rows = list(reader(repo, asked[at : at + chunk]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return shas.select("sha").distinct().mapInArrow(run, schema)


def show(spark: SparkSession, repo: str, sha: str) -> DataFrame:
    """``(sha, author_name, author_date, subject, body, files, stat, diff)`` of one commit; no row if there is none.

    ``stat`` has the file, the lines added and those removed, in the order of files.
    """
    one = spark.createDataFrame([(sha.strip().lower(),)], "sha string")
    head = read_given(one, repo, "commits").select("sha", "author_name", "author_date", "subject", "body", "files")
    stat = read_given(one, repo, "stats").groupBy("sha").agg(F.sort_array(F.collect_list(F.struct("file", "added", "removed"))).alias("stat"))
    return head.join(stat, "sha", "left").join(read_given(one, repo, "diffs"), "sha", "left")


def show_text(repo: str, sha: str) -> str:
    """A commit as git shows it, with the summary of its files and the diff; merges too."""
    return run_git(repo, "show", "--no-color", "--stat", "-p", sha.strip().lower(), "--")


def clean_commits(raw: DataFrame) -> DataFrame:
    """Commits as the tiers want them: stripped names, dates as numbers, the message cleaned."""
    return raw.select(
        F.lower("sha").alias("sha"),
        text.strip_space("author_name").alias("author_name"),
        text.safe_long("author_date").alias("author_date"),
        text.safe_long("committer_date").alias("committer_date"),
        text.strip_space("subject").alias("subject"),
        "body",
        text.strip_trailers("body").alias("cleaned_body"),
        F.array_distinct("files").alias("files"),
    )


def patch_ids_of(diffs: DataFrame) -> DataFrame:
    """``(patch_id, sha)`` from raw diffs; commits that change no file have none. Nothing is asked of git."""
    return diffs.select(text.patch_id("diff").alias("patch_id"), F.lower("sha").alias("sha")).where("patch_id IS NOT NULL")


def clean_diffs(raw: DataFrame) -> DataFrame:
    return raw.select(F.lower("sha").alias("sha"), text.normalize_diff("diff").alias("diff"))
