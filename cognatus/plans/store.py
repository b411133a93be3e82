"""The stored clusters: runs of Parquet files behind numbered manifests, and all queries on them.

A store is a folder of runs and manifests. A run holds rows by hash, each put or deleted; a
manifest names the runs in force, oldest first, and the state. A newer run's row takes the place
of an older one's. A save writes its own rows as a run and then a manifest with the next number, which only one writer
can, so readers see the old rows or the new ones and of two writers one learns of the other. Small runs at the
end are merged into one when a save makes them a fourth of the run before, so bytes written follow
the records, times the logarithm of how many there are. Runs are laid out by hash, for point and prefix
lookups by row-group statistics.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cognatus.functions import text
from cognatus.session import materialize
from cognatus.sources import git, lists

HASHES_SCHEMA = "sha string, group_id long, detection_type int, similarity double"
STATE_SCHEMA = "key string, value string"
#: A run's rows: with a fingerprint of the commit's subject, by which a scan finds what new commits may link with.
RUN_SCHEMA = f"{HASHES_SCHEMA}, subject_key long, deleted boolean"
#: Runs are merged unless each is so many times as large as all after it.
GROWTH = 4
# The threshold, the checkpoint's key, and the tiers' two vocabularies.
MIN_SIMILARITY = 0.75
LAST_COMMIT = "last_commit"
LABELS = {
    1: ("CHERRY_PICK_TAG", "Explicit Cherry-Pick Tag"),
    2: ("SUBJECT_AND_TIMESTAMP", "Subject & Timestamp Match"),
    3: ("SUBJECT_AND_MESSAGE", "Subject & Message Match"),
    4: ("SUBJECT_AND_FUZZY_MESSAGE", "Subject & Fuzzy Message Match"),
    5: ("PATCH_DIFF_MATCH", "Patch Diff (Patch-ID) Match"),
}


class LookupFailed(ValueError):
    """No store, no such commit, an ambiguous prefix, or a malformed query."""


class Conflict(ValueError):
    """Another save came between."""


def detection_dim(spark: SparkSession) -> DataFrame:
    rows = [(code, name, label, code) for code, (name, label) in LABELS.items()]
    return spark.createDataFrame(rows, "code int, name string, label string, priority int")


# -- saving ---------------------------------------------------------------------------------


def retained(members: DataFrame, scores: DataFrame, stored: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """``(sha, component, score, old_gid)`` of the members whose score reaches the threshold.

    A member without a new score keeps its stored one, or counts as 1.
    """
    old = stored.select("sha", F.col("group_id").alias("old_gid"), F.col("similarity").alias("__old"))
    rows = members.join(scores.select("sha", F.col("similarity").alias("__new")), "sha", "left").join(old, "sha", "left")
    score = F.coalesce("__new", "__old", F.lit(1.0))
    return rows.select("sha", "component", score.alias("score"), "old_gid").where(F.col("score") >= least)


def assign_group_ids(kept: DataFrame, max_gid: Column | int) -> DataFrame:
    """``(component, group_id)`` of the groups to write, from ``(sha, component, old_gid)``.

    A group with stored members takes the least of their ids. Another needs two members and gets
    the next free id, in the order of least hashes. Ids are numbered per hash prefix, with the
    prefixes' totals added up, so no task sees all new groups.
    """
    groups = kept.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("old_gid").alias("old"), F.min("sha").alias("first"))
    groups = groups.where("n >= 2 OR old IS NOT NULL")
    fresh = groups.where("old IS NULL").withColumn("prefix", F.substring("first", 1, 3))
    totals = fresh.groupBy("prefix").agg(F.count(F.lit(1)).alias("k"))
    before = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("prefix").alias("__p"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("prefix").orderBy("first"))
    top = F.lit(max_gid) if isinstance(max_gid, int) else max_gid
    numbered = fresh.join(offsets, F.col("prefix") == F.col("__p")).select("component", (top + F.col("offset") + within).cast("long").alias("group_id"))
    return groups.where("old IS NOT NULL").select("component", F.col("old").cast("long").alias("group_id")).union(numbered)


def new_records(kept: DataFrame, gids: DataFrame, types: DataFrame) -> DataFrame:
    """Rows of ``hashes`` for the retained members; a member without evidence has type 1."""
    rows = kept.join(gids, "component").join(types, "sha", "left").where(text.is_sha("sha"))
    return rows.select("sha", "group_id", F.coalesce("detection_type", F.lit(1)).cast("int").alias("detection_type"), F.col("score").alias("similarity"))


def upsert(stored: DataFrame, records: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """``stored`` with ``records`` in place of rows of the same hash, then without rows below the threshold.

    A null similarity is below nothing and stays.
    """
    rows = stored.join(records.select("sha"), "sha", "left_anti").unionByName(records)
    return rows.where(F.col("similarity").isNull() | (F.col("similarity") >= least))


# -- queries on (hashes, excluded) -------------------------------------------------------------


def visible(hashes: DataFrame, excluded: DataFrame) -> DataFrame:
    return hashes.join(excluded.select("sha"), "sha", "left_anti")


def totals(hashes: DataFrame, excluded: DataFrame) -> DataFrame:
    return visible(hashes, excluded).agg(F.count(F.lit(1)).alias("total_hashes"), F.countDistinct("group_id").alias("total_groups"))


def type_histogram(hashes: DataFrame, excluded: DataFrame) -> DataFrame:
    """``(code, label, cnt, pct)``: the five known types, at zero if need be, then any others by code."""
    seen = visible(hashes, excluded).groupBy(F.col("detection_type").alias("code")).agg(F.count(F.lit(1)).alias("cnt"))
    every = detection_dim(hashes.sparkSession).select("code", "label").join(seen, "code", "full")
    cnt = F.coalesce("cnt", F.lit(0))
    all_of = F.sum(cnt).over(Window.partitionBy(F.lit(0)))
    label = F.coalesce("label", F.concat(F.lit("Unknown Type #"), F.col("code").cast("string")))
    return every.select("code", label.alias("label"), cnt.alias("cnt"), F.when(all_of > 0, cnt / all_of * 100).otherwise(0.0).alias("pct"))


def group_sizes(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy("group_id").agg(F.count(F.lit(1)).alias("cnt"))


def size_stats(hashes: DataFrame, excluded: DataFrame) -> DataFrame:
    return group_sizes(visible(hashes, excluded)).agg(F.min("cnt").alias("min_size"), F.max("cnt").alias("max_size"), F.avg("cnt").alias("avg_size"))


def top_groups(hashes: DataFrame, excluded: DataFrame, k: int = 5) -> DataFrame:
    """The k largest groups; ties go to the smaller id."""
    return group_sizes(visible(hashes, excluded)).orderBy(F.desc("cnt"), "group_id").limit(k)


def filtered(hashes: DataFrame, *, kind: int | None = None, excluded: DataFrame | None = None, matches: DataFrame | None = None) -> DataFrame:
    """Rows that pass the given filters: a type, not excluded, in the set of message matches."""
    rows = hashes if kind is None else hashes.where(F.col("detection_type") == kind)
    rows = rows if excluded is None else visible(rows, excluded)
    return rows if matches is None else rows.join(matches.select("sha"), "sha", "left_semi")


def group_states(hashes: DataFrame, excluded: DataFrame) -> DataFrame:
    """``(group_id, total, excluded, state)`` over whole groups: none, partial or all excluded."""
    flag = excluded.select("sha").distinct().withColumn("__x", F.lit(1))
    rows = hashes.join(flag, "sha", "left").groupBy("group_id").agg(F.count(F.lit(1)).alias("total"), F.count("__x").alias("excluded"))
    state = F.when(F.col("excluded") == 0, "none").when(F.col("excluded") == F.col("total"), "all").otherwise("partial")
    return rows.withColumn("state", state)


def group_list(hashes: DataFrame, excluded: DataFrame, filters: dict | None = None) -> DataFrame:
    """``(group_id, cnt, state, mark)`` of the groups with rows left by the filters, largest first."""
    rows = group_sizes(filtered(hashes, **(filters or {}))).join(group_states(hashes, excluded), "group_id")
    mark = F.when(F.col("state") == "all", "BLACKLISTED").when(F.col("state") == "partial", F.format_string("[%d BLK]", "excluded")).otherwise("")
    return rows.select("group_id", "cnt", "state", mark.alias("mark")).orderBy(F.desc("cnt"), "group_id")


def member_list(hashes: DataFrame, gid: int | Column, excluded: DataFrame, filters: dict | None = None) -> DataFrame:
    """``(sha, short, label, similarity, shown, is_excluded)`` of a group's rows left by the filters."""
    rows = filtered(hashes.where(F.col("group_id") == gid), **(filters or {}))
    dim = detection_dim(hashes.sparkSession).select(F.col("code").alias("detection_type"), F.col("name").alias("label"))
    flag = excluded.select("sha").distinct().withColumn("__x", F.lit(True))
    rows = rows.join(dim, "detection_type", "left").join(flag, "sha", "left")
    shown = F.when(F.col("similarity").isNull(), "").otherwise(F.format_string("%.2f", "similarity"))
    label = F.coalesce("label", F.col("detection_type").cast("string"))
    return rows.select("sha", text.short_sha("sha").alias("short"), label.alias("label"), "similarity", shown.alias("shown"), F.coalesce("__x", F.lit(False)).alias("is_excluded")).orderBy("sha")


def prefix_rows(hashes: DataFrame, prefix: str | Column) -> DataFrame:
    return hashes.where(F.col("sha").startswith(prefix))


def sibling_rows(hashes: DataFrame, gid: int | Column, asked: str | Column, excluded: DataFrame) -> DataFrame:
    """A group's visible hashes that do not begin with what was asked for."""
    return visible(hashes.where((F.col("group_id") == gid) & ~F.col("sha").startswith(asked)), excluded).select("sha")


def first_match(hashes: DataFrame, prefix: str | Column, excluded: DataFrame) -> DataFrame:
    """``(group_id, sha)`` of the least visible hash that begins so."""
    return visible(prefix_rows(hashes, prefix), excluded).orderBy("sha").limit(1).select("group_id", "sha")


def targets(asked: Column | str) -> tuple[Column, Column]:
    """``(clean, gid)`` of what a lookup is asked for: stripped, without a leading ``#``, in lower case; gid is null unless it can name a group."""
    clean = F.lower(F.regexp_replace(text.strip_space(asked), "^#", ""))
    return clean, F.regexp_extract(clean, "^g?([0-9]{1,18})$", 1).try_cast("long")


def resolve_targets(asked: DataFrame, hashes: DataFrame, excluded: DataFrame) -> DataFrame:
    """``(target, kind, gid)`` for a column of targets: ``g5`` is a group; ``5`` is one if it has visible rows; all else is a hash."""
    clean, gid = targets("target")
    groups = visible(hashes, excluded).select(F.col("group_id").alias("__g")).distinct()
    rows = asked.select("target", clean.alias("clean"), gid.alias("gid")).join(groups, F.col("gid") == F.col("__g"), "left")
    group = F.col("gid").isNotNull() & (F.col("clean").startswith("g") | F.col("__g").isNotNull())
    return rows.select("target", F.when(group, "group").otherwise("hash").alias("kind"), F.when(group, F.col("gid")).alias("gid"))


def resolve_all(asked: DataFrame, hashes: DataFrame, excluded: DataFrame) -> DataFrame:
    """``(target, outcome, gid)`` for a column of hashes or beginnings of hashes: ``found``, ``ambiguous``, ``missing`` or ``malformed``.

    As :meth:`Store.resolve`, for many at once: stored hashes are cut to the lengths that are asked for, at most 40, and
    joined on what is left of them, so no hash is compared with each target. A null target is malformed.
    """
    clean = F.lower(text.strip_space("target"))
    rows = materialize(asked.select("target").distinct().select("target", clean.alias("clean"), F.coalesce(clean.rlike("^[0-9a-f]*$"), F.lit(False)).alias("hex")), "asked")
    rows = rows.withColumn("length", F.least(F.length("clean"), F.lit(40)))
    lengths = sorted(r["length"] for r in rows.where("hex").select("length").distinct().collect())  # 41 at most
    cut = F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("__n")
    seen = visible(hashes, excluded).select("sha", "group_id", cut).withColumn("__cut", F.expr("left(sha, __n)"))
    wanted = rows.where("hex").select("target", "clean", "length")
    met = wanted.join(seen, (F.col("clean") == F.col("__cut")) & (F.col("length") == F.col("__n")))
    met = met.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.min("group_id").alias("gid"))
    outcome = F.when(~F.col("hex"), "malformed").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("found")
    told = rows.alias("r").join(met.alias("m"), F.col("r.target").eqNullSafe(F.col("m.target")), "left")
    return told.select(F.col("r.target").alias("target"), outcome.alias("outcome"), F.when(outcome == "found", F.col("gid")).alias("gid"))


def put_state(state: DataFrame, key: str, value: Column) -> DataFrame:
    """``state`` with the key at ``value``, whatever it was before."""
    fresh = state.sparkSession.range(1).select(F.lit(key).alias("key"), value.alias("value"))
    return state.where(F.col("key") != key).unionByName(fresh)


def search_counts(found: DataFrame, hashes: DataFrame) -> DataFrame:
    """``(matches, stored)``: how many hashes a message search found, and how many of them are stored."""
    return found.agg(F.countDistinct("sha").alias("matches")).crossJoin(hashes.join(found, "sha", "left_semi").agg(F.countDistinct("sha").alias("stored")))  # one row by one row


def search_messages(commits: DataFrame, pattern: str) -> DataFrame:
    """Hashes of the commits whose message has a line that matches, case aside."""
    return commits.where(F.concat_ws("\n\n", "subject", "body").rlike(f"(?im){pattern}")).select("sha").distinct()


def subject_key(subject: Column | str) -> Column:
    """What stands for a subject in a run; equal subjects have equal keys."""
    return F.xxhash64(F.col(subject) if isinstance(subject, str) else subject)


def merged(runs: list[DataFrame]) -> DataFrame:
    """Rows of runs given oldest first, each hash with its newest row, deleted ones among them.

    The oldest run, by far the largest, is only read past the hashes of the newer ones; it is not shuffled
    while those are few enough for the planner to broadcast them.
    """
    if len(runs) == 1:
        return runs[0]
    columns = runs[0].columns
    newer = runs[1].withColumn("__at", F.lit(1))
    for k, run in enumerate(runs[2:], 2):
        newer = newer.unionByName(run.withColumn("__at", F.lit(k)))
    if len(runs) > 2:
        last = newer.groupBy("sha").agg(F.max_by(F.struct(*columns[1:]), "__at").alias("__row"))
        newer = last.select("sha", "__row.*")
    return runs[0].join(newer.select("sha"), "sha", "left_anti").select(columns).unionByName(newer.select(columns))


def first_to_merge(sizes: list[int]) -> int:
    """Place of the oldest run, of runs of these bytes, that is to be merged with all after it; the last one's if none is."""
    after, first = sizes[-1], len(sizes) - 1
    for k in range(len(sizes) - 2, -1, -1):
        if sizes[k] < GROWTH * after:
            first = k
        after += sizes[k]
    return first


@dataclass
class Store:
    """A store in force. ``exclusions`` is the path of the exclusion list, if any."""

    spark: SparkSession
    path: str
    exclusions: str | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, exclusions: str | None = None) -> Store:
        """An existing store; raises :class:`LookupFailed` if there is none."""
        store = cls(spark, path, exclusions)
        if store.version() is None:
            raise LookupFailed(f"no store at {path}")
        return store

    @classmethod
    def create(cls, spark: SparkSession, path: str, exclusions: str | None = None) -> Store:
        """The store at ``path``, made empty if there is none."""
        store = cls(spark, path, exclusions)
        if store.version() is None:
            store._commit(1, [], {})
        return store

    # -- manifests

    def _versions(self) -> list[int]:
        found = [re.fullmatch(r"m-(\d+)\.json", name) for name in lists.names(self.spark, self.path)]
        return sorted(int(m[1]) for m in found if m)

    def version(self) -> int | None:
        """Number of the manifest in force; None before the first save."""
        return max(self._versions(), default=None)

    def _manifest(self, version: int | None = None) -> dict:
        version = version or self.version()
        return json.loads(lists.read_text(self.spark, f"{self.path}/m-{version:012d}.json"))

    def _commit(self, version: int, runs: list[dict], state: dict[str, str]) -> None:
        """Put a manifest in force, or raise :class:`Conflict` if its number is taken; then delete what the last two do not name.

        Runs are named by the version they are written for, so those of a later one under way are left alone.
        """
        if not lists.write_new(self.spark, f"{self.path}/m-{version:012d}.json", json.dumps({"runs": runs, "state": state})):
            for run in runs:
                if run["name"].startswith(f"v-{version:012d}-"):
                    lists.delete(self.spark, f"{self.path}/{run['name']}")
            raise Conflict(f"the store at {self.path} has changed since version {version - 1}")
        kept = {run["name"] for run in runs}
        for old in self._versions():
            if old == version - 1:
                kept |= {run["name"] for run in self._manifest(old)["runs"]}
            elif old < version:
                lists.delete(self.spark, f"{self.path}/m-{old:012d}.json")
        for name in lists.names(self.spark, self.path):
            made = re.match(r"v-(\d+)-", name)
            if made and int(made[1]) <= version and name not in kept:
                lists.delete(self.spark, f"{self.path}/{name}")

    def _write_run(self, rows: DataFrame, version: int) -> dict:
        name = f"v-{version:012d}-{uuid.uuid4().hex}"
        columns = [f.split()[0] for f in RUN_SCHEMA.split(", ")]
        try:
            rows.select(columns).repartitionByRange("sha").sortWithinPartitions("sha").write.parquet(f"{self.path}/{name}")
            return {"name": name, "bytes": lists.size(self.spark, f"{self.path}/{name}")}
        except (PySparkException, Py4JJavaError) as failed:
            lists.delete(self.spark, f"{self.path}/{name}")
            if (self.version() or 0) >= version:  # the writer who was first has deleted what was under way for this version
                raise Conflict(f"the store at {self.path} has changed since version {version - 1}") from failed
            raise

    def _runs(self, runs: list[dict]) -> list[DataFrame]:
        return [self.spark.read.schema(RUN_SCHEMA).parquet(f"{self.path}/{run['name']}") for run in runs]

    # -- tables

    @property
    def indexed(self) -> DataFrame:
        """``(sha, group_id, detection_type, similarity, subject_key)``; the key is null where the subject is not known."""
        runs = self._runs(self._manifest()["runs"])
        if not runs:
            return self.spark.createDataFrame([], RUN_SCHEMA).drop("deleted")
        return merged(runs).where(~F.col("deleted")).drop("deleted")

    @property
    def hashes(self) -> DataFrame:
        return self.indexed.drop("subject_key")

    @property
    def state(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self._manifest()["state"].items()), STATE_SCHEMA)

    @property
    def excluded(self) -> DataFrame:
        return lists.read_exclusions(self.spark, self.exclusions)

    def last_commit(self) -> str | None:
        return self._manifest()["state"].get(LAST_COMMIT)

    # -- saving

    def append(self, records: DataFrame, removed: DataFrame | None = None, state: dict[str, str] | None = None, base: int | None = None) -> None:
        """Put ``records`` in place of rows of the same hash, delete the hashes ``removed``, and set keys of the state, in one step.

        ``records`` has the columns of ``hashes`` and perhaps ``subject_key``; a hash in both is put. Only these rows are written, and
        now and then the small runs before them. ``base`` is the version they were made from; if another is in force
        by now, or comes first, nothing is saved and :class:`Conflict` is raised. Readers of the version before can finish.
        """
        now = self.version()
        if base is not None and now != base:
            raise Conflict(f"the store at {self.path} has changed since version {base}")
        manifest, version = self._manifest(now), now + 1
        if "subject_key" not in records.columns:
            records = records.withColumn("subject_key", F.lit(None).cast("long"))
        rows = records.withColumn("deleted", F.lit(False))
        if removed is not None:
            gone = removed.select("sha").distinct().join(records.select("sha"), "sha", "left_anti")
            fields = [f.split() for f in RUN_SCHEMA.split(", ")]
            rows = rows.unionByName(gone.select("sha", *[F.lit(None).cast(kind).alias(c) for c, kind in fields[1:-1]], F.lit(True).alias("deleted")))
        runs = manifest["runs"]
        if not rows.isEmpty():
            own = self._write_run(rows, version)
            runs = [*runs, own]
            first = first_to_merge([run["bytes"] for run in runs])
            if first < len(runs) - 1:
                whole = merged(self._runs(runs[first:]))
                runs[first:] = [self._write_run(whole if first else whole.where(~F.col("deleted")), version)]
                lists.delete(self.spark, f"{self.path}/{own['name']}")
        self._commit(version, runs, manifest["state"] | (state or {}))

    def save(self, hashes: DataFrame, state: DataFrame, base: int | None = None) -> None:
        """Replace all rows and the state, in one step; ``base`` as for :meth:`append`."""
        now = self.version()
        if base is not None and now != base:
            raise Conflict(f"the store at {self.path} has changed since version {base}")
        if "subject_key" not in hashes.columns:
            hashes = hashes.withColumn("subject_key", F.lit(None).cast("long"))
        version = (now or 0) + 1
        run = self._write_run(hashes.withColumn("deleted", F.lit(False)), version)
        self._commit(version, [run], {r["key"]: r["value"] for r in state.collect()})  # a few keys

    # -- lookups

    def group(self, gid: int) -> DataFrame:
        return visible(self.hashes.where(F.col("group_id") == gid), self.excluded).select("sha").orderBy("sha")

    def resolve(self, asked: str) -> int:
        """Group id of a hash or an unambiguous prefix of one, excluded hashes aside."""
        clean = asked.strip().lower()
        if re.fullmatch(r"[0-9a-f]*", clean) is None:
            raise LookupFailed(f"{asked!r} is no hexadecimal hash")
        rows = visible(self.hashes.where(F.col("sha") == clean) if len(clean) >= 40 else prefix_rows(self.hashes, clean), self.excluded).limit(2).collect()
        if not rows:
            raise LookupFailed(f"no commit {clean!r}")
        if len(rows) > 1:
            raise LookupFailed(f"prefix {clean!r} is ambiguous")
        return rows[0]["group_id"]

    def siblings(self, asked: str) -> DataFrame:
        return sibling_rows(self.hashes, self.resolve(asked), asked.strip().lower(), self.excluded).orderBy("sha")

    def lookup(self, target: str) -> DataFrame:
        """By ``g5`` or ``#5`` or ``5`` a group, if it has visible rows; else the siblings of a hash."""
        clean = target.strip().removeprefix("#").lower()
        if clean[:1] == "g" and clean[1:].isdigit():
            return self.group(int(clean[1:]))
        if clean.isdigit() and len(clean) < 19 and not self.group(int(clean)).isEmpty():
            return self.group(int(clean))
        return self.siblings(clean)

    def same_group(self, a: str, b: str) -> bool:
        """Whether both resolve to one group; what cannot be resolved is in none."""
        try:
            return self.resolve(a) == self.resolve(b)
        except LookupFailed:
            return False

    def size(self) -> int:
        """Bytes of the runs in force."""
        return sum(run["bytes"] for run in self._manifest()["runs"])

    def stats(self) -> dict[str, DataFrame]:
        """Totals, checkpoint, size, types, group sizes and the largest groups, excluded hashes aside."""
        rows, out = self.hashes, self.excluded
        about = self.spark.createDataFrame([(self.size(),)], "bytes long").select("bytes", text.human_size("bytes").alias("size"))
        return {
            "store": about.withColumn("excluded", F.lit(out.count())),
            "totals": totals(rows, out),
            "state": self.state,
            "types": type_histogram(rows, out),
            "sizes": size_stats(rows, out),
            "top": top_groups(rows, out),
        }

    def groups(self, kind: int | None = None, hide_excluded: bool = False, matches: DataFrame | None = None) -> DataFrame:
        out = self.excluded
        return group_list(self.hashes, out, {"kind": kind, "excluded": out if hide_excluded else None, "matches": matches})

    def members(self, gid: int, kind: int | None = None, hide_excluded: bool = False, matches: DataFrame | None = None) -> DataFrame:
        out = self.excluded
        return member_list(self.hashes, gid, out, {"kind": kind, "excluded": out if hide_excluded else None, "matches": matches})

    def search_message(self, commits: DataFrame, pattern: str) -> tuple[DataFrame | None, int, int]:
        """``(matches, how many, how many stored)``; an empty pattern clears the search."""
        if not pattern.strip():
            return None, 0, 0
        found = search_messages(commits, pattern.strip())
        counts = search_counts(found, self.hashes).first()
        return found, counts["matches"], counts["stored"]

    def search_repository(self, repo: str, pattern: str) -> tuple[DataFrame | None, int, int]:
        """As :meth:`search_message`, over all refs of a repository, by git's own search and regular expressions."""
        if not pattern.strip():
            return None, 0, 0
        found = materialize(git.search(self.spark, repo, pattern.strip()), "found")
        counts = search_counts(found, self.hashes).first()
        return found, counts["matches"], counts["stored"]

    def find(self, asked: str) -> tuple[int, str] | None:
        """Group and hash of the least visible hash that begins so; none for nothing."""
        clean = asked.strip().lower()
        row = first_match(self.hashes, clean, self.excluded).first() if clean else None
        return (row["group_id"], row["sha"]) if row else None

    def toggle(self, *, gid: int | None = None, sha: str | None = None) -> DataFrame:
        """Exclude a group or hash, or take it back if all of it is excluded; saves and returns the list."""
        if self.exclusions is None:
            raise LookupFailed("the store has no exclusion list")
        members = self.hashes.where(F.col("group_id") == gid).select("sha") if gid is not None else self.spark.createDataFrame([(sha.strip().lower(),)], "sha string")
        lists.write_exclusions(lists.toggle(self.excluded, members), self.exclusions)
        return self.excluded
