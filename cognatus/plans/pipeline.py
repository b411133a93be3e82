"""From commits to stored clusters: tiers, components, scores, and one atomic save."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cognatus.functions.similarity import DIFF_PREFIX
from cognatus.operators.graph import connected_components, star_forest
from cognatus.plans import incremental, scoring, tiers
from cognatus.plans.store import LAST_COMMIT, MIN_SIMILARITY, Store, assign_group_ids, new_records, retained, subject_key, upsert
from cognatus.session import materialize
from cognatus.sources import git

#: Reads a table's rows for the commits in column ``sha``.
Fetch = Callable[[DataFrame], DataFrame]


def seed_edges(stored: DataFrame) -> DataFrame:
    """A star per stored group, on its least hash."""
    centre = stored.groupBy("group_id").agg(F.min("sha").alias("src"))
    return stored.join(centre, "group_id").where("sha <> src").select("src", F.col("sha").alias("dst"))


def patch_links(members: DataFrame, subjects: DataFrame, patch_ids: Fetch) -> tuple[DataFrame, DataFrame]:
    """Tier 5 on what the other tiers left: ``(edges, members)``, the latter with the merged components.

    Patch ids are read of the subjects alone that still lie in more than one component, and the edges are
    solved between components, not commits. ``subjects`` has sha and subject.
    """
    labelled = subjects.select("sha", "subject").join(members, "sha")
    open_shas = labelled.join(tiers.ambiguous_subjects(labelled), "subject", "left_semi").select("sha")
    late = materialize(tiers.patch_edges(patch_ids(open_shas), subjects), "patches")
    of = members.select(F.col("sha").alias("__sha"), F.col("component").alias("__c"))
    ends = late.join(of, F.col("src") == F.col("__sha")).select(F.col("__c").alias("a"), "dst")
    ends = ends.join(of, F.col("dst") == F.col("__sha")).select(F.col("a").alias("src"), F.col("__c").alias("dst"))
    merged = star_forest(ends).select(F.col("v").alias("component"), F.col("u").alias("__root"))
    return late, members.join(merged, "component", "left").select("sha", F.coalesce("__root", "component").alias("component"))


def save_plan(members: DataFrame, scores: DataFrame, types: DataFrame, stored: DataFrame, top: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(hashes, records)``: the stored table after the save, and the rows written; ``members`` are grouped or stored.

    New ids follow ``top``, by default the greatest in ``stored``.
    """
    stored = stored.select("sha", "group_id", "detection_type", "similarity")
    kept = materialize(retained(members, scores, stored), "kept")
    if top is None:
        top = stored.agg(F.coalesce(F.max("group_id"), F.lit(0)).alias("m")).first()["m"]
    records = new_records(kept, assign_group_ids(kept, int(top)), types)
    return upsert(stored, records), records


def early_edges(commits: DataFrame) -> DataFrame:
    """Edges of tiers 1 to 4; tier 3's are :func:`tiers.message_links`, which connect what its pairs do."""
    strict = materialize(tiers.timestamp_pairs(commits).unionByName(tiers.message_links(commits)), "strict")
    return materialize(tiers.tag_edges(commits).unionByName(strict).unionByName(tiers.fuzzy_pairs(commits, strict)), "edges")


def link(commits: DataFrame, patch_ids: Fetch, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(edges, members)``: all tiers' edges, and ``(sha, component)`` of every vertex.

    Tier 5 runs only on subjects that tiers 1 to 4 and the stored groups leave in more than one
    component; its edges are solved between components, not commits.
    """
    commits = materialize(commits, "commits")
    early = early_edges(commits)
    joins = early.select("src", "dst").union(seed_edges(stored))
    vertices = commits.select("sha").union(stored.select("sha")).union(early.select(F.col("src").alias("sha"))).union(early.select(F.col("dst").alias("sha"))).distinct()
    members = materialize(connected_components(vertices, joins, key="sha"), "members")
    late, members = patch_links(members, commits, patch_ids)
    return early.unionByName(late), members


@dataclass
class Report:
    """What a run found: all edges; per tier the links that have a new commit and their new ends; members below the threshold; commits, and diffs, read."""

    edges: DataFrame
    counters: DataFrame
    filtered: int
    read: int
    compared: int


def _keyed(rows: DataFrame, commits: DataFrame) -> DataFrame:
    """Rows with the ``subject_key`` of the commits at hand; other rows keep theirs, if they have one."""
    known = commits.groupBy("sha").agg(F.first("subject").alias("__subject"))
    old = F.col("subject_key") if "subject_key" in rows.columns else F.lit(None).cast("long")
    key = F.when(F.col("__subject").isNotNull(), subject_key("__subject")).otherwise(old)
    return rows.join(known, "sha", "left").withColumn("subject_key", key).drop("__subject")


def _score(members: DataFrame, diffs: Fetch) -> tuple[DataFrame, DataFrame]:
    """``(grouped, scores)``: the members of components of two or more, and their similarities."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    grouped = materialize(members.join(sizes, "component", "left_semi"), "grouped")
    return grouped, materialize(scoring.group_similarity(grouped, diffs(grouped.select("sha")), prefix=DIFF_PREFIX), "scores")


def _below(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("similarity") < MIN_SIMILARITY).select("sha")


def _checkpoint(last: str | None) -> dict[str, str]:
    return {LAST_COMMIT: last} if last and len(last) == 40 else {}


def run(commits: DataFrame, patch_ids: Fetch, diffs: Fetch, store: Store, last: str | None, *, new: DataFrame | None = None, strict: bool = False) -> Report:
    """Link ``commits`` with the stored groups, score all groups and save; ``new`` are the hashes that count as new, all by default.

    ``strict`` drops a stored row whose member scored below the threshold this time; by default
    such a row stays as it was, which repeats what earlier runs of this kind of store did.
    """
    base, stored = store.version(), store.indexed
    edges, members = link(commits, patch_ids, stored)
    grouped, scores = _score(members, diffs)
    every = members.join(stored.select("sha"), "sha", "left_semi").union(grouped.select(members.columns)).distinct()
    records = save_plan(every, scores, tiers.evidence(edges, stored), stored)[1]
    return _save(store, base, stored, stored, commits, edges, records, scores, _checkpoint(last), new, strict, grouped)


def run_new(commits: DataFrame, patch_ids: Fetch, diffs: Fetch, store: Store, last: str | None, *, new: DataFrame, strict: bool = False, state: dict[str, str] | None = None) -> Report:
    """As :func:`run`, for ``commits`` that are the new ones and the stored ones of their subjects.

    Stored groups are single vertices; only components that a link has changed are scored and written.
    Groups come out as :func:`run` makes them. Scores of groups that no link touches stay as they are, while
    :func:`run` works them out anew among the members still stored. ``state`` is saved in the same step.
    """
    base, stored = store.version(), store.indexed
    commits = materialize(commits, "commits")
    edges, placed = incremental.link_new(commits, early_edges(commits), patch_ids, stored)
    edges = materialize(edges, "edges")
    hit = incremental.changed(placed, tiers.evidence(edges), stored)
    members = materialize(hit.members, "members")
    grouped, scores = _score(members, diffs)
    every = members.join(hit.stored.select("sha"), "sha", "left_semi").union(grouped.select(members.columns)).distinct()
    top = stored.agg(F.max("group_id").alias("m")).first()["m"] or 0
    records = save_plan(every, scores, tiers.evidence(edges, hit.stored), hit.stored, top)[1]
    return _save(store, base, stored, hit.stored, commits, edges, records, scores, _checkpoint(last) | (state or {}), new, strict, grouped)


def _save(store: Store, base: int, stored: DataFrame, touched: DataFrame, commits: DataFrame, edges: DataFrame, records: DataFrame, scores: DataFrame, state: dict[str, str], new: DataFrame | None, strict: bool, grouped: DataFrame) -> Report:
    """Append the records, and rows that only learn their subject; ``touched`` are the stored rows among the members."""
    keys = stored.select(F.col("sha"), "subject_key")
    records = materialize(_keyed(records.join(keys, "sha", "left"), commits), "records")
    learnt = _keyed(stored.where("subject_key IS NULL").join(commits.select("sha"), "sha", "left_semi").join(records.select("sha"), "sha", "left_anti"), commits)
    edges = materialize(edges, "edges")  # before the tables they come from change
    low = stored.where(F.col("similarity") < MIN_SIMILARITY).select("sha")
    if strict:
        low = low.union(_below(scores).join(touched.select("sha"), "sha", "left_semi"))
    report = Report(edges, tiers.counters(edges, commits.select("sha") if new is None else new), _below(scores).count(), commits.count(), grouped.count())
    store.append(records.unionByName(learnt.select(records.columns)), low.join(records.select("sha"), "sha", "left_anti"), state, base)
    return report


def related(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """``(sha)`` of the stored commits that new ones may link with: of one subject with them, or of one not known."""
    keys = fresh.where("subject <> ''").select(subject_key("subject").alias("subject_key")).distinct()
    known = stored.join(keys, "subject_key", "left_semi").select("sha")
    return known.union(stored.where("subject_key IS NULL").select("sha"))


def scan(spark: SparkSession, repo: str, store: Store, *, full_history: bool = False, rescan: bool = False, strict: bool = False) -> Report | None:
    """Bring the store up to a repository's head; None if nothing is new.

    New commits are linked with each other and with stored ones; of those, only the ones of their subjects are
    read, and only groups that a link has changed are scored. ``rescan`` reads all stored commits and scores all groups. A commit
    that was seen before and not stored is not looked at again, but with ``full_history``.
    """
    git.check_repository(repo)
    last = store.last_commit()
    span = f"{last}..HEAD" if last and git.has_commit(repo, last) else "HEAD"
    news = materialize(git.load(spark, repo, "revisions", span), "revisions")
    newest = news.agg(F.max_by("sha", "ord").alias("sha")).first()["sha"]
    if newest is None:
        return None
    if full_history or rescan:
        asked = git.load(spark, repo, "revisions").select("sha") if full_history else news.select("sha").union(store.hashes.select("sha")).distinct()
        return run(materialize(_commits(repo)(asked), "commits"), _patch_ids(repo), _diffs(repo), store, newest, new=news.select("sha"), strict=strict)
    return scan_given(news.select("sha"), repo, store, newest, strict=strict)


def _commits(repo: str) -> Fetch:
    return lambda shas: git.clean_commits(git.read_given(shas, repo, "commits"))


def _patch_ids(repo: str) -> Fetch:
    return lambda shas: git.patch_ids_of(git.read_given(shas, repo, "diffs"))


def _diffs(repo: str) -> Fetch:
    return lambda shas: git.clean_diffs(git.read_given(shas, repo, "diffs"))


def scan_given(news: DataFrame, repo: str, store: Store, newest: str | None, *, strict: bool = False, state: dict[str, str] | None = None) -> Report:
    """Link the commits in column ``sha`` of ``news`` with each other and with the stored ones of their subjects; ``newest`` becomes the checkpoint."""
    fresh = materialize(_commits(repo)(news), "fresh")
    old = _commits(repo)(related(store.indexed, fresh).join(fresh.select("sha"), "sha", "left_anti"))
    return run_new(fresh.unionByName(old), _patch_ids(repo), _diffs(repo), store, newest, new=news.select("sha"), strict=strict, state=state)
