"""Linking new commits with stored groups, each group a single vertex.

A stored group is connected already, so its members count as one vertex. Links among what was read
are solved between groups and commits; only components that a link has changed are expanded to their
members, scored and written. What was read are the new commits and the stored ones of their subjects: tiers
2 to 5 link commits of one subject alone, and tags name their origin whether it was read or not.

Scale: stored rows are met by joins on hash or group id with what a link touches, never shuffled
for their own sake while that is small, and never read from the repository.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cognatus.operators.graph import star_forest
from cognatus.plans import tiers
from cognatus.session import materialize


def contract(vertices: DataFrame, edges: DataFrame, stored: DataFrame) -> DataFrame:
    """``(sha, gid, node, component)`` of the vertices and all ends of edges.

    ``node`` is the stored group or the commit itself, ``component`` the least node that it reaches. Ends are looked up
    once; an edge within a group joins nothing.
    """
    ends = vertices.select("sha").union(edges.select("src")).union(edges.select("dst")).distinct()
    groups = stored.select(F.col("sha").alias("__sha"), F.col("group_id").alias("gid"))
    placed = ends.join(groups, F.col("sha") == F.col("__sha"), "left").select("sha", "gid")
    placed = materialize(placed.withColumn("node", F.coalesce(F.concat(F.lit("g"), F.col("gid").cast("string")), "sha")), "placed")
    return hang(placed, edges)


def hang(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """``placed`` (sha, gid, node) with ``component`` over the edges between nodes."""
    of = placed.select(F.col("sha").alias("__sha"), F.col("node").alias("__node"))
    between = edges.select("src", "dst").join(of, F.col("src") == F.col("__sha")).select(F.col("__node").alias("a"), "dst")
    between = between.join(of, F.col("dst") == F.col("__sha")).select(F.col("a").alias("src"), F.col("__node").alias("dst")).where("src <> dst")
    roots = star_forest(between).select(F.col("v").alias("__v"), F.col("u").alias("__u"))
    return placed.join(roots, F.col("node") == F.col("__v"), "left").select("sha", "gid", "node", F.coalesce("__u", "node").alias("component"))


@dataclass
class Changed:
    """Components that links have changed: ``members`` (sha, component), all of theirs, and the ``stored`` rows among them."""

    members: DataFrame
    stored: DataFrame


def changed(placed: DataFrame, types: DataFrame, stored: DataFrame) -> Changed:
    """What has to be scored and written again.

    A component has changed if it spans several nodes, or if one of its stored members has stronger evidence
    in ``types`` (sha, detection_type) than it is stored with.
    """
    spans = placed.groupBy("component").agg(F.count_distinct("node").alias("n")).where("n > 1").select("component")
    kinds = types.select(F.col("sha").alias("__sha"), F.col("detection_type").alias("__new"))
    stronger = stored.select("sha", "detection_type").join(kinds, F.col("sha") == F.col("__sha")).where("__new < coalesce(detection_type, 99)").select("sha")
    better = placed.join(stronger, "sha", "left_semi").select("component")
    hit = materialize(placed.join(spans.union(better).distinct(), "component", "left_semi"), "hit")
    groups = hit.where("gid IS NOT NULL").select("gid", F.col("component").alias("__component")).distinct()
    rows = materialize(stored.join(groups, F.col("group_id") == F.col("gid")).select(*stored.columns, "__component"), "touched")
    members = hit.where("gid IS NULL").select("sha", "component").union(rows.select("sha", "__component"))
    return Changed(members, rows.drop("__component"))


def incremental_components(vertices: DataFrame, edges: DataFrame, stored: DataFrame) -> DataFrame:
    """``(sha, component)`` of all stored rows, vertices and ends of edges: the least hash of each one's component.

    Equal to solving all of them from scratch with a star per stored group, but only nodes that edges touch are solved.
    Rows of groups that no edge touches are labelled by their own group's least hash.
    """
    placed = contract(vertices, edges, stored)
    roots = placed.where("gid IS NOT NULL").select("gid", F.col("component").alias("__component")).distinct()
    own = F.coalesce("__component", F.concat(F.lit("g"), F.col("group_id").cast("string")))
    every = stored.join(roots, F.col("group_id") == F.col("gid"), "left").select("sha", own.alias("node"))
    every = materialize(every.union(placed.where("gid IS NULL").select("sha", F.col("component").alias("node"))), "labelled")
    least = every.groupBy("node").agg(F.min("sha").alias("component"))
    return every.join(least, "node").select("sha", "component")


def link_new(commits: DataFrame, edges_early: DataFrame, patch_ids, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(edges, placed)``: the early tiers' edges and tier 5's, and :func:`contract` over all of them.

    Tier 5 is asked of subjects that still lie in several components.
    """
    placed = materialize(contract(commits, edges_early, stored), "components")
    labelled = commits.select("sha", "subject").join(placed.select("sha", "component"), "sha")
    apart = labelled.join(tiers.ambiguous_subjects(labelled), "subject", "left_semi").select("sha")
    late = materialize(tiers.patch_edges(patch_ids(apart), commits), "patches")
    edges = edges_early.unionByName(late)
    if late.isEmpty():
        return edges, placed
    return edges, materialize(hang(placed.select("sha", "gid", "node"), edges), "components")
