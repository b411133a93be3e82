"""The registered queries of the linkage engine over the driver's tables, and their DuckDB SQL.

``documents`` stand for commits: a document's first line is the subject, the rest the body, every
seventeenth one carries trailers and a cherry-pick tag. Every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cognatus.functions import similarity, text
from cognatus.operators.graph import connected_components
from cognatus.operators.overlap import overlaps
from cognatus.plans import incremental, messages, pipeline, scoring, store, tiers, verify
from cognatus.session import materialize, shared_path, spread
from cognatus.sources import lists


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha_of(number) -> F.Column:
    return F.sha1(number.cast("string"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as commits, with ``doc_id`` kept."""
    docs = spread(table(spark, sf_dir, "documents"))
    t = F.coalesce("text", F.lit(""))
    at = F.instr(t, "\n")
    tag = F.concat(F.lit("\n\nSigned-off-by: A B <a@example.com>\n(cherry picked from commit "), sha_of(F.col("doc_id") - 1), F.lit(")"))
    body = F.when(at > 0, F.substring(t, at + 1, F.length(t))).otherwise("")
    return docs.select(
        "doc_id",
        sha_of(F.col("doc_id")).alias("sha"),
        F.coalesce("source", F.lit("")).alias("author_name"),
        (F.lit(1700000000) + (F.coalesce("n_chars", F.lit(0)) + F.col("doc_id") % 2) % 150 * 86400).alias("author_date"),
        F.trim(F.split_part(t, F.lit("\n"), F.lit(1))).alias("subject"),
        F.when(F.col("doc_id") % 17 == 0, F.concat(body, tag)).otherwise(body).alias("body"),
        F.array(F.concat(F.coalesce("lang", F.lit("")), F.lit("/"), (F.col("doc_id") % 3).cast("string")), F.coalesce("source", F.lit(""))).alias("files"),
    ).withColumn("cleaned_body", text.strip_trailers("body"))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`commits` as a table, for queries that look at them several times: each text is cleaned once."""
    return materialize(commits(spark, sf_dir), "commits")


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table: a group per subject, types 1 to 6, and similarities, some of them null."""
    rows = commits(spark, sf_dir).select("doc_id", "sha", "subject")
    groups = rows.groupBy("subject").agg(F.min("doc_id").alias("group_id"))
    similar = F.when(F.col("doc_id") % 11 != 0, (F.col("doc_id") * 37 % 101).cast("double") / 100)
    return rows.join(groups, "subject").select("sha", "group_id", (1 + F.col("doc_id") % 6).cast("int").alias("detection_type"), similar.alias("similarity"))


def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("doc_id") % 7 == 3)
    return docs.select(sha_of(F.col("doc_id")).alias("sha"))


def patch_ids(rows: DataFrame) -> DataFrame:
    return rows.select(F.sha1(F.concat("subject", F.lit(" "), "cleaned_body")).alias("patch_id"), "sha")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, value)``: a patch file per document, every third without an alternative commit."""
    docs = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    alt = F.when(n % 3 != 0, F.concat(F.lit("Alt-commit: <"), F.upper(sha_of(n + n % 5)), F.lit(">\n"))).otherwise("")
    value = F.concat(F.lit("From: x\n  Git-commit: [ "), sha_of(n), F.lit(" ]\n"), alt, F.coalesce("text", F.lit("")))
    return docs.select(F.concat(F.lit("p/"), n.cast("string"), F.lit(".patch")).alias("path"), value.alias("value"))


def text_strip_trailers(spark, d):
    return commits(spark, d).select("sha", "cleaned_body")


def text_normalize_diff(spark, d):
    docs = table(spark, d, "documents")
    head = F.lit("diff --git a/f b/f\nindex 12ab..34CD 100644\n--- a/f\n+++ b/f\n@@ -1,2 +1,3 @@ ctx\n")
    return docs.select("doc_id", text.normalize_diff(F.concat(head, F.coalesce("text", F.lit("")), F.lit("\n@@ -9 +9 @@ \n"))).alias("diff"))


def tag_edges(spark, d):
    return tiers.tag_edges(commits(spark, d)).select("src", "dst")


def tier2_timestamp_pairs(spark, d):
    return tiers.timestamp_pairs(prepared(spark, d)).select("src", "dst", "sim")


def tier3_message_pairs(spark, d):
    return tiers.message_pairs(prepared(spark, d)).select("src", "dst")


def tier3_components(spark, d):
    """What tier 3 connects, by its links along the dates instead of all pairs."""
    rows = prepared(spark, d)
    return connected_components(rows.select("sha"), tiers.message_links(rows), key="sha")


def tier4_fuzzy_pairs(spark, d):
    """All pairs of a subject that tiers 2 and 3 leave, however many rows it has."""
    rows = prepared(spark, d)
    return tiers.fuzzy_scores(rows, tiers.strict_ends(rows), most=None).select("src", "dst", "sim")


def indel_ratio_pairs(spark, d):
    """The ratio itself on names of nations, a fixture for the SQL; the tiers and scores run it on whole messages and diffs."""
    n = table(spark, d, "nation").select("n_name", "n_regionkey")
    a, b = n.select(F.col("n_name").alias("a"), "n_regionkey"), n.select(F.col("n_name").alias("b"), F.col("n_regionkey").alias("r"))
    pairs = a.join(b, (F.col("n_regionkey") == F.col("r")) & (F.col("a") < F.col("b")))
    whole = F.length("a") + F.length("b")
    return pairs.select("a", "b", F.round(similarity.ratio("a", "b") * whole).cast("long").alias("twice_lcs"), whole.cast("long").alias("total"))


def short_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as commits with short messages, so that SQL can work out every ratio."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        sha_of(k).alias("sha"),
        F.concat(F.lit("a"), (k % 2).cast("string")).alias("author_name"),
        (F.lit(1700000000) + k * 7 % 40 * 86400).alias("author_date"),
        F.concat("c_mktsegment", F.lit(" "), F.col("c_nationkey").cast("string")).alias("subject"),
        F.concat(F.lower("c_name"), F.lit(" "), F.substring(F.md5(k.cast("string")), F.lit(1), (k % 13).cast("int"))).alias("cleaned_body"),
        F.array(F.concat(F.lit("f"), (k % 3 % 2).cast("string"))).alias("files"),
    )


def _twice_lcs(scores: DataFrame) -> DataFrame:
    """``(src, dst, twice_lcs)`` of scored pairs: the ratio times both lengths is a whole number."""
    return scores.select("src", "dst", F.round(F.col("sim") * F.col("total")).cast("long").alias("twice_lcs"))


def tier2_short_messages(spark, d):
    return _twice_lcs(tiers.timestamp_scores(short_commits(spark, d)))


def tier4_short_messages(spark, d):
    rows = short_commits(spark, d)
    return _twice_lcs(tiers.fuzzy_scores(rows, tiers.strict_ends(rows)))


def group_similarity_short(spark, d):
    """The scores of customers, a group per subject, in ten thousandths."""
    rows = short_commits(spark, d)
    scores = scoring.group_similarity(rows.select("sha", F.col("subject").alias("component")), rows.select("sha", F.col("cleaned_body").alias("diff")))
    return scores.select("sha", F.round(F.col("similarity") * 10000).cast("long").alias("score"))


def file_guard_pairs(spark, d):
    """Pairs of one subject that the file guard lets through, told by classes of rows with equal files instead of a look at each pair's."""
    met = overlaps(commits(spark, d).where("subject <> ''"), "subject", "files").expand()
    return met.where("id_a < id_b").select(F.col("id_a").alias("sha_a"), F.col("id_b").alias("sha_b"))


def file_overlap_degrees(spark, d):
    """How many commits of its subject share a file with a commit, and how many the file guard lets through; every fifth has no files."""
    rows = commits(spark, d).where("subject <> ''")
    files = F.when(F.col("doc_id") % 5 != 0, F.col("files"))
    return overlaps(rows, "subject", files).degrees().withColumnRenamed("id", "sha")


def time_band_pairs(spark, d):
    return tiers.subject_pairs(commits(spark, d), files=False, banded=True).select("sha_a", "sha_b")


def subject_buckets(spark, d):
    rows = commits(spark, d).where("subject <> ''").groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.min("sha").alias("first_sha"))
    return rows.where("n >= 2")


def bucket_size_window(spark, d):
    return tiers.bucket_sizes(commits(spark, d)).select("sha", "bucket_size")


def _linked(spark, d, tier3=tiers.message_pairs):
    """Commits and their edges of tiers 1, 3 and 5; where components are all that is asked for, tier 3 gives its links instead of all pairs."""
    rows = prepared(spark, d)
    return rows, tiers.tag_edges(rows).unionByName(tier3(rows)).unionByName(tiers.patch_edges(patch_ids(rows), rows))


def components(spark, d):
    rows, edges = _linked(spark, d, tiers.message_links)
    return connected_components(rows.select("sha"), edges, key="sha")


def ambiguous_subjects(spark, d):
    rows = prepared(spark, d)
    edges = tiers.tag_edges(rows).unionByName(tiers.message_links(rows))
    labelled = connected_components(rows.select("sha", "subject"), edges, key="sha")
    return tiers.ambiguous_subjects(labelled)


def patch_groups(spark, d):
    rows = prepared(spark, d)
    return tiers.patch_groups(patch_ids(rows), rows).select("patch_id", "subject", "n")


def group_similarity(spark, d):
    rows, edges = _linked(spark, d, tiers.message_links)
    members = materialize(connected_components(rows.select("sha"), edges, key="sha"), "members")
    return scoring.group_similarity(members, rows.select("sha", F.concat("subject", F.lit("\n"), "body").alias("diff")))


def evidence_min_type(spark, d):
    return tiers.evidence(_linked(spark, d)[1], hashes(spark, d))


def run_counters(spark, d):
    rows, edges = _linked(spark, d)
    return tiers.counters(edges, rows.where(F.col("doc_id") % 2 == 0).select("sha"))


def assign_group_ids(spark, d):
    rows, edges = _linked(spark, d, tiers.message_links)
    kept = connected_components(rows.select("doc_id", "sha"), edges, key="sha")
    kept = materialize(kept.select("sha", "component", F.when(F.col("doc_id") % 13 == 0, F.col("doc_id")).alias("old_gid")), "kept")
    return store.assign_group_ids(kept, 1_000_000)


def upsert_hashes(spark, d):
    old = hashes(spark, d)
    fresh = old.where(F.col("group_id") % 2 == 0).select("sha", (F.col("group_id") + 1).alias("group_id"), F.lit(1).alias("detection_type"), F.lit(0.9).alias("similarity"))
    return store.upsert(old, fresh)


def stats_totals(spark, d):
    return store.totals(hashes(spark, d), excluded(spark, d))


def type_histogram(spark, d):
    return store.type_histogram(hashes(spark, d), excluded(spark, d))


def group_size_stats(spark, d):
    return store.size_stats(hashes(spark, d), excluded(spark, d))


def top5_groups(spark, d):
    return store.top_groups(hashes(spark, d), excluded(spark, d))


def group_list(spark, d):
    rows, out = hashes(spark, d), excluded(spark, d)
    found = store.search_messages(commits(spark, d), "the")
    return store.group_list(rows, out, {"kind": 2, "excluded": out, "matches": found}).select("group_id", "cnt", "state")


def member_list(spark, d):
    rows = store.member_list(hashes(spark, d), F.lit(0), excluded(spark, d))
    return rows.select("sha", "short", "label", "shown", "is_excluded")


def group_blacklist_state(spark, d):
    return store.group_states(hashes(spark, d), excluded(spark, d))


def prefix_lookup(spark, d):
    return store.visible(store.prefix_rows(hashes(spark, d), "b6"), excluded(spark, d)).select("sha", "group_id")


def siblings(spark, d):
    return store.sibling_rows(hashes(spark, d), F.lit(0), "b6", excluded(spark, d))


def same_group(spark, d):
    """For every commit and the one its tag names: whether both are stored in one group."""
    rows = hashes(spark, d).select("sha", "group_id")
    pairs = tiers.tag_edges(commits(spark, d))
    a, b = rows.select(F.col("sha").alias("src"), F.col("group_id").alias("ga")), rows.select(F.col("sha").alias("dst"), F.col("group_id").alias("gb"))
    joined = pairs.join(a, "src", "left").join(b, "dst", "left")
    return joined.select("src", "dst", F.coalesce(F.col("ga") == F.col("gb"), F.lit(False)).alias("same"))


def message_search(spark, d):
    found = store.search_messages(commits(spark, d), "license|copyright")
    return store.filtered(hashes(spark, d), matches=found).select("sha", "group_id")


def blacklist_anti(spark, d):
    return store.visible(hashes(spark, d), excluded(spark, d)).select("sha")


def distinct_union(spark, d):
    rows = commits(spark, d)
    return rows.where(F.col("doc_id") % 2 == 0).select("sha").union(hashes(spark, d).where("detection_type < 4").select("sha")).distinct()


def toggle_blacklist(spark, d):
    return lists.toggle(excluded(spark, d), hashes(spark, d).where("group_id = 0").select("sha"))


def patch_header_extract(spark, d):
    rows = lists.parse_patches(patches(spark, d))
    return rows.select("path", F.array_join("git_shas", ",").alias("git_shas"), F.array_join("alt_shas", ",").alias("alt_shas"))


def patch_compliance(spark, d):
    return verify.judge_patches(lists.parse_patches(patches(spark, d)), hashes(spark, d))


def stored_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two customers of three as a stored table, seven to a group."""
    k = F.col("c_custkey")
    similar = F.when(k % 11 != 0, (k * 37 % 101).cast("double") / 100)
    rows = table(spark, sf_dir, "customer").where(k % 3 != 0)
    return rows.select(sha_of(k).alias("sha"), F.floor(k / 7).cast("long").alias("group_id"), (1 + k % 6).cast("int").alias("detection_type"), similar.alias("similarity"))


def full_save(spark, d):
    """A save: scores, the threshold, group ids old and new, evidence, stale rows that stay."""
    k, stored = F.col("c_custkey"), stored_short(spark, d)
    rows = table(spark, d, "customer").where(k % 4 != 0)
    members = rows.select(sha_of(k).alias("sha"), F.concat("c_mktsegment", F.lit(" "), (k % 97).cast("string")).alias("component"))
    scores = rows.where(k % 5 != 0).select(sha_of(k).alias("sha"), ((k * 53 % 101).cast("double") / 100).alias("similarity"))
    fresh = rows.select(sha_of(k).alias("src"), sha_of(k).alias("dst"), (1 + k % 5).cast("int").alias("detection_type"))
    return pipeline.save_plan(members, scores, tiers.evidence(fresh, stored), stored)[0]


def patch_contraction(spark, d):
    """Tier 5 behind its gate: patches of subjects that tags and messages leave apart, components merged."""
    rows = prepared(spark, d)
    edges = tiers.tag_edges(rows).unionByName(tiers.message_links(rows))
    members = materialize(connected_components(rows.select("sha"), edges, key="sha"), "members")
    return pipeline.patch_links(members, rows, lambda shas: patch_ids(rows.join(shas, "sha", "left_semi")))[1]


def seed_stars(spark, d):
    return pipeline.seed_edges(hashes(spark, d))


def rescan_set(spark, d):
    """What a scan looks at: revisions after the checkpoint, here every third document, and what is stored."""
    news = commits(spark, d).where(F.col("doc_id") % 3 == 0).select("sha")
    return news.union(hashes(spark, d).where("similarity >= 0.75").select("sha")).distinct()


def checkpoint_upsert(spark, d):
    """The state after a scan: the last revision in place of the former one."""
    state = spark.createDataFrame([("last_commit", "0" * 40), ("layout", "1")], store.STATE_SCHEMA)
    last = table(spark, d, "documents").agg(F.max_by(sha_of(F.col("doc_id")), "doc_id").alias("sha")).first()["sha"]
    return store.put_state(state, store.LAST_COMMIT, F.lit(last))


def compliance_totals(spark, d):
    files = lists.parse_patches(patches(spark, d))
    return verify.totals(files, verify.judge_patches(files, hashes(spark, d)))


def point_lookup(spark, d):
    return store.visible(hashes(spark, d).where(F.col("sha") == F.sha1(F.lit("5"))), excluded(spark, d)).select("sha", "group_id")


def lookup_targets(spark, d):
    """Every document asks for something: a group by its id in three spellings, or a hash by its beginning."""
    n = F.col("doc_id")
    asked = F.when(n % 4 == 0, F.concat(F.lit(" G"), n.cast("string"))).when(n % 4 == 1, F.concat(F.lit("#"), n.cast("string"))).when(n % 4 == 2, n.cast("string"))
    asked = table(spark, d, "documents").select(F.coalesce(asked, F.upper(F.substring(sha_of(n), 1, 7))).alias("target"))
    return store.resolve_targets(asked, hashes(spark, d), excluded(spark, d))


def first_match(spark, d):
    return store.first_match(hashes(spark, d), "c", excluded(spark, d))


def message_search_counts(spark, d):
    found = store.search_messages(commits(spark, d), "license|copyright")
    return store.search_counts(found, hashes(spark, d).where("detection_type < 4"))


def incremental_components(spark, d):
    """New links over stored groups, which count as single vertices: here the commits of types 1 to 3, a group per subject."""
    rows, edges = _linked(spark, d)
    stored = materialize(hashes(spark, d).where("detection_type < 4"), "stored")
    found = incremental.incremental_components(rows.select("sha"), materialize(edges.select("src", "dst"), "edges"), stored)
    return found.join(rows.select("sha"), "sha", "left_semi")


def store_appends(spark, d):
    """A store on disk after a whole save and three appends: rows put over others, rows deleted, and some of these put again."""
    old = hashes(spark, d)
    kept = store.Store.create(spark, shared_path(spark, "store"))
    kept.save(old, spark.createDataFrame([], store.STATE_SCHEMA))
    kept.append(old.where("group_id % 2 = 0").select("sha", (F.col("group_id") + 1).alias("group_id"), F.lit(1).alias("detection_type"), F.lit(0.9).alias("similarity")))
    gone = old.where("detection_type = 5")
    kept.append(old.limit(0), gone.select("sha"))
    kept.append(gone.where("group_id % 3 = 0").select("sha", F.lit(7).cast("long").alias("group_id"), "detection_type", F.lit(None).cast("double").alias("similarity")))
    return kept.hashes


def resolve_batch(spark, d):
    """Every document asks for a hash: by its beginning of 1 to 9 digits, as a whole, in upper case, one that is none, or by something else."""
    n = F.col("doc_id")
    asked = F.when(n % 7 == 0, F.concat(F.lit("x"), n.cast("string"))).when(n % 7 == 1, sha_of(n)).when(n % 7 == 2, F.upper(F.substring(sha_of(n), 1, 9)))
    asked = asked.when(n % 7 == 3, F.concat(sha_of(n), F.lit("0"))).otherwise(F.concat(F.lit(" "), F.substring(sha_of(n), F.lit(1), (n % 5 + 1).cast("int"))))
    return store.resolve_all(table(spark, d, "documents").select(asked.alias("target")), hashes(spark, d), excluded(spark, d))


def message_index_search(spark, d):
    """Commits whose message has a text, found by the index of all messages' trigrams."""
    index = messages.MessageIndex(spark, shared_path(spark, "messages"))
    index.write(commits(spark, d))
    return index.search("All Rights reserved")


def raw_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, diff)``: documents as added lines of one file beside a second one, in turns; every other one stands elsewhere, in other white space."""
    n, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    place = F.concat(F.lit("@@ -"), n.cast("string"), F.lit(",3 +"), (n + 1).cast("string"), F.lit(" @@ f()\n"))
    spaced = F.when(n % 2 == 0, F.regexp_replace(t, " ", "  ")).otherwise(t)
    one = F.concat(F.lit("diff --git a/x b/x\nindex "), F.substring(sha_of(n), 1, 7), F.lit("..0 100644\n--- a/x\n+++ b/x\n"), place, F.lit("+"), F.replace(spaced, F.lit("\n"), F.lit("\n+")), F.lit("\n\\ No newline at end of file\n"))
    two = F.concat(F.lit("diff --git a/y b/y\nnew file mode 100644\n--- /dev/null\n+++ b/y\n"), place, F.lit("+"), F.coalesce("source", F.lit("")), F.lit("\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(n % 3 == 0, F.concat(two, one)).otherwise(F.concat(one, two)).alias("diff"))


def patch_id_of_diff(spark, d):
    """Which documents' diffs change the same: each with the least document of its patch id."""
    rows = materialize(raw_diffs(spark, d).select("doc_id", text.patch_id("diff").alias("patch_id")), "ids")
    first = rows.groupBy("patch_id").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return rows.join(first, "patch_id").select("doc_id", "patch_id", "first_id", "n")


def text_fields(spark, d):
    """Small functions of text on all documents: whole numbers, sizes, hashes and their bytes, stripped names."""
    n = F.col("doc_id")
    said = F.when(n % 3 == 0, F.concat(F.lit(" "), n.cast("string"))).otherwise(F.concat(n.cast("string"), F.lit("x")))
    return table(spark, d, "documents").select(
        "doc_id",
        text.safe_long(text.strip_space(said)).alias("number"),
        text.human_size(F.coalesce("n_chars", F.lit(0)) * F.coalesce("n_chars", F.lit(0)) * 64).alias("size"),
        text.short_sha(sha_of(n)).alias("short"),
        text.is_sha(sha_of(n)).alias("whole"),
        text.sha_text(text.sha_bytes(sha_of(n))).alias("again"),
        text.normalize_phrase(F.coalesce("source", F.lit(" A  b "))).alias("phrase"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        text_strip_trailers, text_normalize_diff, tag_edges, tier2_timestamp_pairs, tier3_message_pairs, tier4_fuzzy_pairs, tier2_short_messages,
        tier4_short_messages, group_similarity_short, indel_ratio_pairs,
        file_guard_pairs, file_overlap_degrees, time_band_pairs, subject_buckets, bucket_size_window, ambiguous_subjects, patch_groups, group_similarity,
        evidence_min_type, run_counters, assign_group_ids, upsert_hashes, stats_totals, type_histogram, group_size_stats, top5_groups, group_list,
        member_list, group_blacklist_state, prefix_lookup, siblings, same_group, message_search, blacklist_anti, distinct_union, toggle_blacklist,
        patch_header_extract, patch_compliance, full_save, patch_contraction, seed_stars, rescan_set, checkpoint_upsert, compliance_totals,
        point_lookup, lookup_targets, first_match, message_search_counts, text_fields, incremental_components, store_appends, tier3_components, patch_id_of_diff, message_index_search, resolve_batch,
    )
} | {"connected_components": components}


# -- DuckDB ---------------------------------------------------------------------------------------


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{text.SPACE}+|{text.SPACE}+\\z', '', 'g')"


COMMITS = f"""
d AS (
    SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS s, coalesce(lang, '') AS l, coalesce(n_chars, 0) AS n FROM documents
), raw AS (
    SELECT doc_id, sha1(CAST(doc_id AS VARCHAR)) AS sha, s AS author_name, 1700000000 + (n + doc_id % 2) % 150 * 86400 AS author_date,
           trim(split_part(t, chr(10), 1)) AS subject, [l || '/' || CAST(doc_id % 3 AS VARCHAR), s] AS files,
           CASE WHEN strpos(t, chr(10)) > 0 THEN substr(t, strpos(t, chr(10)) + 1) ELSE '' END
           || CASE WHEN doc_id % 17 = 0 THEN chr(10) || chr(10) || 'Signed-off-by: A B <a@example.com>' || chr(10)
                   || '(cherry picked from commit ' || sha1(CAST(doc_id - 1 AS VARCHAR)) || ')' ELSE '' END AS body
    FROM d
), lined AS (
    SELECT *, regexp_split_to_array({_strip("body")}, '{text.LINE_BREAK}') AS lines FROM raw
), placed AS (
    SELECT *, list_max(list_transform(lines, lambda x, i: CASE WHEN {_strip("x")} = '' OR regexp_matches({_strip("x")}, '{text.TRAILER}') THEN 0 ELSE i END)) AS last
    FROM lined
), commits AS (
    SELECT * EXCLUDE (lines, last), trim(regexp_replace(lower(array_to_string(lines[1:last], ' ')), '{text.SPACE}+', ' ', 'g')) AS cleaned_body FROM placed
)"""
HASHES = """
named AS (SELECT doc_id, sha1(CAST(doc_id AS VARCHAR)) AS sha, trim(split_part(coalesce(text, ''), chr(10), 1)) AS subject FROM documents),
hashes AS (
    SELECT sha, min(doc_id) OVER (PARTITION BY subject) AS group_id, CAST(1 + doc_id % 6 AS INT) AS detection_type,
           CASE WHEN doc_id % 11 <> 0 THEN CAST(doc_id * 37 % 101 AS DOUBLE) / 100 END AS similarity
    FROM named
), excluded AS (SELECT sha FROM named WHERE doc_id % 7 = 3),
seen AS (SELECT * FROM hashes WHERE sha NOT IN (SELECT sha FROM excluded))"""
PAIRS = """
pairs AS (
    SELECT a.sha AS sha_a, b.sha AS sha_b, a.author_date AS date_a, b.author_date AS date_b, a.files AS files_a, b.files AS files_b,
           a.cleaned_body AS body_a, b.cleaned_body AS body_b
    FROM commits a JOIN commits b ON a.subject = b.subject AND a.subject <> '' AND a.sha < b.sha
)"""
TAGS = f"tags AS (SELECT sha AS src, lower(regexp_extract(body, '{text.TAG}', 1)) AS dst FROM commits WHERE regexp_extract(body, '{text.TAG}', 1) <> '')"
FILES_OK, DATES_OK = "list_has_any(files_a, files_b)", "date_a <> 0 AND date_b <> 0 AND abs(date_a - date_b) <= 6480000"
TIER3 = f"tier3 AS (SELECT sha_a AS src, sha_b AS dst FROM pairs WHERE {FILES_OK} AND {DATES_OK} AND date_a <> date_b AND body_a = body_b AND length(body_a) > 30)"
TIER5 = """
patch AS (SELECT sha1(subject || ' ' || cleaned_body) AS patch_id, subject, sha FROM commits),
tier5 AS (SELECT m AS src, sha AS dst FROM (SELECT sha, min(sha) OVER (PARTITION BY patch_id, subject) AS m FROM patch) WHERE m <> sha)"""


def _closure(*edges: str) -> str:
    """Components of all commits over the named edges: each vertex with the least it reaches."""
    union = " UNION ALL ".join(f"SELECT src, dst FROM {e}" for e in edges)
    return f"""
links AS (SELECT src AS a, dst AS b FROM ({union}) UNION SELECT dst, src FROM ({union})),
reach(sha, other) AS (SELECT sha, sha FROM commits UNION SELECT r.sha, links.b FROM reach r JOIN links ON links.a = r.other),
comp AS (SELECT sha, min(other) AS component FROM reach GROUP BY sha)"""


def _lcs(pairs: str) -> str:
    """``done`` (columns of the pairs, twice_lcs) from rows with texts a and b, by the table of their common subsequences, row by row."""
    return f"""
lcs AS (
    SELECT a, b, 0 AS i, list_transform(range(length(b) + 1), lambda x: CAST(0 AS BIGINT)) AS row FROM (SELECT DISTINCT a, b FROM {pairs})
    UNION ALL
    SELECT a, b, i + 1, list_reduce(list_concat([[CAST(0 AS BIGINT)]], list_transform(range(1, length(b) + 1), lambda j: [j])),
        lambda acc, e: list_append(acc, CASE WHEN substr(a, i + 1, 1) = substr(b, e[1], 1) THEN row[e[1]] + 1 ELSE greatest(row[e[1] + 1], acc[len(acc)]) END))
    FROM lcs WHERE i < length(a)
), done AS (SELECT p.*, CAST(2 * row[len(row)] AS BIGINT) AS twice_lcs FROM {pairs} p JOIN lcs ON lcs.a = p.a AND lcs.b = p.b AND i = length(p.a))"""


SHORT = f"""
short AS (
    SELECT sha1(CAST(c_custkey AS VARCHAR)) AS sha, 'a' || CAST(c_custkey % 2 AS VARCHAR) AS author_name, 1700000000 + c_custkey * 7 % 40 * 86400 AS author_date,
           c_mktsegment || ' ' || CAST(c_nationkey AS VARCHAR) AS subject, lower(c_name) || ' ' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, c_custkey % 13) AS body,
           c_custkey % 3 % 2 AS file
    FROM customer
), mates AS (
    SELECT x.sha AS src, y.sha AS dst, x.body AS a, y.body AS b, x.author_name AS author_a, y.author_name AS author_b, x.author_date AS date_a, y.author_date AS date_b,
           x.subject, x.file = y.file AND abs(x.author_date - y.author_date) <= 6480000 AS fits
    FROM short x JOIN short y ON x.subject = y.subject AND x.sha < y.sha
), {_lcs("mates")}, strict AS (
    SELECT src, dst, twice_lcs FROM done WHERE fits AND date_a = date_b AND twice_lcs >= 0.75 * (length(a) + length(b))
)"""
BASE = f"WITH RECURSIVE {COMMITS}, {PAIRS}, {TAGS}, {TIER3}, {TIER5}"
EDGES = "edges AS (SELECT src, dst, 1 AS k FROM tags UNION ALL SELECT src, dst, 3 FROM tier3 UNION ALL SELECT src, dst, 5 FROM tier5)"
LABELS = ", ".join(f"({k}, '{name}', '{label}')" for k, (name, label) in store.LABELS.items())
PATCHES = f"""
files AS (
    SELECT 'p/' || CAST(doc_id AS VARCHAR) || '.patch' AS path, 'From: x' || chr(10) || '  Git-commit: [ ' || sha1(CAST(doc_id AS VARCHAR)) || ' ]' || chr(10)
           || CASE WHEN doc_id % 3 <> 0 THEN 'Alt-commit: <' || upper(sha1(CAST(doc_id + doc_id % 5 AS VARCHAR))) || '>' || chr(10) ELSE '' END || coalesce(text, '') AS value
    FROM documents
), heads AS (
    SELECT path, list_transform(regexp_extract_all(value, '{text.GIT_HEADER}', 1), lambda x: lower(x)) AS git_shas,
           list_transform(regexp_extract_all(value, '{text.ALT_HEADER}', 1), lambda x: lower(x)) AS alt_shas
    FROM files
)"""

JUDGED = f"""
        {HASHES}, {PATCHES}, u AS (
            SELECT path, unnest(list_concat(git_shas, alt_shas)) AS sha, unnest(range(len(git_shas) + len(alt_shas))) AS pos FROM heads WHERE len(alt_shas) > 0
        ), f AS (SELECT path, sha, min(pos) AS pos FROM u GROUP BY ALL), j AS (SELECT f.*, group_id FROM f LEFT JOIN hashes USING (sha)), r AS (
            SELECT path, count(*) FILTER (group_id IS NULL) AS missing, count(DISTINCT group_id) AS groups,
                   array_to_string(list(sha ORDER BY pos) FILTER (group_id IS NULL)[1:3], ', ') AS first3,
                   array_to_string(list(substr(sha, 1, 10) || '->GID:' || CAST(group_id AS VARCHAR) ORDER BY pos), ', ') AS details
            FROM j GROUP BY path), t AS (
            SELECT path, CASE WHEN missing > 0 THEN 'Missing from DB: ' || first3 || CASE WHEN missing > 3 THEN ' (+' || CAST(missing - 3 AS VARCHAR) || ' more)' ELSE '' END
                              WHEN groups > 1 THEN 'Split across multiple groups (' || details || ')' END AS reason FROM r)"""

ORACLE: dict[str, str] = {
    "text_strip_trailers": f"WITH {COMMITS} SELECT sha, cleaned_body FROM commits",
    "text_normalize_diff": f"""
        SELECT doc_id, {_strip(f"regexp_replace(regexp_replace(x, '{text.INDEX_LINE}', '', 'g'), '{text.HUNK}', '@@', 'g')")} AS diff
        FROM (SELECT doc_id, 'diff --git a/f b/f' || chr(10) || 'index 12ab..34CD 100644' || chr(10) || '--- a/f' || chr(10) || '+++ b/f' || chr(10)
              || '@@ -1,2 +1,3 @@ ctx' || chr(10) || coalesce(text, '') || chr(10) || '@@ -9 +9 @@ ' || chr(10) AS x FROM documents)""",
    "tag_edges": f"WITH {COMMITS}, {TAGS} SELECT src, dst FROM tags",
    "tier3_message_pairs": f"WITH {COMMITS}, {PAIRS}, {TIER3} SELECT src, dst FROM tier3",
    "tier2_short_messages": f"WITH RECURSIVE {SHORT} SELECT src, dst, twice_lcs FROM strict",
    "tier4_short_messages": f"""WITH RECURSIVE {SHORT}, free AS (
            SELECT sha, count(*) OVER (PARTITION BY subject) AS n FROM short WHERE sha NOT IN (SELECT src FROM strict UNION SELECT dst FROM strict))
        SELECT src, dst, twice_lcs FROM done JOIN free f ON f.sha = src AND f.n <= 50 JOIN free g ON g.sha = dst
        WHERE fits AND least(length(a), length(b)) >= 0.70 * greatest(length(a), length(b))
              AND twice_lcs >= CASE WHEN author_a = author_b THEN 0.85 ELSE 0.90 END * (length(a) + length(b))""",
    "group_similarity_short": f"""WITH RECURSIVE {SHORT}, ends AS (
            SELECT src AS sha, twice_lcs / (length(a) + length(b)) AS r FROM done UNION ALL SELECT dst, twice_lcs / (length(a) + length(b)) FROM done)
        SELECT sha, CAST(round(avg(r) * 10000) AS BIGINT) AS score FROM ends GROUP BY sha""",
    "indel_ratio_pairs": """
        WITH RECURSIVE p AS (
            SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_name < y.n_name
        ), lcs(a, b, i, row) AS (
            SELECT a, b, 0, list_transform(range(length(b) + 1), lambda x: CAST(0 AS BIGINT)) FROM p
            UNION ALL
            SELECT a, b, i + 1, list_reduce(list_concat([[CAST(0 AS BIGINT)]], list_transform(range(1, length(b) + 1), lambda j: [j])),
                lambda acc, e: list_append(acc, CASE WHEN substr(a, i + 1, 1) = substr(b, e[1], 1) THEN row[e[1]] + 1 ELSE greatest(row[e[1] + 1], acc[len(acc)]) END))
            FROM lcs WHERE i < length(a)
        ) SELECT a, b, CAST(2 * row[len(row)] AS BIGINT) AS twice_lcs, CAST(length(a) + length(b) AS BIGINT) AS total FROM lcs WHERE i = length(a)""",
    "file_overlap_degrees": f"""WITH {COMMITS}, shown AS (SELECT sha, subject, CASE WHEN doc_id % 5 <> 0 THEN files ELSE [] END AS files FROM commits WHERE subject <> ''),
met AS (
    SELECT a.sha, list_has_any(a.files, b.files) AS shared, len(a.files) = 0 OR len(b.files) = 0 AS free
    FROM shown a JOIN shown b ON a.subject = b.subject AND a.sha <> b.sha
)
SELECT sha, count(*) FILTER (WHERE shared) AS n_shared, count(*) FILTER (WHERE shared OR free) AS n_agree FROM shown LEFT JOIN met USING (sha) GROUP BY sha""",
    "file_guard_pairs": f"WITH {COMMITS}, {PAIRS} SELECT sha_a, sha_b FROM pairs WHERE {FILES_OK}",
    "time_band_pairs": f"WITH {COMMITS}, {PAIRS} SELECT sha_a, sha_b FROM pairs WHERE {DATES_OK}",
    "subject_buckets": f"WITH {COMMITS} SELECT subject, count(*) AS n, min(sha) AS first_sha FROM commits WHERE subject <> '' GROUP BY subject HAVING count(*) >= 2",
    "bucket_size_window": f"WITH {COMMITS} SELECT sha, count(*) OVER (PARTITION BY subject) AS bucket_size FROM commits WHERE subject <> ''",
    "connected_components": f"{BASE}, {_closure('tags', 'tier3', 'tier5')} SELECT sha, component FROM comp",
    "ambiguous_subjects": f"""{BASE}, {_closure("tags", "tier3")}
        SELECT subject FROM commits JOIN comp USING (sha) WHERE subject <> '' GROUP BY subject HAVING count(*) >= 2 AND count(DISTINCT component) > 1""",
    "patch_groups": f"WITH {COMMITS}, {TIER5} SELECT patch_id, subject, count(*) AS n FROM patch GROUP BY ALL HAVING count(*) > 1",
    "evidence_min_type": f"""{BASE}, {HASHES}, {EDGES}
        SELECT sha, min(k) AS detection_type FROM (SELECT src AS sha, k FROM edges UNION ALL SELECT dst, k FROM edges UNION ALL SELECT sha, detection_type FROM hashes) GROUP BY sha""",
    "run_counters": f"""{BASE}, {EDGES}, fresh AS (SELECT sha FROM commits WHERE doc_id % 2 = 0)
        SELECT k AS detection_type, count(*) AS groups, CAST(sum(c) AS BIGINT) AS commits FROM (
            SELECT k, CAST(src IN (SELECT sha FROM fresh) AS INT) + CAST(dst IN (SELECT sha FROM fresh) AS INT) AS c FROM edges) WHERE c > 0 GROUP BY k""",
    "assign_group_ids": f"""{BASE}, {_closure("tags", "tier3", "tier5")}, g AS (
            SELECT component, count(*) AS n, min(CASE WHEN doc_id % 13 = 0 THEN doc_id END) AS old, min(sha) AS first FROM commits JOIN comp USING (sha) GROUP BY component)
        SELECT component, old AS group_id FROM g WHERE old IS NOT NULL
        UNION ALL SELECT component, 1000000 + row_number() OVER (ORDER BY first) FROM g WHERE old IS NULL AND n >= 2""",
    "upsert_hashes": f"""WITH {HASHES}, fresh AS (SELECT sha, group_id + 1 AS group_id, 1 AS detection_type, CAST(0.9 AS DOUBLE) AS similarity FROM hashes WHERE group_id % 2 = 0)
        SELECT * FROM (SELECT * FROM hashes WHERE sha NOT IN (SELECT sha FROM fresh) UNION ALL SELECT * FROM fresh) WHERE similarity IS NULL OR similarity >= 0.75""",
    "stats_totals": f"WITH {HASHES} SELECT count(*) AS total_hashes, count(DISTINCT group_id) AS total_groups FROM seen",
    "type_histogram": f"""WITH {HASHES}, dim(code, name, label) AS (VALUES {LABELS}), h AS (SELECT detection_type AS code, count(*) AS cnt FROM seen GROUP BY ALL), x AS (
            SELECT code, coalesce(label, 'Unknown Type #' || CAST(code AS VARCHAR)) AS label, coalesce(cnt, 0) AS cnt FROM dim FULL JOIN h USING (code))
        SELECT code, label, cnt, cnt / sum(cnt) OVER () * 100 AS pct FROM x""",
    "group_size_stats": f"WITH {HASHES}, g AS (SELECT count(*) AS cnt FROM seen GROUP BY group_id) SELECT min(cnt) AS min_size, max(cnt) AS max_size, avg(cnt) AS avg_size FROM g",
    "top5_groups": f"WITH {HASHES} SELECT group_id, count(*) AS cnt FROM seen GROUP BY group_id ORDER BY cnt DESC, group_id LIMIT 5",
    "group_list": f"""WITH {COMMITS}, {HASHES}, hit AS (SELECT sha FROM commits WHERE regexp_matches(subject || chr(10) || chr(10) || body, '(?im)the')),
        g AS (SELECT group_id, count(*) AS cnt FROM seen WHERE detection_type = 2 AND sha IN (SELECT sha FROM hit) GROUP BY group_id),
        s AS (SELECT group_id, count(*) AS total, count(*) FILTER (sha IN (SELECT sha FROM excluded)) AS gone FROM hashes GROUP BY group_id)
        SELECT group_id, cnt, CASE gone WHEN 0 THEN 'none' WHEN total THEN 'all' ELSE 'partial' END AS state FROM g JOIN s USING (group_id)""",
    "member_list": f"""WITH {HASHES}, dim(code, name, label) AS (VALUES {LABELS})
        SELECT sha, substr(sha, 1, 10) AS short, coalesce(name, CAST(detection_type AS VARCHAR)) AS label,
               CASE WHEN similarity IS NULL THEN '' ELSE printf('%.2f', similarity) END AS shown, sha IN (SELECT sha FROM excluded) AS is_excluded
        FROM hashes LEFT JOIN dim ON code = detection_type WHERE group_id = 0""",
    "group_blacklist_state": f"""WITH {HASHES}, s AS (SELECT group_id, count(*) AS total, count(*) FILTER (sha IN (SELECT sha FROM excluded)) AS excluded FROM hashes GROUP BY group_id)
        SELECT *, CASE excluded WHEN 0 THEN 'none' WHEN total THEN 'all' ELSE 'partial' END AS state FROM s""",
    "prefix_lookup": f"WITH {HASHES} SELECT sha, group_id FROM seen WHERE sha LIKE 'b6%'",
    "siblings": f"WITH {HASHES} SELECT sha FROM seen WHERE group_id = 0 AND sha NOT LIKE 'b6%'",
    "same_group": f"""WITH {COMMITS}, {TAGS}, {HASHES}
        SELECT src, dst, coalesce(a.group_id = b.group_id, false) AS same FROM tags LEFT JOIN hashes a ON a.sha = src LEFT JOIN hashes b ON b.sha = dst""",
    "message_search": f"""WITH {COMMITS}, {HASHES} SELECT sha, group_id FROM hashes WHERE sha IN (
            SELECT sha FROM commits WHERE regexp_matches(subject || chr(10) || chr(10) || body, '(?im)license|copyright'))""",
    "blacklist_anti": f"WITH {HASHES} SELECT sha FROM seen",
    "distinct_union": f"WITH {HASHES} SELECT sha FROM named WHERE doc_id % 2 = 0 UNION SELECT sha FROM hashes WHERE detection_type < 4",
    "toggle_blacklist": f"""WITH {HASHES}, m AS (SELECT sha FROM hashes WHERE group_id = 0), whole AS (SELECT bool_and(sha IN (SELECT sha FROM excluded)) AS yes FROM m)
        SELECT sha FROM excluded WHERE NOT ((SELECT yes FROM whole) AND sha IN (SELECT sha FROM m)) UNION SELECT sha FROM m WHERE NOT (SELECT yes FROM whole)""",
    "patch_header_extract": f"WITH {PATCHES} SELECT path, array_to_string(git_shas, ',') AS git_shas, array_to_string(alt_shas, ',') AS alt_shas FROM heads",
    "patch_compliance": f"WITH {JUDGED} SELECT path, reason IS NULL AS compliant, reason FROM t",
    "compliance_totals": f"""WITH {JUDGED}
        SELECT (SELECT count(*) FROM heads) AS files, count(*) AS alt_tagged, count(*) FILTER (reason IS NULL) AS compliant, count(*) FILTER (reason IS NOT NULL) AS non_compliant FROM t""",
    "full_save": """WITH stored AS (
            SELECT sha1(CAST(c_custkey AS VARCHAR)) AS sha, c_custkey // 7 AS group_id, CAST(1 + c_custkey % 6 AS INT) AS detection_type,
                   CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey * 37 % 101 AS DOUBLE) / 100 END AS similarity FROM customer WHERE c_custkey % 3 <> 0
        ), m AS (
            SELECT sha1(CAST(c_custkey AS VARCHAR)) AS sha, c_mktsegment || ' ' || CAST(c_custkey % 97 AS VARCHAR) AS component, 1 + c_custkey % 5 AS kind,
                   CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey * 53 % 101 AS DOUBLE) / 100 END AS fresh FROM customer WHERE c_custkey % 4 <> 0
        ), kept AS (
            SELECT m.sha, component, coalesce(fresh, similarity, 1.0) AS score, group_id AS old, CAST(least(kind, coalesce(detection_type, 9)) AS INT) AS kind
            FROM m LEFT JOIN stored USING (sha) WHERE coalesce(fresh, similarity, 1.0) >= 0.75
        ), g AS (
            SELECT component, min(old) AS old, min(sha) AS first FROM kept GROUP BY component HAVING count(*) >= 2 OR min(old) IS NOT NULL
        ), ids AS (
            SELECT component, coalesce(old, (SELECT max(group_id) FROM stored) + row_number() OVER (PARTITION BY old IS NULL ORDER BY first)) AS group_id FROM g
        ), written AS (SELECT sha, group_id, kind AS detection_type, score AS similarity FROM kept JOIN ids USING (component))
        SELECT * FROM (SELECT * FROM stored WHERE sha NOT IN (SELECT sha FROM written) UNION ALL SELECT * FROM written) WHERE similarity IS NULL OR similarity >= 0.75""",
    "patch_contraction": f"""{BASE}, {_closure("tags", "tier3")}, split AS (
            SELECT subject FROM commits JOIN comp USING (sha) WHERE subject <> '' GROUP BY subject HAVING count(*) >= 2 AND count(DISTINCT component) > 1
        ), gated AS (SELECT sha, min(sha) OVER (PARTITION BY patch_id, subject) AS m FROM patch WHERE subject IN (SELECT subject FROM split)),
        ties AS (SELECT DISTINCT a.component AS a, b.component AS b FROM gated JOIN comp a ON a.sha = gated.sha JOIN comp b ON b.sha = m WHERE a.component <> b.component),
        both_ways AS (SELECT a, b FROM ties UNION SELECT b, a FROM ties),
        far(a, b) AS (SELECT DISTINCT component, component FROM comp UNION SELECT far.a, both_ways.b FROM far JOIN both_ways ON both_ways.a = far.b),
        roots AS (SELECT a, min(b) AS root FROM far GROUP BY a)
        SELECT sha, root AS component FROM comp JOIN roots ON a = component""",
    "seed_stars": f"WITH {HASHES}, c AS (SELECT sha AS dst, min(sha) OVER (PARTITION BY group_id) AS src FROM hashes) SELECT src, dst FROM c WHERE src <> dst",
    "rescan_set": f"WITH {HASHES} SELECT sha FROM named WHERE doc_id % 3 = 0 UNION SELECT sha FROM hashes WHERE similarity >= 0.75",
    "checkpoint_upsert": "SELECT 'layout' AS key, '1' AS value UNION ALL SELECT 'last_commit', sha1(CAST(max(doc_id) AS VARCHAR)) FROM documents",
    "point_lookup": f"WITH {HASHES} SELECT sha, group_id FROM seen WHERE sha = sha1('5')",
    "lookup_targets": f"""WITH {HASHES}, asked AS (
            SELECT CASE doc_id % 4 WHEN 0 THEN ' G' || CAST(doc_id AS VARCHAR) WHEN 1 THEN '#' || CAST(doc_id AS VARCHAR) WHEN 2 THEN CAST(doc_id AS VARCHAR)
                   ELSE upper(substr(sha1(CAST(doc_id AS VARCHAR)), 1, 7)) END AS target FROM documents
        ), clean AS (SELECT target, lower(regexp_replace(trim(target), '^#', '')) AS c FROM asked), told AS (
            SELECT target, c, TRY_CAST(regexp_extract(c, '^g?([0-9]{{1,18}})$', 1) AS BIGINT) AS gid FROM clean
        ), k AS (SELECT target, gid, gid IS NOT NULL AND (c LIKE 'g%' OR gid IN (SELECT group_id FROM seen)) AS is_group FROM told)
        SELECT target, CASE WHEN is_group THEN 'group' ELSE 'hash' END AS kind, CASE WHEN is_group THEN gid END AS gid FROM k""",
    "first_match": f"WITH {HASHES} SELECT group_id, sha FROM seen WHERE sha LIKE 'c%' ORDER BY sha LIMIT 1",
    "message_search_counts": f"""WITH {COMMITS}, {HASHES}, hit AS (SELECT sha FROM commits WHERE regexp_matches(subject || chr(10) || chr(10) || body, '(?im)license|copyright'))
        SELECT (SELECT count(*) FROM hit) AS matches, (SELECT count(*) FROM hashes WHERE detection_type < 4 AND sha IN (SELECT sha FROM hit)) AS stored""",
    "incremental_components": f"""{BASE}, {HASHES}, kept AS (SELECT sha, group_id FROM hashes WHERE detection_type < 4),
        seeds AS (SELECT min(sha) OVER (PARTITION BY group_id) AS src, sha AS dst FROM kept), {_closure("tags", "tier3", "tier5", "seeds")}
        SELECT sha, component FROM comp""",
    "tier3_components": f"{BASE}, {_closure('tier3')} SELECT sha, component FROM comp",
    "patch_id_of_diff": r"""WITH d AS (
            SELECT doc_id, '+' || replace(coalesce(text, ''), chr(10), chr(10) || '+') AS t, coalesce(source, '') AS s FROM documents
        ), files AS (
            SELECT doc_id, sha1(regexp_replace('a/x b/x --- a/x +++ b/x ' || t, '[ \t-\r]+', '', 'g')) AS one,
                   sha1(regexp_replace('a/y b/y new file mode 100644 --- /dev/null +++ b/y +' || s, '[ \t-\r]+', '', 'g')) AS two FROM d
        ), ids AS (SELECT doc_id, sha1(least(one, two) || greatest(one, two)) AS patch_id FROM files)
        SELECT doc_id, patch_id, min(doc_id) OVER (PARTITION BY patch_id) AS first_id, count(*) OVER (PARTITION BY patch_id) AS n FROM ids""".replace("\\\\", "\\"),
    "message_index_search": f"WITH {COMMITS} SELECT sha FROM commits WHERE contains(lower(subject || chr(10) || chr(10) || body), 'all rights reserved')",
    "resolve_batch": f"""WITH {HASHES}, asked AS (
            SELECT DISTINCT CASE doc_id % 7 WHEN 0 THEN 'x' || CAST(doc_id AS VARCHAR) WHEN 1 THEN sha WHEN 2 THEN upper(substr(sha, 1, 9)) WHEN 3 THEN sha || '0'
                   ELSE ' ' || substr(sha, 1, CAST(doc_id % 5 + 1 AS INT)) END AS target FROM named
        ), clean AS (SELECT target, lower(trim(target)) AS c FROM asked), met AS (
            SELECT target, c, count(seen.sha) AS n, min(group_id) AS gid FROM clean LEFT JOIN seen ON starts_with(seen.sha, c) GROUP BY target, c
        ), told AS (SELECT target, gid, CASE WHEN NOT regexp_full_match(c, '[0-9a-f]*') THEN 'malformed' WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS outcome FROM met)
        SELECT target, outcome, CASE WHEN outcome = 'found' THEN gid END AS gid FROM told""",
    "store_appends": f"""WITH {HASHES}
        SELECT sha, 7 AS group_id, detection_type, CAST(NULL AS DOUBLE) AS similarity FROM hashes WHERE detection_type = 5 AND group_id % 3 = 0
        UNION ALL SELECT sha, CASE WHEN group_id % 2 = 0 THEN group_id + 1 ELSE group_id END, CASE WHEN group_id % 2 = 0 THEN 1 ELSE detection_type END,
                  CASE WHEN group_id % 2 = 0 THEN 0.9 ELSE similarity END FROM hashes WHERE detection_type <> 5""",
    "text_fields": """WITH b AS (SELECT doc_id, sha1(CAST(doc_id AS VARCHAR)) AS sha, source, CAST(coalesce(n_chars, 0) * coalesce(n_chars, 0) * 64 AS DOUBLE) AS bytes FROM documents)
        SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE 0 END AS BIGINT) AS number,
               CASE WHEN bytes < 1024 THEN printf('%.2f B', bytes) WHEN bytes < 1048576 THEN printf('%.2f KB', bytes / 1024) WHEN bytes < 1073741824 THEN printf('%.2f MB', bytes / 1048576)
                    WHEN bytes < 1099511627776 THEN printf('%.2f GB', bytes / 1073741824) ELSE printf('%.2f TB', bytes / 1099511627776) END AS size,
               substr(sha, 1, 10) AS short, true AS whole, sha AS again, trim(regexp_replace(lower(coalesce(source, ' A  b ')), ' +', ' ', 'g')) AS phrase FROM b""",
}
