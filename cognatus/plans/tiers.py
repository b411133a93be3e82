"""The five tiers of evidence that two commits carry the same change.

Each tier is a DataFrame of edges ``(src, dst, detection_type, sim)``. Tiers 2 to 4 block on the
exact subject (and on date or message, where the rule has them equal) and evaluate cheap guards
first; the similarity function runs last, on what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cognatus.functions import text
from cognatus.operators.blocks import scored_pairs
from cognatus.session import materialize

# The tiers' codes, in order of priority, and their thresholds.
TAG, TIMESTAMP, MESSAGE, FUZZY, PATCH = 1, 2, 3, 4, 5
MAX_GAP_SECONDS = 75 * 86400
MAX_FUZZY_BUCKET = 50
MIN_BODY = 30
TIMESTAMP_RATIO = 0.75
SAME_AUTHOR_RATIO, OTHER_AUTHOR_RATIO = 0.85, 0.90
LENGTH_RATIO = 0.70

COMMIT_SCHEMA = (
    "sha string, author_name string, author_date long, committer_date long, subject string, body string, cleaned_body string, files array<string>"
)


def edges_of(df: DataFrame, src: Column | str, dst: Column | str, kind: int, sim: Column | None = None) -> DataFrame:
    sim = F.lit(None).cast("double") if sim is None else sim
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return df.select(c(src).alias("src"), c(dst).alias("dst"), F.lit(kind).alias("detection_type"), sim.alias("sim"))


def tag_edges(commits: DataFrame) -> DataFrame:
    """Tier 1: from a commit to the one its first cherry-pick tag names, stored or not."""
    named = commits.select("sha", text.picked_from("body").alias("origin")).where("origin IS NOT NULL")
    return edges_of(named, "sha", "origin", TAG)


def files_agree(a: Column | str, b: Column | str) -> Column:
    """False only for two non-empty sets of files that share none."""
    a, b = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>")) for c in (a, b))
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def dates_agree(a: Column | str, b: Column | str) -> Column:
    """Two known dates at most 75 days apart; 0 is unknown."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return (a != 0) & (b != 0) & (F.abs(a - b) <= MAX_GAP_SECONDS)


LEAN = ("sha", "subject", "author_date")
#: Rows of one key that meet as many in one join key; a commoner key is several. So many rows travel once per as many others that they meet.
DEALT = 8000


def subject_pairs(commits: DataFrame, *equal: str, files: bool = True, banded: bool = False) -> DataFrame:
    """Pairs of rows with one non-empty subject, equal ``equal`` columns, and the guards passed: ``sha_a``, the smaller, and ``sha_b``; of the
    other columns only what both rows say alike tells which is which.

    ``banded`` puts a bucket of 75 days into the key, so that a common subject is many keys: rows
    within the gap lie in one bucket or in two neighbours. Keys are told apart by 128 bits of their SHA-256, so neither subjects nor messages travel with each
    part that a row meets. Rows of a key are dealt to parts of about ``DEALT``, every two of which meet in a key of their own, so the
    commonest key is no longest task.
    """
    rows = commits.where("subject <> '' AND author_date <> 0").select(*dict.fromkeys([*LEAN, *equal]), *(["files"] if files else []))
    whole = F.concat("subject", *[part for c in equal for part in (F.lit("\0"), F.col(c).cast("string"))])
    rows = rows.withColumn("key", F.substring(F.unhex(F.sha2(whole, 256)), 1, 16))
    keys = ["key"]
    parts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys, F.ceil(F.col("n") / F.lit(DEALT)).cast("int").alias("t"))
    rows = rows.join(parts, keys).withColumn("part", F.pmod(F.xxhash64("sha"), F.col("t")).cast("int"))
    a, b = (rows.select([F.col(c).alias(c + s) for c in rows.columns]) for s in ("_a", "_b"))
    a = a.withColumn("other_a", F.explode(F.sequence(F.col("part_a"), F.col("t_a") - 1)))
    b = b.withColumn("other_b", F.explode(F.sequence(F.lit(0), F.col("part_b"))))
    on = (F.col("part_a") == F.col("other_b")) & (F.col("other_a") == F.col("part_b"))
    if banded:
        bucket = lambda c: F.floor(F.col(c) / F.lit(MAX_GAP_SECONDS)).cast("long")
        near = F.array(*[bucket("author_date_a") + F.lit(k) for k in (-1, 0, 1)])
        a, b = a.withColumn("bucket_a", F.explode(near)), b.withColumn("bucket_b", bucket("author_date_b"))
        keys.append("bucket")
    on = on & ((F.col("part_a") < F.col("part_b")) | (F.col("sha_a") < F.col("sha_b"))) & dates_agree("author_date_a", "author_date_b")
    if files:
        on = on & files_agree("files_a", "files_b")
    for k in keys:
        on = on & (F.col(f"{k}_a") == F.col(f"{k}_b"))
    # by number, so that partitions small in bytes are not merged: their pairs are many
    n = int(commits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = a.repartition(n, *[f"{k}_a" for k in keys], "part_a", "other_a"), b.repartition(n, *[f"{k}_b" for k in keys], "other_b", "part_b")
    return a.join(b, on).withColumns({"sha_a": F.least("sha_a", "sha_b"), "sha_b": F.greatest("sha_a", "sha_b")})


def timestamp_scores(commits: DataFrame, ends: bool = False) -> DataFrame:
    """Tier 2 as :func:`scored_pairs` gives it: same subject and author date, message ratio of 0.75 or more."""
    return scored_pairs(commits.where("subject <> '' AND author_date > 0"), ["subject", "author_date"], TIMESTAMP_RATIO, ends=ends)


def timestamp_pairs(commits: DataFrame) -> DataFrame:
    """Tier 2: same subject and author date, message ratio of 0.75 or more."""
    return edges_of(timestamp_scores(commits), "src", "dst", TIMESTAMP, F.col("sim"))


def strict_ends(commits: DataFrame) -> DataFrame:
    """``(sha)`` of the commits that tiers 2 and 3 link, without their pairs; a hash may be there twice."""
    links = message_links(commits)
    return timestamp_scores(commits, ends=True).union(links.select("src")).union(links.select("dst"))


def message_pairs(commits: DataFrame) -> DataFrame:
    """Tier 3: same subject and message of over 30 characters, unless tier 2 has the pair.

    Equal messages have a ratio of one, so tier 2 has it exactly if the dates are equal and positive.
    Messages are told apart by their SHA-256, so none is shuffled or sorted.
    """
    digested = commits.where(F.length("cleaned_body") > MIN_BODY).withColumn("digest", F.sha2("cleaned_body", 256))
    pairs = subject_pairs(digested, "digest", banded=True)
    pairs = pairs.where("NOT (author_date_a > 0 AND author_date_a = author_date_b)")
    return edges_of(pairs, "sha_a", "sha_b", MESSAGE)


DAY = 86400


def _adjacent(levels: DataFrame, keys: list[str], rep: str) -> DataFrame:
    """``levels`` with ``before`` and ``after``: date and representative of the nearest levels of the keys that have one, on either side.

    Levels are distinct dates of a key. They are ordered within a day, of which there are at most 86,400, and days
    within a key, so no task sees all of a common key; what a day does not hold is carried over from the days beside it.
    """
    mark = F.when(F.col(rep).isNotNull(), F.struct("author_date", F.col(rep).alias("rep")))
    rows = levels.withColumn("day", F.floor(F.col("author_date") / F.lit(DAY)).cast("long")).withColumn("mark", mark)
    ahead = lambda by, *order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    rows = rows.withColumn("left", last("mark", ahead([*keys, "day"], "author_date"))).withColumn("right", last("mark", ahead([*keys, "day"], F.desc("author_date"))))
    days = rows.groupBy(*keys, "day").agg(F.min("mark").alias("low"), F.max("mark").alias("high"))
    days = days.withColumn("from_left", last("high", ahead(keys, "day"))).withColumn("from_right", last("low", ahead(keys, F.desc("day"))))
    rows = rows.join(days.drop("low", "high"), [*keys, "day"])
    return rows.withColumns({"before": F.coalesce("left", "from_left"), "after": F.coalesce("right", "from_right")}).drop("day", "mark", "left", "right", "from_left", "from_right")


def _links_to(rows: DataFrame, levels: DataFrame, keys: list[str], rep: str) -> DataFrame:
    """``(src, dst)`` from rows to the representatives of the levels beside theirs, at most 75 days away; before 1970, to their own level's as well."""
    beside = _adjacent(levels, keys, rep)
    own = F.when(F.col("author_date") < 0, F.struct("author_date", F.col(rep).alias("rep")))
    to = F.explode(F.array("before", "after", own)).alias("to")
    met = rows.join(beside, [*keys, "author_date"]).select("sha", "author_date", to)
    near = met.where((F.abs(F.col("author_date") - F.col("to.author_date")) <= MAX_GAP_SECONDS) & (F.col("sha") != F.col("to.rep")))
    return near.select(F.least("sha", "to.rep").alias("src"), F.greatest("sha", "to.rep").alias("dst"))


def message_links(commits: DataFrame) -> DataFrame:
    """Tier 3 without its cliques: pairs of :func:`message_pairs`, few of them, that connect the same commits.

    Dates of one subject and message are levels, each with a representative. Per file, a commit is linked with the
    representatives of the levels next to its own on either side; commits without files agree with all, so they are linked with
    the levels next to them whatever their files, and every commit with the nearest levels that have such commits. Two levels within 75
    days have no gap beyond that between them, so what all pairs connect is connected. Links grow with the commits' files, not
    with the square of a common subject.
    """
    rows = commits.where((F.length("cleaned_body") > MIN_BODY) & (F.col("subject") != "") & (F.col("author_date") != 0))
    key = F.sha2(F.concat("subject", F.lit("\0"), F.sha2("cleaned_body", 256)), 256)
    files = F.coalesce("files", F.array().cast("array<string>"))
    rows = materialize(rows.select("sha", "author_date", key.alias("key"), files.alias("files")), "messages")
    several = rows.groupBy("key").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).where("a <> b").select("key")
    rows = materialize(rows.join(several, "key", "left_semi"), "messages")
    by_file = rows.select("sha", "author_date", "key", F.explode(F.array_distinct("files")).alias("file"))
    file_levels = by_file.groupBy("key", "file", "author_date").agg(F.min("sha").alias("rep"))
    free = F.size("files") == 0
    every = rows.groupBy("key", "author_date").agg(F.min("sha").alias("rep"), F.min(F.when(free, F.col("sha"))).alias("free"))
    alone = rows.select("sha", "author_date", "key")
    links = _links_to(by_file, file_levels, ["key", "file"], "rep")
    links = links.union(_links_to(alone, every, ["key"], "free")).union(_links_to(alone.join(rows.where(free).select("sha"), "sha", "left_semi"), every, ["key"], "rep"))
    return edges_of(links.distinct(), "src", "dst", MESSAGE)


def ends_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("sha")).union(edges.select(F.col("dst").alias("sha")))


def fuzzy_candidates(commits: DataFrame, ends: DataFrame, most: int | None = MAX_FUZZY_BUCKET) -> DataFrame:
    """Rows that tiers 2 and 3 left alone, with a message, in subjects that 2 to ``most`` such rows share, or any number; ``ends`` has the others' hashes."""
    left = commits.where("subject <> '' AND cleaned_body <> ''").join(ends.select("sha").distinct(), "sha", "left_anti")
    if most is None:
        return left.select(commits.columns)
    sizes = left.groupBy("subject").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n").between(2, most))
    return left.join(sizes.select("subject"), "subject", "left_semi").select(commits.columns)


#: Rows of a tile of a subject, and characters, about: more than in tiles of a date, for a subject is larger and fewer of its pairs are compared to their ends.
FUZZY_ROWS, FUZZY_CHARS = 1024, 3_200_000


def fuzzy_scores(commits: DataFrame, ends: DataFrame, most: int | None = MAX_FUZZY_BUCKET) -> DataFrame:
    """Tier 4 as :func:`scored_pairs` gives it, of the rows that are not among ``ends``.

    A scan leaves out subjects of more than ``most`` such rows; with None every subject is compared whole.
    """
    some = fuzzy_candidates(commits, ends, most).where("author_date <> 0")
    return scored_pairs(some, ["subject"], SAME_AUTHOR_RATIO, OTHER_AUTHOR_RATIO, LENGTH_RATIO, MAX_GAP_SECONDS, tile=FUZZY_ROWS, chars=FUZZY_CHARS)


def fuzzy_pairs(commits: DataFrame, matched: DataFrame) -> DataFrame:
    """Tier 4: same subject, message ratio of 0.85 (same author, case aside) or 0.90."""
    return edges_of(fuzzy_scores(commits, ends_of(matched)), "src", "dst", FUZZY, F.col("sim"))


def ambiguous_subjects(labelled: DataFrame) -> DataFrame:
    """Subjects of two or more commits that lie in more than one component; ``labelled`` has subject and component."""
    return (
        labelled.where("subject <> ''")
        .groupBy("subject")
        .agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
        .where("n >= 2 AND low <> high")
        .select("subject")
    )


def patch_groups(patch_ids: DataFrame, subjects: DataFrame) -> DataFrame:
    """``(patch_id, subject, n, centre)`` of the patches that several commits of one subject share."""
    named = patch_ids.join(subjects.select("sha", "subject"), "sha", "left").withColumn("subject", F.coalesce("subject", F.lit("")))
    return named.groupBy("patch_id", "subject").agg(F.count(F.lit(1)).alias("n"), F.min("sha").alias("centre")).where("n > 1")


def patch_edges(patch_ids: DataFrame, subjects: DataFrame) -> DataFrame:
    """Tier 5: a star per patch and subject, on the least hash. No guard on files or dates."""
    named = patch_ids.join(subjects.select("sha", "subject"), "sha", "left").withColumn("subject", F.coalesce("subject", F.lit("")))
    groups = patch_groups(patch_ids, subjects)
    members = named.join(groups, ["patch_id", "subject"]).where("sha <> centre")
    return edges_of(members, "centre", "sha", PATCH)


def evidence(edges: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``(sha, detection_type)``: the strongest tier of each endpoint, stored types among the evidence."""
    ends = edges.select(F.col("src").alias("sha"), "detection_type").union(edges.select(F.col("dst").alias("sha"), "detection_type"))
    if stored is not None:
        ends = ends.union(stored.select("sha", "detection_type"))
    return ends.groupBy("sha").agg(F.min("detection_type").alias("detection_type"))


def bucket_sizes(commits: DataFrame) -> DataFrame:
    """``(sha, subject, bucket_size)`` for commits with a subject; counted with map-side combine, so a common subject is no single task."""
    rows = commits.where("subject <> ''").select("sha", "subject")
    return rows.join(rows.groupBy("subject").agg(F.count(F.lit(1)).alias("bucket_size")), "subject").select("sha", "subject", "bucket_size")


def counters(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Per tier: edges with a new commit, and their new endpoints, each as often as it occurs."""
    fresh = new.select(F.col("sha").alias("__new"), F.lit(1).alias("__one"))
    for end in ("src", "dst"):
        edges = edges.join(fresh, F.col(end) == F.col("__new"), "left").withColumn(f"__{end}", F.coalesce("__one", F.lit(0))).drop("__new", "__one")
    total = F.col("__src") + F.col("__dst")
    return edges.where(total > 0).groupBy("detection_type").agg(F.count(F.lit(1)).alias("groups"), F.sum(total).alias("commits"))
