"""URL filters: a temporal join of captures with dated list entries.

An entry says that, from a time on, a pattern is blocked, allowed or removed from a list. The
entries of a pattern become validity intervals, each ending where the next entry of the same
list and pattern begins. A capture is judged by the entries active when it was fetched: the
most specific pattern decides, and at equal rank blocking wins.

All of it is DataFrame expressions. Scale: a capture turns into one row per key it could match
(its URL, its host, the domains above, the path prefixes as deep as any listed one), and keys
and a coarse time bucket are the join's equality, so an often re-listed pattern meets a capture
in one bucket only. Neither side is broadcast by request; a hot host or domain is split by
adaptive skew joins, as both sides are plain shuffles. The driver sees two scalars and the buckets in
which captures lie, of which all time has some 120,000; an entry has a row for each of those it is active in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of patterns, from the least specific to the most.
KINDS = ("domain", "host", "prefix", "url")
BUCKET_SECONDS = 30 * 86400


def host(url: Column | str) -> Column:
    """Lower-cased host of a URL, without user, port and final dot; null if there is none."""
    found = F.rtrim(F.lower(F.regexp_extract(url, r"^[^/?#]*//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("."))
    return F.when(F.length(found) > 0, found)


def path(url: Column | str) -> Column:
    """The URL's path, from its slash to the query or fragment."""
    return F.regexp_extract(url, r"^[^/?#]*//[^/?#]*([^?#]*)", 1)


def _domains(name: Column, deepest: Column) -> Column:
    """The host and the domains above it, up to so many labels."""
    labels = F.split(name, r"\.")
    most = F.least(F.size(labels), deepest)
    return F.transform(F.sequence(F.lit(1), most), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))


def _prefixes(name: Column, way: Column, deepest: Column) -> Column:
    """Host and path, cut after each segment down to so many."""
    parts = F.slice(F.split(way, "/"), 2, 1 << 30)
    most = F.least(F.size(parts), deepest)
    return F.transform(F.sequence(F.lit(1), most), lambda n: F.concat(name, F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))


def intervals(entries: DataFrame) -> DataFrame:
    """``(list, kind, pattern, action, since, until)`` from ``(list, kind, pattern, action, listed_at)``.

    ``until`` is null while an entry holds. Of entries of one list and pattern at one time,
    block outweighs allow and allow outweighs remove. Rows with a null in kind, pattern, action
    or time are no entries; a null list is a list of its own. Removals end an interval and
    begin none. Hosts and domains in patterns are lower-cased, and so is the host of a prefix; whole
    URLs are not.
    """
    weight = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).when(F.col("action") == "remove", 0)
    told = entries.where(F.col("kind").isin(*KINDS) & F.col("pattern").isNotNull() & F.col("listed_at").isNotNull() & weight.isNotNull())
    lowered = F.regexp_extract("pattern", "^([^/]*)", 1)
    lowered = F.concat(F.lower(lowered), F.substring("pattern", F.length(lowered) + 1, F.length("pattern")))
    told = told.withColumn("pattern", F.when(F.col("kind") == "url", F.col("pattern")).otherwise(lowered))
    told = told.groupBy("list", "kind", "pattern", "listed_at").agg(F.max(weight).alias("w"))
    after = Window.partitionBy("list", "kind", "pattern").orderBy("listed_at")
    return (
        told.withColumn("until", F.lead("listed_at").over(after))
        .where("w > 0")
        .select("list", "kind", "pattern", F.when(F.col("w") == 2, "block").otherwise("allow").alias("action"), F.col("listed_at").alias("since"), "until")
    )


def judge(captures: DataFrame, entries: DataFrame, *, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """``captures`` with ``verdict`` (block, allow or pass), and ``list``, ``pattern`` and ``since`` of the entry that decides.

    ``entries`` has list, kind, pattern, action, listed_at. Kinds: ``domain`` matches a host and
    all below it, ``host`` that host alone, ``prefix`` a host and path up to the end of a segment,
    ``url`` the whole URL. An entry is active from its time on, before its end. Url over
    prefix over host over domain, then the longer pattern, then block over allow, then the
    later entry, then list and pattern by code point decide. A null or odd URL or a null time
    passes. Repeated captures are rows like any other; columns of ``captures`` named like the
    results are replaced, and any other name may be there. Empty captures or entries are no error.
    """
    made = ("verdict", "list", "pattern", "since")
    captures = captures.drop(*[c for c in made if c in captures.columns])
    valid = intervals(entries)
    seconds = lambda c: F.unix_timestamp(c)
    depth = valid.agg(
        F.coalesce(F.max(F.when(F.col("kind") == "domain", F.size(F.split("pattern", r"\.")))), F.lit(0)).alias("labels"),
        F.coalesce(F.max(F.when(F.col("kind") == "prefix", F.size(F.split("pattern", "/")) - 1)), F.lit(0)).alias("segments"),
    ).first()
    bucket = lambda c: F.floor(c / F.lit(BUCKET_SECONDS)).cast("long")
    present = sorted(r[0] for r in captures.select(bucket(seconds(time_col))).distinct().collect() if r[0] is not None)
    times = F.array(*[F.lit(t) for t in present]) if present else F.array().cast("array<bigint>")
    held = F.filter(times, lambda t: (t >= bucket(seconds("since"))) & (F.col("until").isNull() | (t <= bucket(seconds("until")))))
    spans = valid.withColumn("__bucket", F.explode(held)).select(
        F.col("kind").alias("__kind"), F.col("pattern").alias("__pattern"), "__bucket", F.col("list").alias("__list"),
        F.col("action").alias("__action"), F.col("since").alias("__since"), F.col("until").alias("__until"),
    )

    name, way = host(url_col), path(url_col)
    key = lambda kind, patterns: F.transform(patterns, lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("pattern")))
    none = F.array().cast("array<struct<kind: string, pattern: string>>")
    keys = F.concat(
        key("url", F.array(F.col(url_col))),
        F.when(name.isNotNull(), key("host", F.array(name))).otherwise(none),
        F.when(name.isNotNull() & (F.lit(depth["labels"]) > 0), key("domain", _domains(name, F.lit(depth["labels"])))).otherwise(none),
        F.when(name.isNotNull() & way.startswith("/") & (F.lit(depth["segments"]) > 0), key("prefix", _prefixes(name, way, F.lit(depth["segments"])))).otherwise(none),
    )
    rows = captures.withColumns({"__row": F.monotonically_increasing_id(), "__at": seconds(time_col), "__keys": F.coalesce(F.when(F.col(url_col).isNotNull(), keys), none)})
    asked = rows.select(*[F.col(c) for c in captures.columns], "__row", "__at", F.explode_outer("__keys").alias("__key"))
    asked = asked.withColumns({"__k": F.col("__key.kind"), "__p": F.col("__key.pattern"), "__b": bucket(F.col("__at"))}).drop("__key")
    active = (
        (F.col("__k") == F.col("__kind"))
        & (F.col("__p") == F.col("__pattern"))
        & (F.col("__b") == F.col("__bucket"))
        & (seconds("__since") <= F.col("__at"))
        & (F.col("__until").isNull() | (F.col("__at") < seconds("__until")))
    )
    met = asked.join(spans, active, "left")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("__kind"))
    best = F.when(
        F.col("__kind").isNotNull(),
        F.struct(rank.alias("r"), F.length("__pattern").alias("n"), (F.col("__action") == "block").alias("b"), F.col("__since").alias("since"), F.col("__list").alias("list"), F.col("__pattern").alias("pattern")),
    )
    judged = met.groupBy("__row", *captures.columns).agg(F.max(best).alias("__best"))
    verdict = F.when(F.col("__best").isNull(), "pass").when(F.col("__best.b"), "block").otherwise("allow")
    return judged.select(*captures.columns, verdict.alias("verdict"), F.col("__best.list").alias("list"), F.col("__best.pattern").alias("pattern"), F.col("__best.since").alias("since"))
