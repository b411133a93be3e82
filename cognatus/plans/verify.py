"""Whether the commits named in patch files are known and lie in one group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cognatus.sources import lists

SHOWN = 3


def totals(patches: DataFrame, judged: DataFrame) -> DataFrame:
    """``(files, alt_tagged, compliant, non_compliant)``, one row."""
    counts = judged.agg(F.count(F.lit(1)).alias("alt_tagged"), F.count_if("compliant").alias("compliant"), F.count_if(~F.col("compliant")).alias("non_compliant"))
    return patches.agg(F.count(F.lit(1)).alias("files")).crossJoin(counts)  # one row by one row


def judge_patches(patches: DataFrame, hashes: DataFrame) -> DataFrame:
    """``(path, compliant, reason)`` of the files with an alternative commit; missing outranks split."""
    tagged = patches.where(F.size("alt_shas") > 0).select("path", F.array_distinct(F.concat("git_shas", "alt_shas")).alias("shas"))
    each = tagged.select("path", F.posexplode("shas").alias("pos", "sha")).join(hashes.select("sha", "group_id"), "sha", "left")
    files = each.groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("pos", "sha", "group_id"))).alias("all"), F.countDistinct("group_id").alias("groups"), F.count_if(F.col("group_id").isNull()).alias("n_missing")
    )
    missing = F.transform(F.filter("all", lambda x: x["group_id"].isNull()), lambda x: x["sha"])
    # fixed values: the wording of the reasons
    more = F.when(F.col("n_missing") > SHOWN, F.concat(F.lit(" (+"), (F.col("n_missing") - SHOWN).cast("string"), F.lit(" more)"))).otherwise("")
    split = F.array_join(F.transform("all", lambda x: F.concat(F.substring(x["sha"], 1, 10), F.lit("->GID:"), x["group_id"].cast("string"))), ", ")
    reason = F.when(F.col("n_missing") > 0, F.concat(F.lit("Missing from DB: "), F.array_join(F.slice(missing, 1, SHOWN), ", "), more)).when(
        F.col("groups") > 1, F.concat(F.lit("Split across multiple groups ("), split, F.lit(")"))
    )
    return files.select("path", reason.isNull().alias("compliant"), reason.alias("reason"))


def verify(spark: SparkSession, folder: str, hashes: DataFrame, recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(summary, failures)`` of a folder of patch files, with paths below it. The exclusion list plays no part."""
    patches = lists.read_patches(spark, folder, recursive)
    judged = judge_patches(patches, hashes)
    root = lists.qualified(spark, folder).rstrip("/") + "/"
    below = F.when(F.col("path").startswith(root), F.substring("path", len(root) + 1, 1 << 30)).otherwise(F.col("path"))
    return totals(patches, judged), judged.where(~F.col("compliant")).select(below.alias("path"), "reason").orderBy("path")
