"""Exclusion lists and patch files."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cognatus.functions import text


def _file(spark: SparkSession, path: str):
    """Hadoop's file system and path object for ``path``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as files found below it are named."""
    fs, p = _file(spark, path)
    name = fs.makeQualified(p).toString()
    return name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name


def replace(spark: SparkSession, fresh: str, path: str) -> None:
    """Put a complete file in another's place in one step; there is no moment without either."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, new = _file(spark, fresh)
    _, old = _file(spark, path)
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf).rename(fs.makeQualified(new), fs.makeQualified(old), overwrite)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds; nothing if there is none."""
    fs, p = _file(spark, folder)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def size(spark: SparkSession, path: str) -> int:
    fs, p = _file(spark, path)
    return int(fs.getContentSummary(p).getLength())


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _file(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _file(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, content: str) -> bool:
    """Write a file that nobody else has written; False if it is there already. Whoever sees it sees all of it.

    The complete file takes its name in one step: by a hard link on a local disk, else by a rename that
    does not overwrite, which is atomic where the file system's renames are.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, fresh = _file(spark, f"{path}.{uuid.uuid4().hex}")
    _, target = _file(spark, path)
    fs.mkdirs(target.getParent())
    stream = fs.create(fresh, True)
    stream.write(bytearray(content.encode()))
    stream.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(fresh.toUri().getPath(), target.toUri().getPath())
        else:
            plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(fs.makeQualified(fresh), fs.makeQualified(target), plain)
        return True
    except (FileExistsError, Py4JJavaError):
        if not fs.exists(target):
            raise
        return False
    finally:
        fs.delete(fresh, False)


def read_exclusions(spark: SparkSession, path: str | None) -> DataFrame:
    """``(sha)``, distinct, lower-cased and stripped; a missing file is an empty list."""
    if not path or not exists(spark, path):
        return spark.createDataFrame([], "sha string")
    lines = spark.read.text(path).select(F.lower(text.strip_space("value")).alias("sha"))
    return lines.where("sha <> ''").distinct()


def write_exclusions(shas: DataFrame, path: str) -> None:
    """Sorted, one a line, in one file. The new list is complete before it takes the old one's place, in one step."""
    spark = shas.sparkSession
    path = path.rstrip("/")
    shas.select("sha").distinct().orderBy("sha").coalesce(1).write.mode("overwrite").text(path + ".new")
    fs, folder = _file(spark, path + ".new")
    part = next(f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
    _, old = _file(spark, path)
    if fs.exists(old) and fs.getFileStatus(old).isDirectory():  # as lists were kept once
        fs.rename(old, _file(spark, path + ".old")[1])
    replace(spark, part.toString(), path)
    fs.delete(folder, True)


def toggle(excluded: DataFrame, members: DataFrame) -> DataFrame:
    """The list with ``members`` all removed if all are in it, else all added; no members change nothing."""
    inside = members.join(excluded, "sha", "left_semi")
    all_in = members.select("sha").distinct().count() == inside.select("sha").distinct().count()
    if all_in:
        return excluded.join(members.select("sha"), "sha", "left_anti")
    return excluded.union(members.select("sha")).distinct()


def read_patches(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """``(path, git_shas, alt_shas)`` of the ``*.patch`` files of a folder."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.patch", recursiveFileLookup=recursive)
    return parse_patches(files.select(F.col("_metadata.file_path").alias("path"), "value"))


def parse_patches(files: DataFrame) -> DataFrame:
    """``(path, git_shas, alt_shas)`` from ``(path, value)``."""
    value = F.coalesce("value", F.lit(""))
    return files.select("path", text.header_shas(value, text.GIT_HEADER).alias("git_shas"), text.header_shas(value, text.ALT_HEADER).alias("alt_shas"))
