"""Session settings and the shared folder in which long plans are cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "cognatus", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.

    Only a local session may leave it unset; a temporary folder stands in there.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + os.path.join(tempfile.gettempdir(), "cognatus-" + spark.sparkContext.applicationId)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, under this application's name."""
    return f"{shared_dir(spark)}/cognatus/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cognatus_path = path
    return out


def spread(table: DataFrame) -> DataFrame:
    """A table as read, dealt out to all cores if it has fewer partitions than there are; only small tables have."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def discard(table: DataFrame) -> None:
    """Delete a materialized table that nothing will read again."""
    _delete(table.sparkSession, table._cognatus_path)


def release(spark: SparkSession) -> None:
    """Delete all tables this application has materialized."""
    _delete(spark, f"{shared_dir(spark)}/cognatus/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
