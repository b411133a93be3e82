"""A stream of revisions that keeps a store up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cognatus.plans.pipeline import scan_given
from cognatus.plans.store import Store
from cognatus.sources import git


def revision_stream(spark: SparkSession, repo: str, start: str | None = None) -> DataFrame:
    """Revisions ``(ord, sha)`` as they appear; offsets are commit hashes."""
    git.register(spark)
    options = {"repo": repo, "table": "revisions"} | ({"start": start} if start else {})
    return spark.readStream.format("gitlog").options(**options).load()


def link_batch(rows: DataFrame, number: int, repo: str, store: Store, stream: str) -> bool:
    """Link a micro-batch's own commits, with each other and with the stored ones of their subjects; whether it was new.

    The store is the stream's state: it is keyed by subject, and its manifest tells the stream's last batch, saved in
    one step with the rows. Spark repeats no batch but the last, if the query failed before it could note the end; then
    it is known by its number and newest commit, and changes nothing.
    """
    newest = rows.agg(F.max_by("sha", "ord").alias("sha")).first()["sha"]
    key, batch = f"stream:{stream}", f"{number} {newest}"
    if newest is None or store._manifest()["state"].get(key) == batch:
        return False
    scan_given(rows.select("sha"), repo, store, newest, state={key: batch})
    return True


def follow(spark: SparkSession, repo: str, store: Store, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Link revisions as they arrive; ``checkpoint`` is the query's own folder and names the stream in the store."""
    stream = checkpoint.rstrip("/").rsplit("/", 1)[-1]
    writer = revision_stream(spark, repo, store.last_commit()).writeStream.option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda rows, number: link_batch(rows, number, repo, store, stream) and None)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
