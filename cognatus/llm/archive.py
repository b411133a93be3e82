"""Archiving captures as WARC records, equal payloads once.

Scale: payloads are not shuffled to find equal ones. Digests are counted with map-side combine, so one that
a third of all captures share is one row per task; ids and digests of repeated payloads name the revisits, a
table on disk. It is broadcast to the captures while its files are small, as the planner measures them; beyond that
captures and revisits meet by id and digest, where no key is hot. Payloads are hashed twice for that. The
archive's readers filter by record type in the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cognatus.llm import warc
from cognatus.session import materialize


def dedup_records(captures: DataFrame, *, id_col: str, uri_col: str, payload_col: str, least: int = 100) -> DataFrame:
    """Records for the ``warc`` sink: one response per payload of ``least`` bytes or more, and revisits to it.

    The response is the capture with the least id; rows that repeat it are responses as well.
    Smaller payloads are responses each. Null payloads are empty ones; a null id is a
    capture like any other that no revisit can refer to. Long payloads are held one at a time. Other
    columns are not looked at, whatever their names; an empty table gives no records.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = captures.select(F.col(id_col).alias("id"), F.col(uri_col).alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("length", F.octet_length("payload").cast("long")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    lean = rows.where(F.col("length") >= least).select("id", "digest")
    shared = lean.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = lean.join(shared, "digest").where("NOT id <=> first").distinct()
    again = materialize(again.select(F.col("id").alias("of"), F.col("digest").alias("same"), "first"), "revisits")
    rows = rows.join(again, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same")), "left")
    # a payload whose captures all lack an id has no response to refer to
    revisit = F.col("first").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:capture:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return rows.select(
        urn("id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.when(revisit, urn("first")).alias("refers_to"),
        F.concat(F.lit("sha256:"), F.lower(F.hex("digest"))).alias("payload_digest"),
        F.col("length").cast("string").alias("payload_length"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def captures_in(spark: SparkSession, path: str) -> DataFrame:
    """``(id, target_uri, payload_bytes, payload_digest, record_type, refers_to)`` of an archive.

    A response's size and digest are those of the payload read; a revisit's come from its
    headers, and its payload is not decoded. Runs of blanks in a URI come back as one, as header
    lines fold them.
    """
    warc.register(spark)
    number = lambda c: F.regexp_extract(c, "^<urn:capture:(.*)>$", 1).try_cast("long")
    read = lambda columns: spark.read.format("warc").schema(", ".join(columns)).load(path)
    heads = ["record_id string", "record_type string", "target_uri string", "refers_to string"]
    full = read([*heads, "payload binary"]).where("record_type = 'response'").select(
        number(F.col("record_id")).alias("id"), "target_uri", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"),
    )
    again = read([*heads, "payload_digest string", "payload_length string"]).where("record_type = 'revisit'").select(
        number(F.col("record_id")).alias("id"), "target_uri", F.col("payload_length").cast("long").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type", number(F.col("refers_to")).alias("refers_to"),
    )
    return full.unionByName(again)


def archive(captures: DataFrame, path: str, *, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = 100) -> None:
    """Write the captures' records to a WARC archive at ``path``."""
    warc.register(captures.sparkSession)
    dedup_records(captures, id_col=id_col, uri_col=uri_col, payload_col=payload_col, least=least).write.format("warc").mode("overwrite").save(path)
