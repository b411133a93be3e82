"""Search in stored messages by an index of their trigrams.

Every three bytes in a row of a message, in lower case and UTF-8, are a trigram; one of ``SPARSE``, by its hash, is
kept in the index. A text can only stand in messages that have all its kept trigrams; the messages of these are read and
looked at. A text without a kept trigram, as short ones may be, is looked for in all messages. The index is laid out by trigram, so a search
reads the few row groups of its own ones. Commits are told by 32-bit hashes there: what agrees by chance is read too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPARSE = 4
#: Parts that a trigram's messages are dealt to: a common one, which a third of the messages may have, is no single task.
SALTS = 16


def grams(data: np.ndarray, sparse: int = SPARSE) -> np.ndarray:
    """The distinct kept trigrams of bytes, in order; none for fewer than three."""
    wide = data.astype(np.int32)
    codes = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
    return np.unique(codes[(codes.astype(np.uint32) * np.uint32(2654435761) >> np.uint32(16)) % sparse == 0])


def message_of(commits: DataFrame) -> Column:
    return F.concat_ws("\n\n", "subject", "body")


def postings(commits: DataFrame, sparse: int = SPARSE) -> DataFrame:
    """``(gram, id)``: which messages have which of the kept trigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id").to_numpy(), batch.column("m").cast(pa.large_binary())
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            found, at, total = [], [], 0
            for i, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist(), strict=False)):
                found.append(grams(data[a:b], sparse))
                at.append(i)
                total += len(found[-1])
                if total > 1 << 18 or i == len(ids) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.repeat(ids[at], [len(f) for f in found]))], names=["gram", "id"])
                    found, at, total = [], [], 0

    return commits.select(F.hash("sha").alias("id"), F.lower(message_of(commits)).alias("m")).mapInArrow(run, "gram int, id int")


def candidates(index: DataFrame, text: str, sparse: int = SPARSE) -> DataFrame | None:
    """``(id)`` of the messages that have all kept trigrams of the text; None if it has none."""
    low = index.sparkSession.createDataFrame([(text,)], "t string").select(F.lower("t").alias("t")).first()["t"]
    some = grams(np.frombuffer(low.encode(), np.uint8), sparse).tolist()
    if not some:
        return None
    met = index.where(F.col("gram").isin(some)).groupBy("id").agg(F.count_distinct("gram").alias("n"))
    return met.where(F.col("n") == len(some)).select("id")


@dataclass
class MessageIndex:
    """Messages and the index of them, in a folder."""

    spark: SparkSession
    path: str
    sparse: int = SPARSE

    def write(self, commits: DataFrame) -> None:
        """Index ``commits`` (sha, subject, body), in place of what was there."""
        messages = commits.select("sha", F.hash("sha").alias("id"), message_of(commits).alias("message"))
        messages.write.mode("overwrite").parquet(f"{self.path}/messages")
        rows = postings(commits, self.sparse).repartition("gram", F.pmod("id", F.lit(SALTS))).sortWithinPartitions("gram")
        rows.write.mode("overwrite").parquet(f"{self.path}/postings")

    def search(self, text: str) -> DataFrame:
        """``(sha)`` of the messages that contain a text, case aside."""
        messages = self.spark.read.parquet(f"{self.path}/messages")
        met = candidates(self.spark.read.parquet(f"{self.path}/postings"), text, self.sparse)
        if met is not None:
            messages = messages.join(met, "id", "left_semi")
        return messages.where(F.contains(F.lower("message"), F.lit(text.lower()))).select("sha")
