"""The trigram index of messages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cognatus.plans import messages

ROWS = [("1", "Fix the Parser", "body"), ("2", "other", "line\nthe parser"), ("3", "pars", "erser"), ("4", None, None), ("5", "ab", ""), ("6", "aaaaaa", "x" * 50_000), ("7", "Gr\u00fc\u00dfe \U0001f600!", "")]


def commits(spark):
    return spark.createDataFrame(ROWS, "sha string, subject string, body string")


def test_grams():
    code = lambda s: int.from_bytes(s.encode(), "big")
    of = lambda s, sparse=1: messages.grams(np.frombuffer(s.encode(), np.uint8), sparse).tolist()
    assert of("abcab") == [code("abc"), code("bca"), code("cab")]
    assert of("ab") == of("") == [] and of("aaaa") == [code("aaa")]
    text = "the quick brown fox \u00e9\U0001f600" * 3
    assert set(of(text, 4)) < set(of(text)) and of(text, 4)


@pytest.mark.parametrize("sparse", [1, 4])
def test_search(spark, tmp_path, sparse):
    index = messages.MessageIndex(spark, f"file://{tmp_path}/i", sparse)
    index.write(commits(spark))
    for text in ("parser", "THE PARSER", "aaa", "xxxx", "e\n", "gr\u00fc\u00dfe \U0001f600", "nothing", "other\n\nline"):
        want = {s for s, *parts in ROWS if text.lower() in "\n\n".join(p for p in parts if p is not None).lower()}
        assert {r["sha"] for r in index.search(text).collect()} == want, text


def test_only_messages_with_all_trigrams_are_read(spark):
    rows = commits(spark)
    ids = {r["id"]: r["sha"] for r in rows.select("sha", F.hash("sha").alias("id")).collect()}
    found = messages.candidates(messages.postings(rows, 1), "parser", 1)
    assert {ids[r["id"]] for r in found.collect()} == {"1", "2", "3"}  # the third has them apart from each other
    assert messages.candidates(messages.postings(rows, 1), "pa", 1) is None


def test_the_index_is_read_by_trigram(spark, tmp_path):
    index = messages.MessageIndex(spark, f"file://{tmp_path}/i", 1)
    index.write(commits(spark))
    plan = messages.candidates(spark.read.parquet(f"{tmp_path}/i/postings"), "parser", 1)._jdf.queryExecution().toString()
    assert "In(gram, [" in plan
