"""Clashing columns, repeated rows, nulls, long texts and empty tables, operator by operator and stage by stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cognatus.llm import archive, boilerplate, langid, maxent, mixing, packing, simhash, urllists
from cognatus.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "the cat is on the mat and it was good", "en", "a", 9),
    (2, "der Hund ist nicht auf dem Bett und das ist gut", "de", "a", 9),
    (3, "the cat is on the mat and it was good", "en", None, 9),
    (3, "the cat is on the mat and it was good", "en", None, 9),
    (None, "no id but words", "en", "b", 4),
    (4, None, None, "b", None),
    (5, "", "en", "b", 0),
    (6, "12 34", "en", "b", 5),
    (7, "x" * 100_000, "en", "b", 100_000),
    (8, "lorem ipsum dolor " * 5000, "en", "b", 90_000),
]
CLASH = "id fp name component k i j salt rep root part ids trains lengths width codes score held_out lang_pred copies taken target rank size row page host blocks kinds anchor length payload digest first start offset sequence_id key label hash"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in CLASH.split():
        df = df.withColumn(name, F.lit(f"clash {name}"))
    return df


def plain(df, *columns):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect()), key=str)


OPERATORS = {
    "simhash": (lambda d: simhash.simhash_groups(d), ("id", "fp", "component"), len(ROWS)),
    "near_duplicates": (lambda d: simhash.drop_near_duplicates(d), ("doc_id", "text"), 7),
    "language": (lambda d: langid.language_ids(d), ("doc_id", "lang_pred", "score"), len(ROWS)),
    "packing": (lambda d: packing.pack(d, tokenizer_path()), ("id", "start", "length", "ids_crc32"), None),
    "model": (lambda d: maxent.score_documents(d), ("id", "n_tokens", "n_known", "base_score"), len(ROWS)),
    "pages": (lambda d: boilerplate.main_texts(d, id_col="doc_id", url_col="source", html_col="text"), ("id", "url", "text"), len(ROWS)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_other_columns_change_nothing(spark, docs, name):
    run, columns, n = OPERATORS[name]
    bare = spark.createDataFrame(ROWS, SCHEMA)
    got = plain(run(docs), *columns)
    assert got == plain(run(bare), *columns)
    assert n is None or len(got) == n
    assert run(docs.limit(0)).count() == 0


def test_mixing(spark, docs):
    run = lambda d: mixing.mix_sources(d.withColumn("size", mixing.word_count("text")))
    assert plain(run(docs), "doc_id", "size", "target", "source_size") == plain(run(spark.createDataFrame(ROWS, SCHEMA)), "doc_id", "size", "target", "source_size")
    assert run(docs.limit(0)).count() == 0


def test_lists_bear_any_column(spark):
    captures = spark.createDataFrame([("http://A.com/p/q", 86400, "x"), ("http://b.org/", 25 * 10**10, "y")], "url string, at long, until string").withColumn("fetched_at", F.timestamp_seconds("at"))
    for name in ("action", "kind", "since", "list", "w", "__nothing"):
        captures = captures.withColumn(name, F.lit("clash"))
    entries = spark.createDataFrame([("l", "host", "A.COM", "block", 0), ("l", "prefix", "B.org/", "allow", 5)], "list string, kind string, pattern string, action string, at long")
    got = urllists.judge(captures, entries.withColumn("listed_at", F.timestamp_seconds("at"))).select("url", "verdict", "pattern", "until", "action").collect()
    assert {(r["url"], r["verdict"], r["pattern"], r["until"], r["action"]) for r in got} == {("http://A.com/p/q", "block", "a.com", "x", "clash"), ("http://b.org/", "allow", "b.org/", "y", "clash")}


def test_archive(spark, docs, tmp_path):
    pages = docs.select("*", F.lit("http://h/").alias("url"))
    archive.archive(pages, f"file://{tmp_path}/a", id_col="doc_id", uri_col="url", payload_col="text", least=10)
    rows = plain(archive.captures_in(spark, f"file://{tmp_path}/a"), "id", "payload_bytes", "record_type", "refers_to")
    same = len(ROWS[0][1])
    assert rows == sorted(
        [(1, same, "response", None), (3, same, "revisit", 1), (3, same, "revisit", 1), (2, len(ROWS[1][1]), "response", None), (None, 15, "response", None)]
        + [(4, 0, "response", None), (5, 0, "response", None), (6, 5, "response", None), (7, 100_000, "response", None), (8, 90_000, "response", None)],
        key=str,
    )
    archive.archive(pages.limit(0), f"file://{tmp_path}/b", id_col="doc_id", uri_col="url", payload_col="text")
    assert archive.captures_in(spark, f"file://{tmp_path}/b").count() == 0


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages(spark, docs, stage):
    name, run = stage
    out = run(spark, docs, "")
    rows = out.count()
    assert run(spark, docs.limit(0), "").count() == 0
    if name != "packing":
        assert out.columns == docs.columns and 0 < rows <= 2 * len(ROWS)
        assert {r["host"] for r in out.select("host").collect()} == {"clash host"}
