"""Registered queries against their SQL on the smallest tables; plans that must stay as they are."""

import glob

import duckdb
import pytest

from cognatus.plans import queries, store, tiers

SMALL = "/root/testdata/sf0.001"


def normal(rows):
    return sorted((tuple(x if x is None or isinstance(x, str | bool) else round(float(x), 9) for x in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.sql(f"CREATE VIEW {f.split('/')[-1][:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, duck, name):
    got = queries.QUERIES[name](spark, SMALL)
    want = duck.sql(queries.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert normal(got.select(columns).collect()) == normal(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


def test_all_have_rows_or_oracle():
    assert set(queries.ORACLE) <= set(queries.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_prefix_is_pushed_down(spark, tmp_path):
    spark.createDataFrame([("a" * 40, 1, 1, 1.0)], store.HASHES_SCHEMA).write.parquet(f"{tmp_path}/h")
    plan = store.prefix_rows(spark.read.parquet(f"{tmp_path}/h"), "aa")._jdf.queryExecution().toString()
    assert "StringStartsWith(sha,aa)" in plan


def test_components_take_links(spark, monkeypatch):
    """Groups are scored on tier 3's links, never on all pairs of a group of copies."""
    monkeypatch.setattr(tiers, "message_pairs", None)
    assert queries.group_similarity(spark, SMALL).count() == queries.group_similarity(spark, SMALL).distinct().count() > 0
