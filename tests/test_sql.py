"""Every core query that has SQL gives the same rows as DuckDB on the small tables."""

import math
import os

import duckdb
import pytest

from kelpline import registry


@pytest.fixture(scope="session")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{sf_dir}/{f}')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6f}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, sf_dir, con, name):
    df = registry.queries()[name](spark, sf_dir)
    got = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, got.fetchall())


def test_queries_without_sql_run(spark, sf_dir):
    for name in sorted(set(registry.queries()) - set(registry.oracle_sql())):
        registry.queries()[name](spark, sf_dir).collect()


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["corpus_id", "path", "tokens", "knowledge_type", "relevance"]
    assert df.count() > 0
