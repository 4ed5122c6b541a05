"""The queries of this package that have SQL give the same rows; all run on the small tables and on empty ones."""

import os

import duckdb
import pytest

from kelpline.llm import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{sf_dir}/{f}')")
    got = con.execute(registry.SQL[name])
    columns = [d[0] for d in got.description]
    df = registry.QUERIES[name](spark, sf_dir).select(columns)
    assert sorted(map(tuple, df.collect())) == sorted(got.fetchall())


@pytest.fixture(scope="module")
def empty_dir(spark, sf_dir, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for f in ("embedding_entries", "source_files", "retrieval_runs", "entities", "eval_items", "documents"):
        spark.read.parquet(f"{sf_dir}/{f}.parquet").limit(0).write.parquet(f"{at}/{f}.parquet")
    return str(at)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert registry.QUERIES[name](spark, empty_dir).count() == 0
