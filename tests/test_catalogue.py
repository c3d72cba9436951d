"""Catalogue queries against their SQL, over whole small tables."""

import os

import duckdb
import pytest

from storyline.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows_as_sql(spark, oracle, name):
    df = catalogue.queries()[name](spark, SF)
    found = oracle.execute(catalogue.oracle_sql()[name])
    columns = [x[0] for x in found.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted(repr(tuple(dict(zip(columns, row, strict=True))[c] for c in df.columns)) for row in found.fetchall())
    assert sorted(repr(tuple(r)) for r in df.collect()) == expected
