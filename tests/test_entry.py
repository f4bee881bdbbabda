"""The driver's contract: queries and SQL agree on names, and the flagship runs."""

import duckdb
import pytest

import __spark_entry__ as entry
from gridloom import queries as matrix

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


def test_every_query_has_its_place():
    found = entry.queries()
    assert set(matrix.QUERIES) <= set(found) and set(entry.oracle_sql()) <= set(found)


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["row_id", "col_id", "value"] and out.count() == 500 * 501 // 2


@pytest.mark.parametrize("name", sorted(matrix.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.sql(matrix.ORACLE_SQL[name]).df(), matrix.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda f: sorted(map(repr, f[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
