"""Every registered query against its DuckDB oracle on the smallest tables (sf0.001)."""

import collections
import math

import duckdb
import pytest

from tillroll.catalog import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def _bag(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return collections.Counter(tuple(_norm(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("key", sorted(oracle_sql()))
def test_query_matches_oracle(spark, duck, key):
    df = queries()[key](spark, SF)
    cur = duck.execute(oracle_sql()[key])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _bag(df.columns, [tuple(r) for r in df.collect()]) == _bag(dcols, cur.fetchall())


@pytest.mark.parametrize("key", sorted(set(queries()) - set(oracle_sql())))
def test_rows_only_queries_run(spark, key):
    df = queries()[key](spark, SF)
    assert df.count() > 0
