"""Every query with SQL, on the smallest driver tables, against DuckDB."""

import math
import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"refine_check", "hcnng_recall", "nn_descent_recall"}


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if n not in SLOW))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = sorted(repr(sorted((n, plain(v)) for n, v in zip(names, row))) for row in result.fetchall())
    df = __spark_entry__.queries()[name](spark, SF)
    assert sorted(repr(sorted((n, plain(v)) for n, v in r.asDict().items())) for r in df.collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
