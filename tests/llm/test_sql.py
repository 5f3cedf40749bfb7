"""The queries of the subpackage that have SQL, and their registration."""

import os

import duckdb
import pytest

import __spark_entry__


@pytest.mark.parametrize("name", ["op8_quality_rules", "op11_exponion_clusters", "op13_fill_in_middle"])
def test_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"create view {file.split('.')[0]} as select * from '{sf}/{file}'")
    df = __spark_entry__.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    q = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(r[names.index(c)] for c in columns) for r in q.fetchall())


def test_names():
    names = set(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
