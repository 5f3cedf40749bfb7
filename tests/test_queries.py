"""Queries against their SQL, as the entry module registers them."""

import os

import duckdb
import pytest

import __spark_entry__

NAMES = [
    "language_from_path", "lex_token_kinds", "token_positions", "winnow_fingerprints", "verified_pairs", "suppressed_pairs", "clone_statistics", "accuracy_metrics", "brace_fragments", "python_fragments", "code_tokens", "page_block_pairs", "token_dictionary",
    "whole_file_fragments", "report_json", "report_family_json", "sarif_results", "stable_ids",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"create view {name.split('.')[0]} as select * from '{sf}/{name}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sf, duck, name):
    df = __spark_entry__.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    q = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == columns
    want = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in q.fetchall())
    assert got == want


def test_every_sql_has_a_query(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_labels_meet_by_digests(spark, tmp_path):
    """no text is a key of a shuffle."""
    from echoframe.queries import _oracle

    rows = [(1, "a b", "s"), (2, "a b", "s"), (3, None, "s"), (4, "", "t"), (6, "c", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    labels = _oracle(spark, str(tmp_path))
    found = {(r.id, r.expected, r.kind) for r in labels.collect()}
    assert found == {("2-1", True, "type1"), ("4-3", True, "type1"), ("1-2", True, None), ("2-3", False, None), ("3-4", True, None)}
    assert "hashpartitioning(text" not in labels._jdf.queryExecution().executedPlan().toString()


def test_code_is_counted_before_the_shuffle(spark, sf):
    """files are not a key of it, so only kinds of tokens are shuffled."""
    plan = __spark_entry__.queries()["code_tokens"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert len(keys) == 1 and not [line for line in keys if "id#" in line]
