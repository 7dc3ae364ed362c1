"""A task of several windows holds a bounded number of rows, whatever the size of the table."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from mixframe.operators import ordered as O

FOLDER = "/root/testdata/sf0.001"
DEALT = ["infer_hours", "longest_ascending", "score_runs", "tidy_blocks", "best_run", "vote_block_style", "join_wrapped_lines"]


def test_parts_follow_the_rows(spark):
    df = spark.range(1000).selectExpr("id % 50 AS tl_id", "id AS pos")
    assert O.deal(df, "tl_id", 1000, 100_000).rdd.getNumPartitions() == df.rdd.getNumPartitions()
    for task_rows in (20, 10):
        assert O.deal(df, "tl_id", 1000, task_rows).rdd.getNumPartitions() == 1000 // task_rows


@pytest.mark.parametrize("name", DEALT)
def test_queries_are_dealt(spark, monkeypatch, name):
    monkeypatch.setattr(O, "TASK_ROWS", 300)
    out = entry.queries()[name](spark, FOLDER)
    if name != "vote_block_style":  # its distinct rows are dealt anew
        assert out.rdd.getNumPartitions() >= 15
    sql = entry.oracle_sql().get(name)
    if sql:
        ok, message = compare(out, connect(FOLDER), sql)
        assert ok, message


def test_totals_share_the_sort_of_scans(spark):
    df = spark.range(100).selectExpr("id % 5 AS tl_id", "id AS pos")
    out = O.scan(df, "tl_id", "pos", 100, n=O.total("sum", "pos"), top=O.total("max", "pos"), before=O.sum_before("pos"))
    assert out._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    assert {r.n for r in out.collect()} == {sum(range(k, 100, 5)) for k in range(5)}
