"""Costly expressions stand once in the plan."""

from mixframe.operators import detect, episodes


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_episode_sort_compares_columns(spark):
    df = episodes.order_episode_keys(spark.createDataFrame([("b",), ("10",), ("A",), ("9",), (None,)], "episode_key string"))
    sort = next(line for line in plan(df).splitlines() if "Sort [" in line)
    assert "lower(" not in sort and "cast(" not in sort
    assert df.columns == ["episode_key"]
    assert [r.episode_key for r in df.collect()] == ["9", "10", None, "A", "b"]


def test_numbered_marks_are_folded_once(spark):
    df = spark.createDataFrame([("u", 1, "intro 1. A - B 2. C - D"), ("u", 2, "1. only"), ("u", 3, None)], "player_url string, comment_no long, body string")
    stored = df.repartition(2)  # a local table would be folded while it is planned
    out = detect.split_numbered_comments(stored)
    assert plan(out).count("regexp_extract_all(") == 1
    assert sorted((r.comment_no, r.line_no, r.raw) for r in out.collect()) == [(1, 1, "1. A - B"), (1, 2, "2. C - D")]


def test_norms_are_built_once_for_the_anchors(spark):
    import __spark_entry__ as entry
    out = entry.queries()["fill_unknown_between_anchors"](spark, "/root/testdata/sf0.001")
    assert "posexplode" not in plan(out)  # the matches are read, not made again


def test_parts_of_chapters_are_stored_lines(spark):
    import __spark_entry__ as entry
    out = entry.queries()["chapters"](spark, "/root/testdata/sf0.001")
    assert "LogicalRDD" not in plan(out) and "parquet" in plan(out)
