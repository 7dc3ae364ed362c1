"""The ordered merge is made once."""

from mixframe.operators import merge_fold, ordered


def _pairs(spark):
    rows = [(1, i, "track", f"0{i}", f"Artist {i} - Song {i}", None, None) for i in range(1, 5)]
    return spark.createDataFrame(rows, "pair_id int, pos int, type string, cue string, text string, label string, dur int")


def _calls(monkeypatch, module, name):
    taken, whole = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda df, *rest: (taken.append(df), whole(df, *rest))[1])
    return taken


def test_longest_list_is_read_off_a_written_merge(spark, monkeypatch):
    """The check of the longest list must not fold all pairs: its plan reads a file and has no Python in it."""
    taken = _calls(monkeypatch, ordered, "longest")
    out = merge_fold.merge_in_order(_pairs(spark), _pairs(spark))
    assert out.count() == 4 and taken
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in taken]
    assert not any("MapInArrow" in p or "Join" in p for p in plans)
