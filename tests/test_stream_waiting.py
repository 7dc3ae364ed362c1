"""Rows that wait in a stream's state: few calls of the store, the right order, nothing forgotten too soon."""

from __future__ import annotations

import datetime
import time

from mixframe.plans.stream_queries import run
from mixframe.streaming import jobs


class Store:
    """Map state and timers of one key, with a count of the calls."""

    def __init__(self):
        self.rows, self.timers, self.calls = {}, set(), 0

    def getMapState(self, *_):
        return self

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def updateValue(self, k, v):
        self.calls += 1
        self.rows[k] = v

    def getValue(self, k):
        self.calls += 1
        return self.rows[k]

    def removeKey(self, k):
        self.calls += 1
        del self.rows[k]

    def keys(self):
        self.calls += 1
        return iter(list(self.rows))


def test_many_rows_at_once_take_few_calls():
    store = Store()
    waiting = jobs._Waiting(store)
    waiting.add([(i, f"r{i}") for i in reversed(range(3_000))])
    assert [r[1] for r in waiting.take(5_000)] == [f"r{i}" for i in range(3_000)]
    assert store.calls < 20 and not store.rows


def test_rows_that_come_due_one_by_one():
    store = Store()
    waiting = jobs._Waiting(store)
    for start in range(4):
        waiting.add([(i, i) for i in range(start, 2_000, 4)])
    got = []
    for now in range(2_000):
        due = {t for t in store.timers if t <= now}
        store.timers -= due
        for _ in due:
            got += [(now, r[1]) for r in waiting.take(now)]
    assert got == [(i, i) for i in range(2_000)] and not store.rows and store.calls < 20 * 2_000


def test_an_answer_holds_for_a_request_that_waits_past_its_end(spark, tmp_path):
    """The answer ends at 20.5 s; a request of 20.2 s waits until the second is over and is still a hit."""
    start = datetime.datetime(2024, 1, 1)
    at = lambda s: start + datetime.timedelta(seconds=s)
    files = [[("k", at(0.5), "a"), ("k", at(20.2), "b"), ("m", at(21.7), "x")], [("m", at(21.8), "x")], [("m", at(21.81), "x")], [("m", at(30), "x")], [("m", at(40), "x")]]
    schema = "key string, ts timestamp, answer string"
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    got = {(r.key, r.ts): (r.kind, r.answer) for r in run(jobs.stream_ttl_lookup(stream, "1 second", (20, 20))).collect()}
    assert got["k", at(0.5)] == ("ask", "a") and got["k", at(20.2)] == ("hit", "a")
