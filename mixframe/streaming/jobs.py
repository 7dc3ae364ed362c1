"""Streaming versions of the jobs that watch a growing feed.

The feed has an event time ``ts``.  Watermarks are ours: state is kept as long as a late row may
still need it, and rows later than that are dropped.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.urls import player_key

# How long an answer and a missing answer are remembered, in seconds.
DAY = 86_400
NAME_TTL = (90 * DAY, 7 * DAY)
DURATION_TTL = (3_650 * DAY, 7 * DAY)


def stream_usage(uploads: DataFrame, page_players: DataFrame) -> DataFrame:
    """Usage status of each upload as it arrives: stream-static join, pages counted beforehand."""
    pages = page_players.groupBy("url_key").agg(F.count_distinct("page_id").alias("n_pages"))
    keyed = uploads.withColumn("url_key", player_key("player_url"))
    out = keyed.join(pages, "url_key", "left")
    return (out.withColumn("n_pages", F.coalesce("n_pages", F.lit(0)))
            .withColumn("status", F.when(F.col("n_pages") > 0, "used").otherwise("unused")))


def stream_hidden(uploads: DataFrame, hidden: DataFrame, key: str = "upload_id") -> DataFrame:
    """Hidden or visited ids never come through again."""
    return uploads.join(hidden.select(key).distinct(), key, "left_anti")


def stream_first_seen(stream: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """Each key once; repeats within ``delay`` are dropped."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def stream_bursts(stream: DataFrame, gap: str, delay: str, key: str) -> DataFrame:
    """Rows of a key that follow each other within ``gap`` become one unit of work."""
    windows = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), key)
    return windows.agg(F.count(F.lit(1)).alias("n")).select(
        key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


#: Most rows of a piece of waiting rows.
PIECE = 1_024


class _Waiting:
    """Rows of a key that wait for their time, in map state in pieces of up to ``PIECE`` rows.

    A row is a list that begins with the time in ms at which it is due.  The rows of an input batch become pieces in the
    order of their times, each named by its earliest time, with a timer there.  A timer opens all pieces with a row due, and
    what is left of them goes back in pieces of doubling size: a call of the store serves many rows where many come at
    once, no row is written again more than a few times, and a piece without a due row is not read.
    """

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle = handle
        self.pieces = handle.getMapState("pieces", "due BIGINT, id STRING", "rows STRING")

    def _put(self, rows: list) -> None:
        self.pieces.updateValue((rows[0][0], uuid.uuid4().hex), (json.dumps(rows),))
        self.handle.registerTimer(rows[0][0])

    def add(self, rows: list) -> None:
        rows = sorted(rows, key=lambda r: r[0])
        for i in range(0, len(rows), PIECE):
            self._put(rows[i:i + PIECE])

    def take(self, now: int) -> list:
        """All rows due by ``now``, in the order of their times; they are forgotten."""
        found = []
        for piece in [tuple(k) for k in self.pieces.keys()]:
            if piece[0] > now:
                continue
            rows = json.loads(self.pieces.getValue(piece)[0])
            self.pieces.removeKey(piece)
            n = next((i for i, r in enumerate(rows) if r[0] > now), len(rows))
            found += rows[:n]
            size = 1
            while n < len(rows):
                self._put(rows[n:n + size])
                n, size = n + size, size * 2
        return sorted(found, key=lambda r: r[0])


class _Remembered(StatefulProcessor):
    """Per key: requests that may still be overtaken, and the answer in force with its end.

    Requests wait until the watermark has passed their second and are then answered in the order of their
    event time, so arrival order and file layout do not matter.  What has ended is forgotten by a timer.
    """

    def __init__(self, ttl: tuple[int, int]):
        self.kept, self.missed = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = _Waiting(handle)
        self.answer = handle.getValueState("answer", "answer STRING, ends BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, mine = timerValues.getCurrentWatermarkInMs(), []
        for pdf in rows:
            at = pdf["ts"].astype("datetime64[us]").astype("int64")
            for t, a in zip(at.tolist(), pdf["answer"]):
                if t // 1000 >= now:
                    mine.append(((t // 1_000_000 + 1) * 1000, t, None if pd.isna(a) else str(a)))
        self.waiting.add(mine)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the last whole second that the watermark has passed: no request before it comes or waits any more
        passed = timerValues.getCurrentWatermarkInMs() // 1000 * 1000
        # equal times: known answers before missing ones, then by text
        waiting = sorted(self.waiting.take(passed), key=lambda r: (r[1], r[2] is None, r[2] or ""))
        answer, ends = self.answer.get() if self.answer.exists() else (None, -1)
        out, asked = [], False
        for _, at, found in waiting:
            if at >= ends:
                answer, ends, asked = found, at + (self.missed if found is None else self.kept) * 1_000_000, True
                out.append((at, "ask", answer))
            else:
                out.append((at, "hit", answer))
        if ends <= passed * 1000:
            self.answer.clear()
        elif asked:
            self.answer.update((answer, ends))
            self.handle.registerTimer(-(-ends // 1_000_000) * 1000)
        if out:
            yield pd.DataFrame({"key": [key[0]] * len(out), "ts": pd.to_datetime([r[0] for r in out], unit="us"),
                                "kind": [r[1] for r in out], "answer": pd.Series([r[2] for r in out], dtype="object")})

    def close(self) -> None:
        pass


def stream_ttl_lookup(stream: DataFrame, delay: str, ttl: tuple[int, int] = NAME_TTL) -> DataFrame:
    """``(key, ts, answer)`` requests: 'ask' when nothing valid is remembered, else 'hit'.

    What is remembered per key is one answer and when it ends; a missing answer ends sooner.  A request
    is answered once the watermark has passed it; one later than ``delay`` is dropped.
    """
    return (stream.select("key", "ts", "answer").withWatermark("ts", delay).groupBy("key")
            .transformWithStateInPandas(_Remembered(ttl), "key STRING, ts TIMESTAMP, kind STRING, answer STRING", "Append", "eventTime"))


class _Newest(StatefulProcessor):
    """Per key: answers whose window is still open, and the newest generation of the windows that have closed."""

    def __init__(self, memory: int):
        self.memory = memory

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = _Waiting(handle)
        self.newest = handle.getValueState("newest", "generation BIGINT, ends BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, due = timerValues.getCurrentWatermarkInMs(), {}
        for pdf in rows:
            for e, s, g, v in zip(pdf["ended"], pdf["started"], pdf["generation"], pdf["value"]):
                if e // 1000 > now:
                    ended = -(-int(e) // 1000)
                    due.setdefault(ended, []).append((ended, int(s), int(g), None if pd.isna(v) else str(v)))
        mine = []
        for window in due.values():
            top = max(r[2] for r in window)  # what a batch itself supersedes need not wait
            mine += [r for r in window if r[2] == top]
        self.waiting.add(mine)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        newest, ends = self.newest.get() if self.newest.exists() else (NO_GENERATION, -1)
        out = []
        closed = self.waiting.take(now)
        for due, rows in itertools.groupby(closed, key=lambda r: r[0]):
            window = list(rows)
            if ends <= due:
                newest = NO_GENERATION
            newest, ends = max(newest, max(r[2] for r in window)), due + self.memory * 1000
            out += sorted((r[1:] for r in window if r[2] == newest), key=lambda r: (r[2] is None, r[2] or ""))
        if ends <= now:
            self.newest.clear()
        elif closed:
            self.newest.update((newest, ends))
            self.handle.registerTimer(ends)
        if out:
            yield pd.DataFrame({"key": pd.Series([key[0]] * len(out), dtype="object"), "started": pd.to_datetime([r[0] for r in out], unit="us"),
                                "generation": [r[1] for r in out], "value": pd.Series([r[2] for r in out], dtype="object")})

    def close(self) -> None:
        pass


#: Stands for a null generation inside the job; older than all others.
NO_GENERATION = -(1 << 63)


def stream_latest(stream: DataFrame, delay: str, window: str, memory: int = NAME_TTL[0]) -> DataFrame:
    """``(key, started, generation, value)``: the answers that no newer generation of their key supersedes.

    A window of event time is settled once the watermark has passed it: all its answers of the newest
    generation so far, in this window or an earlier one, come out; the others are dropped, whatever order
    they arrive in.  The newest generation of a key is forgotten ``memory`` seconds after the last window
    that had answers.  A null generation is the oldest.
    """
    w = F.window("ts", window)
    rows = stream.select("key", "ts", F.unix_micros(w.start).alias("started"), F.unix_micros(w.end).alias("ended"),
                         F.coalesce(F.col("generation").cast("long"), F.lit(NO_GENERATION)).alias("generation"), F.col("value").cast("string").alias("value"))
    out = rows.withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(
        _Newest(memory), f"key {stream.schema['key'].dataType.simpleString()}, started TIMESTAMP, generation BIGINT, value STRING", "Append", "eventTime")
    kinds = {c: stream.schema[c].dataType for c in ("generation", "value")}
    return out.select("key", "started", F.when(F.col("generation") != NO_GENERATION, F.col("generation")).cast(kinds["generation"]).alias("generation"),
                      F.col("value").cast(kinds["value"]).alias("value"))
