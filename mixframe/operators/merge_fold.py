"""The merge of two tracklists in candidate order, one pair at a time.

``merge.merge_tracklists`` is a plan over sets.  Where two candidates hit one original, where matches cross, or where
one candidate's knowledge decides the place of the next, the result depends on the order in which candidates
are taken; this is the merge that takes them one after the other.  Names are matched by joins, over all pairs at
once; only the rest, which changes the list while it reads it, is a fold over the two lists of a pair.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import cue_jobs
from .match import match_tracks_exact, match_tracks_fuzzy, stored_norms

FIELDS = ["type", "cue", "text", "label", "dur"]
# Rows of one batch handed on, more or less.
BATCH_ROWS = 4_096
SCHEMA = "pair_id {key}, pos int, type string, cue string, text string, label string, dur int"


@dataclass
class Line:
    type: str
    cue: str | None = None
    text: str | None = None
    label: str | None = None
    dur: int | None = None
    hit: int | None = None  # candidate: position of the original its name matched; original: the last candidate that hit it

    @property
    def unknown(self) -> bool:
        return self.type == "track" and self.text == "?"

    @property
    def minute(self) -> int | None:
        found = re.match(r"\s*(\d+)", self.cue or "")
        return int(found.group(1)) if found else None


def _fill(slot: Line, line: Line, name: bool, cue: bool) -> None:
    """What the slot lacks comes from the line; its name and cue if asked for."""
    if name and line.text != "?":
        slot.text = line.text
    if cue and line.cue:
        slot.cue = line.cue
    slot.dur = slot.dur or line.dur
    slot.label = slot.label or line.label


class Fold:
    """The state of one merge: the original lines, which change, and the candidates."""

    def __init__(self, lines: list[Line], candidates: list[Line]):
        self.lines, self.candidates = lines, candidates
        self.has_gaps = any(x.type == "gap" or x.text == "?" for x in lines)
        self.open: list[int] = []  # candidates without an original

    def run(self) -> list[Line]:
        self._match()
        if self.has_gaps:
            self._fill_slots()
        for i in self.open:
            self._insert(i)
        return self.lines

    def _match(self) -> None:
        by_cue: dict[str, list[int]] = {}  # unknown originals; those behind their cue's first one wait
        for k, line in enumerate(self.lines):
            if line.unknown and line.cue:
                by_cue.setdefault(line.cue, []).append(k)
        for i, cand in enumerate(self.candidates):
            if cand.type != "track" or not cand.text:
                continue
            k = cand.hit
            if k is None and cand.cue:
                waiting = by_cue.get(cand.cue, [])
                while waiting and not (self.lines[waiting[0]].unknown and self.lines[waiting[0]].cue == cand.cue):
                    waiting.pop(0)
                k = waiting[0] if waiting else None
            if k is None:
                self.open.append(i)
                continue
            line = self.lines[k]
            _fill(line, cand, line.unknown, not line.cue or "?" in line.cue)
            line.hit = i
            after = self.candidates[i + 1] if i + 1 < len(self.candidates) else None
            if after is not None and after.unknown and after.cue:  # an unknown behind a match tells where the next line begins
                empty = next((x for x in range(k + 1, len(self.lines)) if not self.lines[x].cue), None)
                if empty is not None:
                    self.lines[empty].cue = after.cue
                    if self.lines[empty].unknown:
                        by_cue.setdefault(after.cue, []).append(empty)
                        by_cue[after.cue].sort()

    def _fill_slots(self) -> None:
        """Unmatched candidates and gaps use up the unknown originals between the matches around them, from the first on."""
        anchors = sorted((line.hit, k) for k, line in enumerate(self.lines) if line.type == "track" and line.hit is not None)
        hits = [h for h, _ in anchors]
        free = [k for k, line in enumerate(self.lines) if line.unknown]
        waiting, left = set(self.open), []
        for i, cand in enumerate(self.candidates):
            if i not in waiting and cand.type != "gap":
                continue
            before, behind = bisect_left(hits, i) - 1, bisect_right(hits, i)
            low = anchors[before][1] + 1 if before >= 0 else 0
            high = anchors[behind][1] if behind < len(anchors) else len(self.lines)
            at = bisect_left(free, low)
            if at < len(free) and free[at] < high:
                slot = free.pop(at)
                if i in waiting:
                    _fill(self.lines[slot], cand, True, True)
            elif i in waiting:
                left.append(i)
        self.open = left

    def _insert(self, i: int) -> None:
        cand, minute, lines = self.candidates[i], self.candidates[i].minute, self.lines
        if cand.unknown and (not self.has_gaps or (minute is not None and any(x.type == "track" and x.minute == minute for x in lines))):
            return
        at = len(lines)
        if minute is not None:
            at = next((k for k, x in enumerate(lines) if x.type == "track" and (x.minute or 0) > minute), at)
        gap = lambda k: 0 <= k < len(lines) and lines[k].type == "gap"
        gap_before = i > 0 and self.candidates[i - 1].type == "gap"
        gap_behind = i + 1 < len(self.candidates) and self.candidates[i + 1].type == "gap"
        if gap(at - 1) and not gap_before:
            at -= 1
        if self.has_gaps and gap_before and not gap(at - 1):
            lines.insert(at, Line("gap"))
            at += 1
        lines.insert(at, Line("track", cand.cue, cand.text, cand.label, cand.dur))
        if self.has_gaps and gap_behind and not gap(at + 1):
            lines.insert(at + 1, Line("gap"))


def _fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pair_id, side, pos, fields, hit) in this order: one pair after the other is merged, many pairs make a batch."""
    pair, lines, place, candidates = None, [], {}, []
    out: dict[str, list] = {name: [] for name in ("pair_id", "pos", *FIELDS)}

    def merge() -> None:
        for pos, line in enumerate(Fold(lines, candidates).run(), 1):
            for name, value in zip(out, (pair, pos, *(getattr(line, f) for f in FIELDS))):
                out[name].append(value)

    for batch in batches:
        kind = batch.schema.field("pair_id").type
        types = [kind, pa.int32(), *[pa.string()] * 4, pa.int32()]
        for now, side, pos, *fields, hit in zip(*(batch.column(c).to_pylist() for c in ("pair_id", "side", "pos", *FIELDS, "hit"))):
            if now != pair:
                if pair is not None:
                    merge()
                pair, lines, place, candidates = now, [], {}, []
                if len(out["pos"]) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))
                    out = {name: [] for name in out}
            if side == 0:
                place[pos] = len(lines)
                lines.append(Line(*fields))
            else:
                candidates.append(Line(*fields, hit=None if hit is None else place[hit]))
    if pair is not None:
        merge()
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))


def merge_in_order(orig: DataFrame, cand: DataFrame, longest: int | None = None) -> DataFrame:
    """``(pair_id, pos, type, cue, text, label, dur)`` of the merged list, candidates taken in their order.

    Rows are those of ``merge.merge_tracklists``.  Both lists of a pair are held by one task, as the order of a list is
    what decides; for lists that do not fit one there is the plan over sets.  A pair without originals gives
    its candidates, one without candidates its originals; pairs without an id are left out.
    """
    orig = stage(orig, "orig")
    style = cue_jobs.cue_style(orig)
    cand = stage(cue_jobs.convert_cues(cand.where(F.col("type") != "track (false)"), style), "cand")
    cn, on = stored_norms(cand.where(F.col("text") != "?")), stored_norms(orig)
    # written, so that they are made once and the shuffle files behind them go before the fold writes its own
    exact = stage(match_tracks_exact(cn, on), "exact")
    named = exact.unionByName(match_tracks_fuzzy(cn, on, exact)).select("pair_id", F.col("cand_pos").alias("pos"), F.col("orig_pos").cast("int").alias("hit"))
    named = stage(named, "named")
    fields = [*FIELDS[:-1], F.col("dur").cast("int").alias("dur")]
    ours = orig.select("pair_id", F.lit(0).alias("side"), F.col("pos").cast("int").alias("pos"), *fields, F.lit(None).cast("int").alias("hit"))
    theirs = cand.join(named, ["pair_id", "pos"], "left").select("pair_id", F.lit(1).alias("side"), F.col("pos").cast("int").alias("pos"), *fields, "hit")
    both = ours.unionByName(theirs).where(F.col("pair_id").isNotNull()).repartition("pair_id").sortWithinPartitions("pair_id", "side", "pos")
    out = both.mapInArrow(_fold_batches, SCHEMA.format(key=orig.schema["pair_id"].dataType.simpleString()))
    # the check of the longest list would fold all pairs once more
    out = stage(cue_jobs.explicit_cues(cue_jobs.convert_cues(out, style), style), "merged")
    return cue_jobs.fill_cue_prefix(out, "pair_id", None if longest is None else 2 * longest).select("pair_id", "pos", *FIELDS)
