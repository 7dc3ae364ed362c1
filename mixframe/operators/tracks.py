"""Jobs over the rows of one mix: cues from times, gaps, repeats, consistency, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cues import cue_format
from ..functions.text import div, hms, js_int, pad_left
from . import ordered as O

# Thresholds in seconds, minutes or lines.
FIRST_GAP_S = 120
GAP_UNKNOWN_S = 30
GAP_ROW_S = 180
TAIL_UNKNOWN_S = 70
TAIL_ROW_S = 240
START_GAP_S = 480
MIN_CUE_DIFF = 3
MIN_TRACKS = 4


def half_up_minutes(seconds) -> Column:
    return div(seconds + F.lit(30), 60)


def cues_from_durations(tracks: DataFrame, longest: int | None = None) -> DataFrame:
    """Start minute of each track from the durations before it; no cues if one is missing."""
    out = O.scan(tracks, "tl_id", "pos", longest,
                 _start=O.sum_before(F.col("dur_s")),
                 _missing=O.total("sum", F.col("dur_s").isNull().cast("int")))
    out = O.scan(out, "tl_id", "pos", longest, _last=O.total("max", F.col("_start")))
    width = F.when(half_up_minutes(F.col("_last")) > 99, F.lit(3)).otherwise(F.lit(2))
    return (out.withColumn("cue_sum", F.col("_start").cast("int"))
            .withColumn("cue", F.when(F.col("_missing") == 0,
                                      pad_left(half_up_minutes(F.col("_start")), width)))
            .drop("_start", "_missing", "_last"))


def release_cues(rows: DataFrame, longest: int | None = None) -> DataFrame:
    """Cues of a release: floor minutes, restarted at each heading, '??' once a length is unknown.

    A release with no length at all gets no cues.  Headings keep their row and get none.
    """
    track = ~F.col("is_heading")
    known = track & F.col("dur_s").isNotNull()
    out = O.scan(
        rows, "release_id", "pos", longest,
        _unknown=O.sum_before((track & F.col("dur_s").isNull()).cast("int")),
        _sum=O.sum_before(F.when(track, F.col("dur_s"))),
        _known=O.total("sum", known.cast("int")))
    out = O.scan(out, "release_id", "pos", longest,
                 _base=O.last_upto(F.when(F.col("is_heading"), F.col("_sum"))))
    out = out.withColumn("_minute", div(F.col("_sum") - F.coalesce("_base", F.lit(0)), 60))
    out = O.scan(out, "release_id", "pos", longest,
                 _top=O.total("max", F.when(known & (F.col("_unknown") == 0), F.col("_minute"))))
    width = F.when(F.col("_top") >= 100, F.lit(3)).otherwise(F.lit(2))
    cue = (F.when(F.col("is_heading") | (F.col("_known") == 0), F.lit(None).cast("string"))
           .when(F.col("_unknown") > 0, F.lit("??"))
           .otherwise(pad_left("_minute", width)))
    return out.withColumn("cue", cue).drop("_unknown", "_sum", "_known", "_base", "_minute", "_top")


def _row(kind: str, cue: Column, text: Column, label: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), cue.cast("string").alias("cue"),
                    text.cast("string").alias("text"), label.cast("string").alias("label"))


def _present(*rows: Column) -> Column:
    return F.filter(F.array(*rows), lambda r: r.isNotNull())


def insert_gaps_from_segments(segments: DataFrame, streams: DataFrame,
                              longest: int | None = None) -> DataFrame:
    """Timed segments to rows, with '?' and gap rows where the recogniser heard nothing."""
    none = F.lit(None)
    gap, unknown = _row("gap", none, none, none), lambda cue: _row("track", cue, F.lit("?"), none)
    out = O.scan(segments, "tl_id", "pos", longest, _next=O.lead(F.col("start_s")))
    # totals ride on the last row of each stream, so the join needs no ordering of its own
    out = out.join(streams, "tl_id", "left")
    start, end, nxt = F.col("start_s"), F.col("end_s"), F.col("_next")
    tail, space = F.col("total_s") - end, nxt - end
    backwards = end < start
    at_end = unknown(hms(F.greatest(end, F.lit(0))))
    rows = _present(
        F.when((F.col("pos") == 1) & (start > FIRST_GAP_S), unknown(F.lit("0:00:00"))),
        F.when((F.col("pos") == 1) & (start > FIRST_GAP_S), gap),
        _row("track", hms(start), F.col("text"), F.col("label")),
        F.when(nxt.isNotNull() & backwards, gap),
        F.when(nxt.isNotNull() & ~backwards & (space > GAP_UNKNOWN_S), at_end),
        F.when(nxt.isNotNull() & ~backwards & (space > GAP_ROW_S), gap),
        F.when(nxt.isNull() & (tail > TAIL_UNKNOWN_S), at_end),
        F.when(nxt.isNull() & (tail > TAIL_ROW_S), gap))
    return O.emit(out, "tl_id", "pos", rows, longest)


def insert_gaps_from_starts(tracks: DataFrame, longest: int | None = None) -> DataFrame:
    """Start times only: leading '?', and a gap row where two starts lie eight minutes apart."""
    none = F.lit(None)
    out = O.scan(tracks, "tl_id", "pos", longest, _next=O.lead(F.col("start_s")),
                 _last=O.last_upto(F.col("start_s")))
    out = O.scan(out, "tl_id", "pos", longest,
                 _end=O.total("max", F.when(F.col("_next").isNull(), F.struct("pos", "_last"))))
    minute = half_up_minutes(F.col("start_s"))
    last = F.coalesce(F.col("_end._last"), F.lit(0))
    width = F.when(half_up_minutes(last) > 99, F.lit(3)).otherwise(F.lit(2))
    first = F.col("pos") == 1
    cue = pad_left(F.when(first & (minute == 1), F.lit(0)).otherwise(minute), width)
    rows = _present(
        F.when(first & (minute > 1), _row("track", pad_left(F.lit(0), width), F.lit("?"), none)),
        _row("track", cue, F.col("text"), F.col("label")),
        F.when(F.col("_next") - F.col("start_s") >= START_GAP_S, _row("gap", none, none, none)))
    return O.emit(out, "tl_id", "pos", rows, longest)


def cue_diffs(tracks: DataFrame, longest: int | None = None) -> DataFrame:
    """Leading-number distance to the row before, when that row is a track too."""
    out = O.scan(tracks, "tl_id", "pos", longest,
                 _before=O.lag(F.when(F.col("type") == "track", js_int("cue"))))
    diff = F.when(F.col("type") == "track", js_int("cue") - F.col("_before"))
    return out.withColumn("diff_prev", diff).drop("_before")


def mark_false_unknowns(tracks: DataFrame, min_gap: int = MIN_CUE_DIFF,
                        longest: int | None = None) -> DataFrame:
    """A '?' closer than ``min_gap`` to a neighbour is no track; re-measure the rest."""
    out = cue_diffs(tracks, longest)
    out = O.scan(out, "tl_id", "pos", longest, _after=O.lead(F.col("diff_prev")))
    false = ((F.col("type") == "track") & (F.col("text") == "?")
             & F.coalesce((F.col("diff_prev") < min_gap) | (F.col("_after") < min_gap), F.lit(False)))
    out = out.withColumn("type", F.when(false, "track (false)").otherwise(F.col("type"))).drop("_after")
    valid = F.when(F.col("type") == "track", F.struct(js_int("cue").alias("c")))
    out = O.scan(out, "tl_id", "pos", longest, _valid=O.last_before(valid))
    after = F.when(F.col("type") == "track", js_int("cue") - F.col("_valid.c"))
    return out.withColumn("diff_valid", after).drop("_valid")


def drop_adjacent_repeats(tracks: DataFrame, longest: int | None = None) -> DataFrame:
    """Drop a track equal to the one directly before it; positions close up."""
    key = F.when(F.col("type") == "track",
                 F.concat(F.col("text"), F.lit("||"), F.coalesce("label", F.lit(""))))
    out = O.scan(tracks.withColumn("_key", key), "tl_id", "pos", longest, _before=O.lag(F.col("_key")))
    out = out.where(~F.coalesce(F.col("_key") == F.col("_before"), F.lit(False)))
    return O.renumber(out.drop("_key", "_before"), "tl_id", "pos", longest)


def cue_consistency(tracks: DataFrame, ignore_unknown: bool = False) -> DataFrame:
    """Formats in use per mix, counts of invalid and missing cues, and whether they agree."""
    fmt = cue_format("cue")
    counted = F.when(fmt.isin("??", "???"), F.lit(None)).otherwise(fmt) if ignore_unknown else fmt
    out = (tracks.where(F.col("type") == "track").select("tl_id", fmt.alias("f"), counted.alias("c"))
           .groupBy("tl_id")
           .agg(F.array_sort(F.collect_set("c")).alias("_set"),
                F.count_if(F.col("f") == "INVALID").alias("n_invalid"),
                F.count_if(F.col("f").isNull()).alias("n_missing")))
    return out.select("tl_id", F.array_join("_set", ",").alias("formats"),
                      F.size("_set").alias("n_formats"), "n_invalid", "n_missing",
                      ((F.size("_set") <= 1) & (F.col("n_invalid") == 0)).alias("ok"))


def cue_problems(tracks: DataFrame) -> DataFrame:
    """The tracks behind the counts: one row per missing or invalid cue."""
    fmt = cue_format("cue")
    return (tracks.where(F.col("type") == "track")
            .select("tl_id", "pos", "text", "cue",
                    F.when(fmt.isNull(), "missing").when(fmt == "INVALID", "invalid").alias("problem"))
            .where(F.col("problem").isNotNull()))


def release_totals(rows: DataFrame, longest: int | None = None) -> DataFrame:
    """Seconds per chapter and per release (chapter NULL); none if any track has no length."""
    track = ~F.col("is_heading")
    out = O.scan(rows, "release_id", "pos", longest,
                 chapter=O.sum_upto(F.col("is_heading").cast("int")),
                 _missing=O.total("sum", (track & F.col("dur_s").isNull()).cast("int")))
    kept = out.where(track & (F.col("_missing") == 0))
    both = kept.rollup("release_id", "chapter").agg(
        F.sum("dur_s").alias("total_s"), F.count(F.lit(1)).alias("n_tracks"),
        F.grouping("release_id").alias("_all"))
    return (both.where(F.col("_all") == 0)
            .select("release_id", F.coalesce(F.col("chapter"), F.lit(-1)).cast("int").alias("chapter"),
                    F.col("total_s").cast("int").alias("total_s"), "n_tracks",
                    hms("total_s").alias("total")))


def filter_short_tracklists(tracks: DataFrame, n: int = MIN_TRACKS) -> DataFrame:
    """Mixes with fewer than ``n`` lines leave; the count is an aggregate joined back."""
    long_enough = (tracks.groupBy("tl_id").agg(F.count(F.lit(1)).alias("_n"))
                   .where(F.col("_n") >= n).select("tl_id"))
    return tracks.join(long_enough, "tl_id", "left_semi")


def unwrap_continuous_mix(tracks: DataFrame) -> DataFrame:
    """Rows that only name the mix itself, or nothing, become '?'."""
    whole = F.col("title").rlike(r"(?i)\(Continuous DJ Mix\)\s*$")
    nothing = (F.trim(F.col("title")) == "ID") | F.col("text").rlike("(?i)^undefined - undefined$")
    hit = F.coalesce(whole | nothing, F.lit(False))
    return (tracks.withColumn("text", F.when(hit, "?").otherwise(F.col("text")))
            .withColumn("label", F.when(hit & F.coalesce(whole, F.lit(False)), F.lit(None))
                        .otherwise(F.col("label"))))


def tracklist_status(tracks: DataFrame, feedback: DataFrame | None = None,
                     n: int = MIN_TRACKS) -> DataFrame:
    """none below ``n`` lines; else the feedback decides, or unknowns and gaps without one.

    ``feedback(tl_id, warnings, hints, status)`` also yields the severity class.
    """
    counts = tracks.groupBy("tl_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if((F.col("type") == "gap") | (F.col("text") == "?")).alias("n_open"))
    if feedback is None:
        feedback = counts.select("tl_id", F.lit(0).alias("warnings"), F.lit(0).alias("hints"),
                                 F.when(F.col("n_open") > 0, "incomplete").otherwise("complete")
                                 .alias("status"))
        joined = counts.join(feedback, "tl_id")
    else:
        joined = counts.join(feedback, "tl_id", "left")
    warn = F.coalesce(F.col("warnings"), F.lit(0)) > 0
    hint = F.coalesce(F.col("hints"), F.lit(0)) > 0
    open_ = F.col("status").isNull() | (F.col("status") == "incomplete")
    return joined.select(
        "tl_id", "n_lines",
        F.when(F.col("n_lines") < n, "none").when(warn | hint | open_, "incomplete")
        .otherwise("complete").alias("tl_status"),
        F.when(F.col("status").isNull(), "").when(warn, "warning")
        .when(hint | (F.col("status") == "incomplete"), "hint").otherwise("complete")
        .alias("severity"))


def carry_headings(rows: DataFrame, longest: int | None = None) -> DataFrame:
    """A heading row leaves; its text opens the next track as a bold note (the last one wins)."""
    heading = F.when(F.col("is_heading"), F.regexp_replace(F.trim("text"), ":$", ""))
    out = rows.withColumn("_heading", heading)
    out = O.scan(out, "tl_id", "pos", longest,
                 _at=O.last_before(F.when(F.col("is_heading"), F.struct("pos", "_heading"))),
                 _track=O.last_before(F.when(~F.col("is_heading"), F.col("pos"))))
    due = F.col("_at.pos") > F.coalesce("_track", F.lit(0))
    note = F.when(due, F.concat(F.lit("'''"), F.col("_at._heading"), F.lit(":''' ")))
    out = (out.where(~F.col("is_heading"))
           .withColumn("text", F.concat(F.coalesce(note, F.lit("")), F.col("text")))
           .drop("_heading", "_at", "_track"))
    return O.renumber(out, "tl_id", "pos", longest)
