"""Tracklist text: read it into rows, write rows as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ordered as O

# Fixed value: a leading cue in brackets; digits, X and ? in up to three fields.
LEADING_CUE = r"(?i)^\[((?:\d|X|\?)+(?::(?:\d|X|\?){1,2}){0,2})\]"
TRAILING_LABEL = r"\[(.*?)\]$"


def scan_tracklists(texts: DataFrame, longest: int | None = None) -> DataFrame:
    """``(tl_id, text)`` to ``(tl_id, pos, type, cue, text, label)``; blank lines take no position."""
    lines = texts.select("tl_id", F.posexplode(F.split(F.regexp_replace("text", "''", ""), "\n"))
                         .alias("pos", "raw"))
    lines = lines.withColumn("raw", F.trim(F.regexp_replace("raw", r"^\s+|\s+\z", "")))
    return parse_lines(lines.where(F.col("raw") != ""), longest)


def parse_lines(lines: DataFrame, longest: int | None = None) -> DataFrame:
    """``(tl_id, pos, raw)`` rows to typed rows with dense positions."""
    gap = F.col("raw") == "..."
    body = F.regexp_replace("raw", r"^#\s*", "")
    cue = F.regexp_extract(body, LEADING_CUE, 1)
    rest = F.regexp_replace(body, LEADING_CUE + r"\s*", "")
    label = F.regexp_extract(rest, TRAILING_LABEL, 1)
    has_label = rest.rlike(TRAILING_LABEL)
    text = F.trim(F.when(has_label, F.regexp_replace(rest, r"\s*\[.*?\]$", "")).otherwise(rest))
    out = lines.select(
        "tl_id", "pos", F.when(gap, "gap").otherwise("track").alias("type"),
        F.when(~gap & (cue != ""), cue).alias("cue"), F.when(~gap, text).alias("text"),
        F.when(~gap & has_label, label).alias("label"))
    return O.renumber(out, "tl_id", "pos", longest)


def line_text():
    """One row of a tracklist as it is written; NULL for a row that is left out."""
    cue, label = F.col("cue"), F.col("label")
    track = F.concat(
        F.when(F.coalesce(cue, F.lit("")) != "", F.concat(F.lit("["), cue, F.lit("] "))).otherwise(""),
        F.coalesce("text", F.lit("")),
        F.when(F.coalesce(label, F.lit("")) != "", F.concat(F.lit(" ["), label, F.lit("]")))
        .otherwise(""))
    return (F.when(F.col("type") == "gap", "...").when(F.col("type") == "track", track))


def write_tracklists(tracks: DataFrame, part_rows: int = 0) -> DataFrame:
    """One text per mix; with ``part_rows`` one text for every so many positions, numbered."""
    part = F.floor(F.col("pos") / F.lit(part_rows)).cast("int") if part_rows else F.lit(0)
    return (tracks.withColumn("line", line_text()).where(F.col("line").isNotNull()).withColumn("part", part)
            .groupBy("tl_id", "part")
            .agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY pos)").alias("text")))
