"""Jobs that clean the fields of tracks and titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions.durations import with_durations as durations
from ..functions.text import contains_any, in_steps, replacing, squeeze


def track_fields(tracks: DataFrame, major_labels: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """Clean artist, title and label of each track, a 'feat.' moved to the artist, and the text.

    ``major_labels(label)`` are labels so large that they say nothing about a track: a last label of the
    list that is one of them, or of their family ("Name of the major ..."), in any case, is left out.
    ``rules(field, order, pattern, replacement)`` are replacements besides the built-in ``clean.FIELD_RULES``, for
    the fields title and label; all of a field apply by their order, and become part of the plan.
    """
    rows = rules.select("field", F.col("order").cast("double"), "pattern", "replacement").collect() if rules is not None else None  # a list of rules
    out = tracks.withColumn("artist", C.without_country_codes(C.distinct_artists("artist")))
    out = out.withColumn("title", C.clean_title("title", rows)).withColumn("label", C.clean_label("label", "artist", rows))
    if major_labels is not None:
        name = F.lower(F.trim("label"))
        majors = major_labels.select(name.alias("_name")).where("_name != ''")
        majors = majors.groupBy(F.substring_index("_name", " ", 1).alias("_first")).agg(F.collect_set("_name").alias("_majors"))  # one row per first word
        last = F.trim(F.lower(F.substring_index("label", ",", -1)))
        out = out.withColumn("_last", last).join(majors, F.substring_index("_last", " ", 1) == F.col("_first"), "left")
        of_family = F.exists("_majors", lambda m: (F.col("_last") == m) | F.col("_last").startswith(F.concat(m, F.lit(" "))))
        rest = F.regexp_replace("label", r"(?:^|,)[^,]*$", "")
        out = out.withColumn("label", F.when(of_family, rest).otherwise(F.col("label"))).drop("_first", "_majors", "_last")
    feat = F.regexp_extract("title", r"(?i)\s*(\(feat\. [^)]+\))", 1)
    out = out.withColumn("_feat", F.when(F.lower("title").contains("(feat. "), feat).otherwise(""))
    out = out.withColumn("title", F.when(F.col("_feat") != "", squeeze(F.replace("title", F.col("_feat"), F.lit("")))).otherwise(F.col("title")))
    out = out.withColumn("artist", F.when(F.col("_feat") != "", F.concat_ws(" ", "artist", "_feat")).otherwise(F.col("artist"))).drop("_feat")
    text = F.concat_ws(" - ", "artist", "title")
    # an artist credited again in the remix bracket leaves the front
    repeated = r"(?i)^(.+?)\s*(?:&|vs\.|,)\s*([^ -]+.*?)\s*-\s*(.+\(\2[^)]*\))"
    joined = lambda t: t.contains("(") & (contains_any(t, "&", ",") | F.lower(t).contains("vs."))
    return out.withColumn("text", in_steps(text, [replacing(repeated, "$1 - $3", joined)]))


def search_keys(df: DataFrame, column: str = "title") -> DataFrame:
    return (df.withColumn("search", C.search_terms(column)).withColumn("streaming", C.streaming_title(column))
            .withColumn("video", C.video_title(column)))


__all__ = ["durations", "search_keys", "track_fields"]
