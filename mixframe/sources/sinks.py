"""Writers: episode maps and wiki page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hms


def episode_map(episodes: DataFrame) -> DataFrame:
    """One ``"key": {"url", "duration"}`` entry per episode; a length of 0 is left out."""
    entry = F.to_json(F.struct("url", F.when(F.col("duration_s") > 0, F.col("duration_s")).alias("duration")))
    return episodes.select("source", "episode_no", F.concat(F.lit('"'), F.col("episode_no").cast("string"), F.lit('": '), entry).alias("entry"))


def write_episode_map(episodes: DataFrame, path: str) -> None:
    """Entries per source, newest episode first."""
    (episode_map(episodes).repartitionByRange("source", F.col("episode_no").desc())
     .sortWithinPartitions("source", F.col("episode_no").desc())
     .write.partitionBy("source").json(path))


def file_details(duration: Column, size: Column) -> Column:
    mb = F.format_string("%.2f", size / F.lit(1048576.0))
    return F.concat(F.lit("{|{{NormalTableFormat}}\n! dur\n! MB\n! kbps\n|-\n| "),
                    F.coalesce(F.when(duration > 0, hms(duration)), F.lit("")), F.lit("\n| "),
                    F.coalesce(mb, F.lit("")), F.lit("\n| \n|}"))


def page_text(mixes: DataFrame) -> DataFrame:
    """Wiki text of a new page: image, file details, players, notes, tracklist, categories.

    ``mixes(mix_id, image, duration_s, bytes, urls ARRAY, notes, tracklist, categories ARRAY)``;
    empty parts are left out.
    """
    urls = F.filter("urls", lambda u: u != "")
    numbered = F.exists(urls, lambda u: u.contains("="))
    lines = F.transform(urls, lambda u, i: F.concat(
        F.lit(" |"), F.when(numbered, F.concat((i + 1).cast("string"), F.lit("="))).otherwise(""), u))
    head = F.when(F.size(urls) > 1, "{{Player|mode=mirrors").otherwise("{{Player")
    player = F.when(F.size(urls) > 0, F.concat(head, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n}}")))
    some = lambda c, v: F.when(F.coalesce(c, F.lit("")) != "", v)
    parts = F.concat_ws(
        "\n\n",
        some(F.col("image"), F.concat(F.lit("[[File:"), "image", F.lit("|right|360px]]"))),
        F.concat(F.lit("== File details ==\n\n"), file_details(F.col("duration_s"), F.col("bytes"))),
        player, some(F.col("notes"), F.concat(F.lit("== Notes ==\n\n"), "notes")),
        F.concat(F.lit("== Tracklist ==\n\n"), F.coalesce("tracklist", F.lit("<list>\n\n</list>"))),
        F.array_join(F.transform(F.filter("categories", lambda c: c != ""), lambda c: F.concat(F.lit("[[Category:"), c, F.lit("]]"))), "\n"))
    return mixes.select("mix_id", parts.alias("wikitext"))
