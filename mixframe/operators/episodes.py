"""Jobs over episode listings of several platforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_key


def union_sources(*listings: DataFrame) -> DataFrame:
    """One listing out of several; of each episode the first entry counts, in source order.

    ``(episode_no, entry_no, url, duration_s)`` each.
    """
    out = None
    for i, df in enumerate(listings):
        part = df.select("episode_no", "entry_no", "url", "duration_s", F.lit(i).alias("source_no"))
        out = part if out is None else out.unionByName(part)
    first = F.min_by(F.struct("source_no", "entry_no", "url", "duration_s"), F.struct("source_no", "entry_no"))
    return out.groupBy("episode_no").agg(first.alias("r")).select("episode_no", "r.*")


def missing_episodes(listing: DataFrame, pages: DataFrame, number_pattern: str,
                     manual: DataFrame | None = None) -> DataFrame:
    """Listed episodes without a page: by the number in the page title, or by a title noted by hand.

    ``listing(episode_no, title, ...)``, ``pages(title)``, ``manual(episode_no, title)``.
    """
    number = F.regexp_extract("title", number_pattern, 1).try_cast("int")
    have = pages.select(number.alias("episode_no")).where(F.col("episode_no").isNotNull()).distinct()
    out = listing.join(have, "episode_no", "left_anti")
    if manual is not None:
        there = (manual.select("episode_no", name_key("title").alias("k"))
                 .join(pages.select(name_key("title").alias("k")).distinct(), "k", "left_semi")
                 .select("episode_no").distinct())
        out = out.join(there, "episode_no", "left_anti")
    return out


def attach_players(missing: DataFrame, episodes: DataFrame, priorities: DataFrame) -> DataFrame:
    """Addresses and length of each missing episode from all platforms.

    ``missing(episode_no, scraped_url)``; the scraped address stands in only where no platform has
    one.  The length is the first positive one by platform priority.
    """
    ranked = episodes.join(priorities, "source", "left").withColumn("priority", F.coalesce("priority", F.lit(10**6)))
    one = ranked.groupBy("episode_no", "source", "priority").agg(
        F.min_by(F.struct("url", "duration_s"), "entry_no").alias("r")).select("episode_no", "source", "priority", "r.*")
    per = one.groupBy("episode_no").agg(
        F.array_sort(F.collect_set(F.struct("priority", "url"))).alias("_u"),
        F.min_by("duration_s", F.when(F.col("duration_s") > 0, F.struct("priority", "source"))).alias("duration_s"))
    out = missing.join(per, "episode_no", "left")
    urls = F.coalesce(F.transform("_u", lambda u: u["url"]), F.filter(F.array("scraped_url"), lambda u: u.isNotNull()))
    return out.withColumn("urls", urls).drop("_u", "scraped_url")


def order_episode_keys(episodes: DataFrame, column: str = "episode_key") -> DataFrame:
    """Numeric keys first, rising, then text without regard to case."""
    # columns, as a sort evaluates its expressions anew in every comparison
    keyed = episodes.select("*", F.col(column).try_cast("bigint").alias("_number"), F.lower(column).alias("_lower"))
    return keyed.orderBy(F.col("_number").asc_nulls_last(), "_lower", column).drop("_number", "_lower")
