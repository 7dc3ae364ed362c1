"""Jobs over uploads: filters, usage on catalogue pages, dates and episodes of titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import find_date
from ..functions.episodes import find_episode
from ..functions.urls import host, is_numeric_form, player_key, slug
from . import ordered as O

MIN_SECONDS = 1200


def filter_min_duration(uploads: DataFrame, sec: int = MIN_SECONDS, unknown: str = "keep") -> DataFrame:
    """Keep mixes of at least ``sec``.  NULL stays; 0 stays only with ``unknown='keep_zero'``."""
    d = F.col("duration_s")
    if unknown == "keep_zero":
        d = F.nullif(d, F.lit(0))
    return uploads.where(F.coalesce(d >= sec, F.lit(True)))


def split_by_known_duration(uploads: DataFrame, sec: int = MIN_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(long enough, not known yet): the second part waits for its length."""
    known = F.coalesce("duration_s", F.lit(0)) > 0
    return uploads.where(known & (F.col("duration_s") >= sec)), uploads.where(~known)


def like_count(text) -> Column:
    """Digits of a formatted count; nothing counts as 0."""
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", "")
    return F.coalesce(digits.try_cast("bigint"), F.lit(0))


def filter_min_likes(uploads: DataFrame, n: int) -> DataFrame:
    return uploads.where(like_count("likes_text") >= n)


def filter_listing(uploads: DataFrame, playlists=False, reposts=False, favorites=False,
                   used: DataFrame | None = None, hidden: DataFrame | None = None) -> DataFrame:
    """Each named kind is dropped; ``used(url_key)`` and ``hidden(upload_id)`` leave by anti-join."""
    out = uploads
    for drop, flag in ((playlists, "is_playlist"), (reposts, "is_repost"), (favorites, "is_favorite")):
        if drop:
            out = out.where(~F.col(flag))
    if used is not None:
        out = (out.withColumn("_key", player_key("player_url"))
               .join(used.select(F.col("url_key").alias("_key")), "_key", "left_anti").drop("_key"))
    if hidden is not None:
        out = out.join(hidden.select("upload_id"), "upload_id", "left_anti")
    return out


def usage_status(on_a_page: Column) -> Column:
    """used, unused or unclear, from the address and its key: what has a second form may stand there in that."""
    second_form = F.col("url_key").isNull() | is_numeric_form("player_url") | F.col("url_key").startswith("hearthis.at/")
    return F.when(on_a_page, "used").when(F.coalesce(second_form, F.lit(True)), "unclear").otherwise("unused")


def player_usage(uploads: DataFrame, page_players: DataFrame) -> DataFrame:
    """On how many catalogue pages each upload stands, and when the last of them was edited.

    The pages are counted per address before the join, so an address on very many pages is one
    row there.  An address that has a second, numeric form and is on no page stays unclear: the
    page may carry the other form.
    """
    pages = (page_players.select("url_key", "page_id", "last_edit").distinct()
             .groupBy("url_key").agg(F.count(F.lit(1)).alias("n_pages"), F.max("last_edit").alias("last_edit")))
    keyed = uploads.withColumn("url_key", player_key("player_url"))
    out = keyed.join(pages, "url_key", "left")
    return out.withColumn("n_pages", F.coalesce("n_pages", F.lit(0))).withColumn("status", usage_status(F.col("n_pages") > 0))


def partition_usage(uploads: DataFrame, page_players: DataFrame) -> DataFrame:
    """Every upload address in exactly one of the sets used, unused, unclear."""
    keys = uploads.groupBy(player_key("player_url").alias("url_key")).agg(F.min("player_url").alias("player_url"))
    pages = page_players.select("url_key").distinct().withColumn("_on", F.lit(True))
    return keys.join(pages, "url_key", "left").select("url_key", usage_status(F.col("_on").isNotNull()).alias("part"))


def status_by_either_key(urls: DataFrame, results: DataFrame) -> DataFrame:
    """A result answers for the address asked and for its sanitised form; the later one wins."""
    keys = results.select("result_no", "status", F.explode(F.array("requested", "sanitized")).alias("url"))
    latest = (keys.where(F.col("url").isNotNull()).groupBy("url")
              .agg(F.max_by("status", "result_no").alias("status")))
    return urls.join(latest, "url", "left")


def page_outdated(usage: DataFrame) -> DataFrame:
    """Uploads created when, or after, their page was last edited."""
    return usage.where(F.col("created_at") >= F.col("last_edit"))


def order_used_players(players: DataFrame) -> DataFrame:
    """Rank by the stated order; players without one come last, in the order they came."""
    return O.dense_pos(players, "page_id", [F.col("player_order").asc_nulls_last(), F.col("line_no")],
                       None, name="rank")


def date_candidates(uploads: DataFrame, this_year: Column | None = None) -> DataFrame:
    """The date of each title, with its pattern, readings and the score of the runner-up."""
    found = uploads.withColumn("_d", find_date("title", "created_at", this_year))
    return found.select("*", F.col("_d.out").alias("date_out"), F.to_date("_d.iso").alias("date_iso"),
                        F.col("_d.pattern").alias("date_pattern"), F.col("_d.readings").alias("date_readings"),
                        F.col("_d.score").alias("date_score"), F.col("_d.runner_up").alias("date_runner_up"),
                        F.col("_d.matched").alias("date_text")).drop("_d")


def title_without_date() -> Column:
    return F.trim(F.regexp_replace(
        F.when(F.col("date_text").isNotNull(), F.replace("title", F.col("date_text"), F.lit(" ")))
        .otherwise(F.col("title")), r"\s{2,}", " "))


def episodes_from_titles(uploads: DataFrame, entity_known: Column | None = None,
                         entities: DataFrame | None = None) -> DataFrame:
    """Episode number or id of each title, read after the date is cut out.

    An id that is a known name (``entities.title``) is not an episode: only the ids found are
    joined with the names, so the name list may be of any size.
    """
    base = uploads if "date_text" in uploads.columns else date_candidates(uploads)
    base = base.withColumn("_text", title_without_date())
    known = entity_known if entity_known is not None else F.lit(False)
    out = base.withColumn("_e", find_episode("_text", known))
    if entities is not None:
        ids = (out.where(F.col("_e.kind") != "number").select(F.lower("_e.text").alias("_id")).distinct()
               .join(entities.select(F.lower("title").alias("_id")).distinct(), "_id", "left_semi"))
        out = out.withColumn("_id", F.lower("_e.text"))
        names = out.join(ids, "_id", "left_semi")
        again = names.withColumn("_e", find_episode("_text", known, F.array("_id")))
        out = out.join(ids, "_id", "left_anti").unionByName(again).drop("_id")
    return out.select("*", F.col("_e.text").alias("episode"), F.col("_e.kind").alias("episode_kind")).drop("_e", "_text")


def with_slugs(uploads: DataFrame) -> DataFrame:
    return uploads.withColumn("slug", slug("player_url"))
