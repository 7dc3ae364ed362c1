"""Registered queries over uploads, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import player_key
from ..operators import uploads as U
from ..sources import uploads as S
from . import fixtures as V
from .registry import Registry

query = Registry()

KEY = "regexp_replace(regexp_replace(regexp_replace({0}, '^https?://', ''), '^www[.]', ''), '/$', '')"


def _views(then, *names):
    return V.with_views(*(names or ("v_uploads",)), then=then)


USAGE = f"""
pp AS (SELECT DISTINCT {KEY.format('player_url')} AS url_key, page_id, last_edit FROM v_pages
  UNION SELECT DISTINCT 'soundcloud.com/acct-' || CAST(account + 1 AS VARCHAR) || '/track-' || CAST(page_id + 3 AS VARCHAR), page_id, last_edit FROM v_pages),
pa AS (SELECT url_key, count(*) AS n_pages, max(last_edit) AS last_edit FROM pp GROUP BY 1),
us AS (SELECT u.*, {KEY.format('player_url')} AS url_key FROM v_uploads u),
uh AS (SELECT u.* REPLACE (CASE WHEN is_favorite THEN 'https://hearthis.at/' || CAST(upload_id AS VARCHAR) || '/' ELSE player_url END AS player_url) FROM v_uploads u),
ut AS (SELECT uh.*, {KEY.format('player_url')} AS url_key FROM uh),
uk AS (SELECT ut.*, coalesce(n_pages, 0) AS n_pages, last_edit FROM ut LEFT JOIN pa USING (url_key)),
uj AS (SELECT us.*, coalesce(n_pages, 0) AS n_pages, last_edit FROM us LEFT JOIN pa USING (url_key))
"""


def _with_second_forms(spark, sf):
    """Favourites stand on a platform whose addresses have a second, numeric form."""
    numeric = F.concat(F.lit("https://hearthis.at/"), F.col("upload_id").cast("string"), F.lit("/"))
    return V.v_uploads(spark, sf).withColumn("player_url", F.when(F.col("is_favorite"), numeric).otherwise(F.col("player_url")))


def page_players(spark, sf):
    pages = V.sql_view(spark, sf, "v_pages")
    own = pages.select(player_key("player_url").alias("url_key"), "page_id", "last_edit")
    mirror = pages.select(F.concat(F.lit("soundcloud.com/acct-"), F.col("account") + 1, F.lit("/track-"),
                                   F.col("page_id") + 3).alias("url_key"), "page_id", "last_edit")
    return own.unionByName(mirror).distinct()


@query(_views("SELECT upload_id, coalesce(duration_s, -1) AS duration_s FROM v_uploads WHERE coalesce(duration_s >= 1200, true)"))
def filter_min_duration(spark, sf):
    out = U.filter_min_duration(V.v_uploads(spark, sf))
    return out.select("upload_id", F.coalesce("duration_s", F.lit(-1)).alias("duration_s"))


@query(_views("SELECT upload_id FROM v_uploads WHERE coalesce(duration_s, 0) = 0"))
def defer_unknown_duration(spark, sf):
    return U.split_by_known_duration(V.v_uploads(spark, sf))[1].select("upload_id")


@query(_views("""SELECT upload_id, likes_text FROM v_uploads
   WHERE coalesce(TRY_CAST(nullif(regexp_replace(likes_text, '[^0-9]', '', 'g'), '') AS INT), 0) >= 20"""))
def filter_min_likes(spark, sf):
    return U.filter_min_likes(V.v_uploads(spark, sf), 20).select("upload_id", "likes_text")


@query(_views(USAGE + """SELECT upload_id FROM uj WHERE NOT is_repost AND NOT is_playlist AND NOT is_favorite
   AND n_pages = 0 AND upload_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW')""", "v_uploads", "v_pages"))
def filter_listing(spark, sf):
    hidden = V.read_table(spark, sf, "orders").where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("upload_id"))
    return U.filter_listing(V.v_uploads(spark, sf), True, True, True, page_players(spark, sf), hidden).select("upload_id")


@query(_views(USAGE + """SELECT upload_id, n_pages, coalesce(CAST(last_edit AS VARCHAR), '') AS last_edit,
   CASE WHEN n_pages > 0 THEN 'used' WHEN url_key LIKE 'hearthis.at/%' THEN 'unclear' ELSE 'unused' END AS status FROM uk""", "v_uploads", "v_pages"))
def player_usage(spark, sf):
    out = U.player_usage(_with_second_forms(spark, sf), page_players(spark, sf))
    return out.select("upload_id", "n_pages", F.coalesce(F.col("last_edit").cast("string"), F.lit("")).alias("last_edit"), "status")


@query(_views(USAGE + """, k AS (SELECT DISTINCT url_key FROM ut)
SELECT url_key, CASE WHEN url_key IN (SELECT url_key FROM pa) THEN 'used' WHEN url_key LIKE 'hearthis.at/%' THEN 'unclear' ELSE 'unused' END AS part FROM k""", "v_uploads", "v_pages"))
def partition_usage(spark, sf):
    return U.partition_usage(_with_second_forms(spark, sf), page_players(spark, sf))


@query(_views("""
r AS (SELECT upload_id AS result_no, player_url AS requested, rtrim(player_url, '/') AS sanitized, status FROM v_uploads
      UNION ALL SELECT upload_id + 100000000, rtrim(player_url, '/'), NULL, 'late' FROM v_uploads WHERE is_repost),
k AS (SELECT result_no, status, requested AS url FROM r UNION ALL SELECT result_no, status, sanitized FROM r WHERE sanitized IS NOT NULL),
b AS (SELECT url, max_by(status, result_no) AS status FROM k GROUP BY url)
SELECT u.upload_id, u.player_url AS url, b.status FROM v_uploads u LEFT JOIN b ON u.player_url = b.url"""))
def status_by_either_key(spark, sf):
    u = V.v_uploads(spark, sf)
    bare = F.regexp_replace("player_url", "/+$", "")
    results = u.select(F.col("upload_id").alias("result_no"), F.col("player_url").alias("requested"), bare.alias("sanitized"), "status").unionByName(
        u.where("is_repost").select((F.col("upload_id") + 100000000).alias("result_no"), bare.alias("requested"),
                                    F.lit(None).cast("string").alias("sanitized"), F.lit("late").alias("status")))
    return U.status_by_either_key(u.select("upload_id", F.col("player_url").alias("url")), results)


@query(_views(USAGE + "SELECT upload_id, CAST(created_at AS VARCHAR) AS created_at FROM uj WHERE created_at + 25 >= last_edit", "v_uploads", "v_pages"))
def page_outdated(spark, sf):
    usage = U.player_usage(V.v_uploads(spark, sf), page_players(spark, sf))
    out = U.page_outdated(usage.withColumn("created_at", F.date_add("created_at", 25)))
    return out.select("upload_id", F.date_sub("created_at", 25).cast("string").alias("created_at"))


@query(_views("""
p AS (SELECT account AS page_id, upload_id AS line_no, player_url, CASE WHEN is_repost THEN NULL ELSE duration_s END AS player_order FROM v_uploads)
SELECT page_id, line_no, row_number() OVER (PARTITION BY page_id ORDER BY player_order NULLS LAST, line_no) AS rank FROM p"""))
def order_used_players(spark, sf):
    p = V.v_uploads(spark, sf).select(
        F.col("account").alias("page_id"), F.col("upload_id").alias("line_no"), "player_url",
        F.when(~F.col("is_repost"), F.col("duration_s")).alias("player_order"))
    return U.order_used_players(p).select("page_id", "line_no", F.col("rank").cast("bigint").alias("rank"))


DATES = """
dp AS (SELECT upload_id, created_at, string_split(title, ' | ')[2] AS t, upload_id % 4 AS shape FROM v_uploads),
dy AS (SELECT *, CASE WHEN CAST(substr(t, 7, 2) AS INT) <= 2026 % 100 + 1 THEN '20' ELSE '19' END || substr(t, 7, 2) AS y3,
   CASE WHEN CAST(substr(t, 1, 2) AS INT) <= 2026 % 100 + 1 THEN '20' ELSE '19' END || substr(t, 1, 2) AS y1 FROM dp WHERE shape = 3),
rd AS (
  SELECT upload_id, created_at, 0 AS o, 'isoFull' AS pattern, t AS iso FROM dp WHERE shape = 0
  UNION ALL SELECT upload_id, created_at, 0, 'sepY4', substr(t, 7, 4) || '-' || substr(t, 4, 2) || '-' || substr(t, 1, 2) FROM dp WHERE shape = 1
  UNION ALL SELECT upload_id, created_at, 1, 'sepY4', substr(t, 7, 4) || '-' || substr(t, 1, 2) || '-' || substr(t, 4, 2) FROM dp WHERE shape = 1
  UNION ALL SELECT upload_id, created_at, 0, 'textualMDY', CAST(CAST(strptime(t, '%B %-d, %Y') AS DATE) AS VARCHAR) FROM dp WHERE shape = 2
  UNION ALL SELECT upload_id, created_at, 0, 'sepY2', y3 || '-' || substr(t, 4, 2) || '-' || substr(t, 1, 2) FROM dy
  UNION ALL SELECT upload_id, created_at, 1, 'sepY2', y3 || '-' || substr(t, 1, 2) || '-' || substr(t, 4, 2) FROM dy
  UNION ALL SELECT upload_id, created_at, 2, 'sepY2', y1 || '-' || substr(t, 4, 2) || '-' || substr(t, 7, 2) FROM dy),
rs AS (SELECT *, TRY_CAST(iso AS DATE) AS d FROM rd),
sc AS (SELECT *, abs(d - created_at) + CASE WHEN d > created_at THEN 0.5 ELSE 0 END + o * 0.001 AS s FROM rs WHERE d IS NOT NULL AND year(d) BETWEEN 1950 AND 2026 + 1),
best AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY s, iso) AS r FROM sc),
ru AS (SELECT b.upload_id, min(sc.s) AS runner FROM best b JOIN sc ON b.upload_id = sc.upload_id AND b.r = 1 AND sc.iso <> b.iso GROUP BY 1),
rn AS (SELECT upload_id, count(DISTINCT iso) AS n FROM sc GROUP BY 1)
"""


@query(_views(DATES + """
SELECT b.upload_id, iso AS date_out, pattern AS date_pattern, CAST(n AS INT) AS date_readings, CAST(round(s, 3) AS DOUBLE) AS date_score,
  CAST(coalesce(round(runner, 3), -1) AS DOUBLE) AS date_runner_up
FROM best b JOIN rn USING (upload_id) LEFT JOIN ru USING (upload_id) WHERE r = 1"""))
def date_candidates(spark, sf):
    out = U.date_candidates(V.v_uploads(spark, sf), F.lit(2026))
    return out.select("upload_id", "date_out", "date_pattern", "date_readings", F.round("date_score", 3).alias("date_score"),
                      F.coalesce(F.round("date_runner_up", 3), F.lit(-1.0)).alias("date_runner_up"))


@query(_views("""
SELECT upload_id, CASE upload_id % 5 WHEN 2 THEN 'HPX.' || CAST(upload_id % 500 AS VARCHAR) WHEN 3 THEN '' ELSE CAST(upload_id % 500 AS VARCHAR) END AS episode,
  CASE upload_id % 5 WHEN 2 THEN 'dotted' WHEN 3 THEN '' ELSE 'number' END AS episode_kind FROM v_uploads"""))
def episodes_from_titles(spark, sf):
    out = U.episodes_from_titles(V.v_uploads(spark, sf))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select("upload_id", blank("episode"), blank("episode_kind"))


@query(_views(f"""
SELECT {KEY.format('player_url')} AS url_key, player_url, CASE WHEN duration_s IS NULL THEN 'again' ELSE title END AS title,
  CASE WHEN duration_s IS NULL THEN 1 ELSE CAST(duration_s AS BIGINT) * 1000 END AS duration_ms
FROM v_uploads WHERE duration_s IS NOT NULL OR is_repost"""))
def scan_uploads(spark, sf):
    """Uploads composed into nested dumps (one per upload, two levels deep), read back."""
    u = V.v_uploads(spark, sf)
    item = F.struct(F.col("player_url").alias("url"), "title", (F.col("duration_s").cast("bigint") * 1000).alias("duration"))
    deep = F.to_json(F.struct(F.lit("feed").alias("kind"), F.array(F.struct(F.array(item).alias("entries"))).alias("collection")))
    dumps = u.select(F.col("upload_id").alias("ingest_no"), deep.alias("json"))
    again = u.where("is_repost").select((F.col("upload_id") + 100000000).alias("ingest_no"), F.to_json(F.array(F.struct(
        F.col("player_url").alias("url"), F.lit("again").alias("title"), F.lit(1).alias("duration")))).alias("json"))
    return S.scan_uploads(dumps.unionByName(again))


@query(_views("""
pt AS (SELECT channel AS listing, 1 AS part_no, upload_id AS row_no, player_url AS url, title FROM v_uploads
  UNION ALL SELECT channel, 2, upload_id, player_url, title || ' again' FROM v_uploads WHERE is_repost)
SELECT listing, url, CAST(part_no AS INT) AS part_no, row_no, title FROM (SELECT *, row_number() OVER (PARTITION BY listing, url ORDER BY part_no, row_no) AS r FROM pt) WHERE r = 1"""))
def scan_parts(spark, sf):
    u = V.v_uploads(spark, sf)
    one = u.select(F.col("channel").alias("listing"), F.lit(1).alias("part_no"), F.col("upload_id").alias("row_no"), F.col("player_url").alias("url"), "title")
    two = u.where("is_repost").select(F.col("channel").alias("listing"), F.lit(2).alias("part_no"), F.col("upload_id").alias("row_no"),
                                      F.col("player_url").alias("url"), F.concat("title", F.lit(" again")).alias("title"))
    return S.scan_parts(one.unionByName(two))
