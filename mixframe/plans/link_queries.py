"""Registered queries over episodes, addresses and sinks, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import episodes as E
from ..operators import links as L
from ..operators.catalogue import order_players as _order_players
from ..sources import sinks
from . import fixtures as V
from .registry import Registry

query = Registry()


def _views(then, *names):
    return V.with_views(*(names or ("v_episodes",)), then=then)


def _sources(spark, sf):
    e = V.v_episodes(spark, sf)
    return [e.where(F.col("source") == s) for s in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]


UNION = """
un AS (SELECT *, CAST(substr(source, 1, 1) AS INT) - 1 AS source_no FROM v_episodes),
uf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_no ORDER BY source_no, entry_no) AS r FROM un) WHERE r = 1)
"""


@query(_views(UNION + "SELECT episode_no, CAST(source_no AS INT) AS source_no, entry_no, url, duration_s FROM uf"))
def union_sources(spark, sf):
    return E.union_sources(*_sources(spark, sf))


MISSING = """
pg AS (SELECT DISTINCT CAST(o_custkey % 500 AS INT) AS episode_no FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000 AND o_orderpriority = '2-HIGH'),
ls AS (SELECT episode_no, min(entry_no) AS entry_no FROM v_episodes GROUP BY 1),
mn AS (SELECT DISTINCT episode_no FROM v_episodes WHERE source = '5-LOW' AND status = 'P'),
ms AS (SELECT * FROM ls WHERE episode_no NOT IN (SELECT episode_no FROM pg) AND episode_no NOT IN (SELECT episode_no FROM mn))
"""


def _missing(spark, sf):
    e, o = V.v_episodes(spark, sf), V.read_table(spark, sf, "orders")
    listing = e.groupBy("episode_no").agg(F.min("entry_no").alias("entry_no"))
    # every order has a page; some of the pages are episodes
    episode = F.expr("o_orderstatus = 'F' AND o_totalprice > 250000 AND o_orderpriority = '2-HIGH'")
    kind = F.when(episode, " - Act - MIX Episode ").otherwise(" - Act - MIX Special ")
    named = e.where("source = '5-LOW' AND status = 'P'").select("episode_no").distinct()
    hand = named.select("episode_no", F.concat(F.lit("Spécial Show No "), F.col("episode_no").cast("string"), F.lit("!")).alias("title"))
    pages = o.select(F.concat(F.col("o_orderdate").cast("date").cast("string"), kind, (F.col("o_custkey") % 500).cast("string")).alias("title"))
    pages = pages.unionByName(named.select(F.concat(F.lit("special show no "), F.col("episode_no").cast("string")).alias("title")))
    return E.missing_episodes(listing, pages, r"MIX Episode (\d+)$", hand)


@query(_views(MISSING + "SELECT episode_no, entry_no FROM ms"))
def missing_episodes(spark, sf):
    return _missing(spark, sf)


@query(_views(MISSING + """,
pr AS (SELECT * FROM (VALUES ('1-URGENT', 1), ('2-HIGH', 2)) t(source, priority)),
ep AS (SELECT * FROM v_episodes),
mo AS (SELECT * FROM ms UNION ALL SELECT episode_no + 1000, entry_no FROM ms),
o1 AS (SELECT * FROM (SELECT ep.*, coalesce(priority, 1000000) AS pri, row_number() OVER (PARTITION BY episode_no, ep.source ORDER BY entry_no) AS r FROM ep LEFT JOIN pr USING (source)) WHERE r = 1),
pe AS (SELECT episode_no, string_agg(url, ' ' ORDER BY pri, url) AS urls FROM o1 GROUP BY 1),
du AS (SELECT episode_no, arg_min(duration_s, pri * 100 + CAST(substr(source, 1, 1) AS INT)) AS duration_s FROM o1 WHERE duration_s > 0 GROUP BY 1)
SELECT episode_no, entry_no, coalesce(urls, 'https://scraped.example/' || CAST(entry_no AS VARCHAR)) AS urls, coalesce(duration_s, -1) AS duration_s
FROM mo LEFT JOIN pe USING (episode_no) LEFT JOIN du USING (episode_no)"""))
def attach_players(spark, sf):
    missing = _missing(spark, sf)
    # the same number again in a range that no platform has
    missing = missing.unionByName(missing.withColumn("episode_no", (F.col("episode_no") + 1000).cast("int"))).withColumn("scraped_url", F.concat(F.lit("https://scraped.example/"), F.col("entry_no").cast("string")))
    e = V.v_episodes(spark, sf)
    priorities = e.where("source IN ('1-URGENT', '2-HIGH')").select("source").distinct().withColumn("priority", F.substring("source", 1, 1).cast("int"))
    out = E.attach_players(missing, e, priorities)
    return out.select("episode_no", "entry_no", F.array_join("urls", " ").alias("urls"), F.coalesce("duration_s", F.lit(-1)).alias("duration_s"))


@query(_views("""
u AS (SELECT episode_no AS mix_id, entry_no AS pos, CASE entry_no % 4 WHEN 0 THEN 'https://soundcloud.com/a/' WHEN 1 THEN 'https://www.mixcloud.com/a/'
  WHEN 2 THEN 'https://podcasts.apple.com/a/' ELSE 'https://other.example/a/' END || CAST(entry_no AS VARCHAR) AS url FROM v_episodes)
SELECT mix_id, pos, url, CAST(row_number() OVER (PARTITION BY mix_id ORDER BY CASE pos % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 0 ELSE 5 END, pos) AS INT) AS rank FROM u"""))
def order_players(spark, sf):
    k = F.col("entry_no") % 4
    site = (F.when(k == 0, "https://soundcloud.com/a/").when(k == 1, "https://www.mixcloud.com/a/")
            .when(k == 2, "https://podcasts.apple.com/a/").otherwise("https://other.example/a/"))
    urls = V.v_episodes(spark, sf).select(F.col("episode_no").alias("mix_id"), F.col("entry_no").alias("pos"), F.concat(site, F.col("entry_no").cast("string")).alias("url"))
    return _order_players(urls)


@query(_views("SELECT CASE WHEN entry_no % 3 = 0 THEN 'Special ' || CAST(episode_no AS VARCHAR) ELSE CAST(episode_no AS VARCHAR) END AS episode_key, entry_no FROM v_episodes"))
def order_episode_keys(spark, sf):
    number = F.col("episode_no").cast("string")
    e = V.v_episodes(spark, sf).select(F.when(F.col("entry_no") % 3 == 0, F.concat(F.lit("Special "), number)).otherwise(number).alias("episode_key"), "entry_no")
    return E.order_episode_keys(e)


@query(_views(UNION + """SELECT source, episode_no, '"' || CAST(episode_no AS VARCHAR) || '": {"url":"' || url || '"' ||
   CASE WHEN duration_s > 0 THEN ',"duration":' || CAST(duration_s AS VARCHAR) ELSE '' END || '}' AS entry FROM uf""".replace("FROM uf", "FROM v_episodes")))
def write_episode_map(spark, sf):
    return sinks.episode_map(V.v_episodes(spark, sf))


@query(_views("""
SELECT upload_id AS mix_id, CASE WHEN is_repost THEN '' ELSE '[[File:' || title || '.jpg|right|360px]]' || chr(10) || chr(10) END ||
  '== File details ==' || chr(10) || chr(10) || '{|{{NormalTableFormat}}' || chr(10) || '! dur' || chr(10) || '! MB' || chr(10) || '! kbps' || chr(10) || '|-' || chr(10) || '| ' ||
  CASE WHEN duration_s > 0 THEN CAST(duration_s // 3600 AS VARCHAR) || ':' || right('0' || CAST((duration_s % 3600) // 60 AS VARCHAR), 2) || ':' || right('0' || CAST(duration_s % 60 AS VARCHAR), 2) ELSE '' END ||
  chr(10) || '| 2.00' || chr(10) || '| ' || chr(10) || '|}' || chr(10) || chr(10) ||
  CASE WHEN is_playlist THEN '' WHEN contains(player_url, '=') THEN '{{Player' || chr(10) || ' |1=' || player_url || chr(10) || '}}' || chr(10) || chr(10) ELSE '{{Player' || chr(10) || ' |' || player_url || chr(10) || '}}' || chr(10) || chr(10) END ||
  CASE WHEN is_favorite THEN '== Notes ==' || chr(10) || chr(10) || 'Episode' || chr(10) || chr(10) ELSE '' END ||
  '== Tracklist ==' || chr(10) || chr(10) || '<list>' || chr(10) || chr(10) || '</list>' || chr(10) || chr(10) ||
  '[[Category:' || CAST(year(mix_date) AS VARCHAR) || ']]' || chr(10) || '[[Category:' || channel || ']]' || chr(10) || '[[Category:Tracklist: none]]' AS wikitext FROM v_uploads""", "v_uploads"))
def write_page_text(spark, sf):
    u = V.v_uploads(spark, sf)
    none = F.lit(None).cast("string")
    mixes = u.select(
        F.col("upload_id").alias("mix_id"), F.when(~F.col("is_repost"), F.concat("title", F.lit(".jpg"))).alias("image"), "duration_s",
        F.lit(2 * 1048576).alias("bytes"), F.when(F.col("is_playlist"), F.array().cast("array<string>")).otherwise(F.array("player_url")).alias("urls"),
        F.when(F.col("is_favorite"), "Episode").alias("notes"), none.alias("tracklist"),
        F.array(F.year("mix_date").cast("string"), "channel", F.lit(""), F.lit("Tracklist: none")).alias("categories"))
    return sinks.page_text(mixes)


# Behind each page, the ways of writing an address that the crawled ones do not have
WRITTEN = [" <!-- <a href='/hidden/", "'> --><A  class=x HREF=/bare/", " rel=next>x</a><iframe data-src='//player.example/2024-05-", "' title='a > b href=no' src=\"/second?x=1&amp;y=2#", "\"></iframe><source src = ' /spaced/", " '>"]

LINKS = """
pg AS (SELECT page_id, url, html || """ + " || CAST(page_id % 90 + 10 AS VARCHAR) || ".join("'" + w.replace("'", "''") + "'" for w in WRITTEN) + """ AS html FROM pages),
tg AS (SELECT page_id, url AS page, i, tag FROM (SELECT page_id, url, regexp_extract_all(html,
  '(?is)<!--.*?-->|<(?:script|style)\\b.*?</(?:script|style)\\s*>|<(?:a|iframe|embed|audio|video|source)\\b(?:[^>"\'\']|"[^"]*"|\'\'[^\'\']*\'\')*>') AS tags FROM pg), unnest(tags) WITH ORDINALITY AS t(tag, i)),
atr AS (SELECT page_id, page, i, j, a, regexp_extract(a, '(?s)=\\s*(.*)$', 1) AS v FROM (SELECT page_id, page, i, regexp_extract_all(tag,
  '(?s)[^\\s"\'\'>/=]+\\s*=\\s*(?:"[^"]*"|\'\'[^\'\']*\'\'|[^\\s"\'\'<>`]+)') AS attrs FROM tg WHERE NOT regexp_matches(tag, '(?i)^<(?:!|script|style)')), unnest(attrs) WITH ORDINALITY AS t(a, j)),
ln AS (SELECT *, CASE WHEN v[1] IN ('"', '\'\'') THEN v[2:-2] ELSE v END AS raw FROM atr WHERE lower(regexp_extract(a, '^([^\\s=]+)', 1)) IN ('href', 'src', 'data-src')),
lk AS (SELECT page_id, page, raw, row_number() OVER (PARTITION BY page_id ORDER BY i, j) - 1 AS pos FROM ln WHERE trim(raw) <> '')
"""


@query("WITH " + LINKS + """,
ab AS (SELECT *, replace(trim(raw), '&amp;', '&') AS d, regexp_extract(page, '^([a-z]+://[^/]+)', 1) AS root FROM lk),
fu AS (SELECT *, CASE WHEN regexp_matches(d, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN d WHEN starts_with(d, '//') THEN 'https:' || d WHEN starts_with(d, '/') THEN root || d
  WHEN starts_with(d, '#') THEN string_split(page, '#')[1] || d ELSE regexp_replace(string_split(string_split(page, '?')[1], '#')[1], '[^/]*$', '') || d END AS f FROM ab)
SELECT page_id, CAST(pos AS INT) AS pos, raw, CASE WHEN regexp_matches(f, '^https?://') THEN 'https://' || regexp_replace(lower(regexp_extract(f, '://([^/?#]+)', 1)), '^www[.]', '') ||
  regexp_extract(regexp_replace(string_split(string_split(f, '?')[1], '#')[1], '/+$', ''), '^[a-z]+://[^/]+(.*)$', 1) ||
  CASE WHEN contains(f, '?x=') THEN '?x=1&y=2' ELSE '' END ELSE f END AS url, nullif(regexp_extract(f, '((?:19|20)\\d{2}-\\d{2}-\\d{2})', 1), '') AS dated FROM fu""")
def scan_links(spark, sf):
    pages = V.spread(V.read_table(spark, sf, "pages"))
    number = (F.col("page_id") % 90 + 10).cast("string")
    behind = [x for w in WRITTEN for x in (number, F.lit(w))][1:]
    return L.scan_links(pages.withColumn("html", F.concat("html", *behind)))


HOST = "regexp_replace(lower(regexp_extract(url, '://([^/?#]+)', 1)), '^www[.]', '')"


@query("WITH " + f"""
c AS (SELECT page_id, url, {HOST} AS host, array_to_string(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'),
    lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z_]+|si|fbclid|gclid|igshid|mc_[ce]id|ref)(=|$)')), '&') AS asked, regexp_replace(string_split(string_split(url, '?')[1], '#')[1], '/+$', '') AS plain FROM pages)
SELECT page_id, url, host, 'https://' || host || regexp_extract(plain, '^[a-z]+://[^/]+(.*)$', 1) || CASE WHEN asked <> '' THEN '?' || asked ELSE '' END AS canonical,
  regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '^www[.]', ''), '/$', '') AS url_key,
  regexp_replace(regexp_replace(url, '/$', ''), '[^/]*$', '') || replace(regexp_extract(regexp_replace(url, '/$', ''), '([^/]*)$', 1), '.', '') || '/' AS undotted,
  CAST(NULL AS VARCHAR) AS video_id, CAST(NULL AS VARCHAR) AS playlist, false AS numeric_form FROM c
UNION ALL SELECT -1 - page_id, 'https://hearthis.at/' || CAST(page_id AS VARCHAR) || '/', 'hearthis.at', 'https://hearthis.at/' || CAST(page_id AS VARCHAR) || '/',
  'hearthis.at/' || CAST(page_id AS VARCHAR), 'https://hearthis.at/' || CAST(page_id AS VARCHAR) || '/', NULL, NULL, true FROM pages""")
def canonical_urls(spark, sf):
    """The addresses of all pages, and for each an embedded player's."""
    pages = V.read_table(spark, sf, "pages")
    players = pages.select((-1 - F.col("page_id")).alias("page_id"), F.concat(F.lit("https://hearthis.at/"), F.col("page_id").cast("string"), F.lit("/")).alias("url"))
    return L.canonical_urls(pages.select("page_id", "url").unionByName(players))


@query(_views("""SELECT upload_id, 'https://www.youtube.com/watch?v=' || lpad(CAST(upload_id AS VARCHAR), 11, 'x') AS canonical, lpad(CAST(upload_id AS VARCHAR), 11, 'x') AS video_id FROM v_uploads""", "v_uploads"))
def video_ids(spark, sf):
    """Five ways to write one video, all read as the same address."""
    u = V.v_uploads(spark, sf)
    v = F.lpad(F.col("upload_id").cast("string"), 11, "x")
    k = F.col("upload_id") % 5
    form = (F.when(k == 0, F.concat(F.lit("https://youtu.be/"), v, F.lit("?si=abc"))).when(k == 1, F.concat(F.lit("https://m.youtube.com/shorts/"), v))
            .when(k == 2, F.concat(F.lit("https://www.youtube-nocookie.com/embed/"), v, F.lit("?start=0")))
            .when(k == 3, F.concat(F.lit("https://consent.youtube.com/m?continue="), F.url_encode(F.concat(F.lit("https://www.youtube.com/watch?v="), v)), F.lit("&gl=DE")))
            .otherwise(F.concat(F.lit("https://gate.sc/?url="), F.url_encode(F.concat(F.lit("https://youtu.be/"), v)), F.lit("&token=1"))))
    out = L.canonical_urls(u.select("upload_id", form.alias("url")))
    return out.select("upload_id", "canonical", F.coalesce("video_id", F.regexp_extract("canonical", "v=(.+)$", 1)).alias("video_id"))


@query(_views("""SELECT upload_id, player_url AS url FROM v_uploads""", "v_uploads"))
def filter_supported_hosts(spark, sf):
    u = V.v_uploads(spark, sf).select("upload_id", F.col("player_url").alias("url"))
    other = u.select("upload_id", F.lit("https://elsewhere.example/x").alias("url"))
    return L.filter_supported_hosts(u.unionByName(other))


@query(_views("""SELECT upload_id, CASE upload_id % 5 WHEN 0 THEN 'https://soundcloud.com/a/sets/s' || CAST(upload_id AS VARCHAR) WHEN 1 THEN 'https://www.mixcloud.com/a/playlists/s' || CAST(upload_id AS VARCHAR) || '/'
  ELSE 'https://www.youtube.com/playlist?list=PL' || CAST(upload_id AS VARCHAR) END AS playlist FROM v_uploads WHERE upload_id % 5 < 3""", "v_uploads"))
def filter_public_playlists(spark, sf):
    k, n = F.col("upload_id") % 5, F.col("upload_id").cast("string")
    url = (F.when(k == 0, F.concat(F.lit("https://m.soundcloud.com/a/sets/s"), n, F.lit("?si=1"))).when(k == 1, F.concat(F.lit("https://mixcloud.com/a/playlists/s"), n, F.lit("/?x=1")))
           .when(k == 2, F.concat(F.lit("https://www.youtube.com/watch?v=abcdefghijk&list=PL"), n)).when(k == 3, F.concat(F.lit("https://www.youtube.com/playlist?list=RD"), n))
           .otherwise("https://www.youtube.com/playlist?list=WL"))
    return L.filter_public_playlists(V.v_uploads(spark, sf).select("upload_id", url.alias("url"))).drop("url")


@query(_views("""SELECT upload_id, 'https://i1.example/art-' || CAST(upload_id AS VARCHAR) || '-original.jpg' AS original, 'https://i1.example/art-' || CAST(upload_id AS VARCHAR) || '-original.png' AS other_extension,
   'https://x.example/l' || CAST(upload_id AS VARCHAR) || '.jpg' AS widest FROM v_uploads""", "v_uploads"))
def artwork_urls(spark, sf):
    n = F.col("upload_id").cast("string")
    size = F.when(F.col("upload_id") % 2 == 0, "-t500x500.jpg").otherwise("-large.jpg")
    srcset = F.concat(F.lit("https://x.example/s"), n, F.lit(".jpg 200w, https://x.example/l"), n, F.lit(".jpg 1200w, https://x.example/m"), n, F.lit(".jpg 600w"))
    out = L.artwork_urls(V.v_uploads(spark, sf).select("upload_id", F.concat(F.lit("https://i1.example/art-"), n, size).alias("artwork"), srcset.alias("srcset")))
    return out.select("upload_id", "original", "other_extension", "widest")


@query("""SELECT event_id, regexp_extract(props, '"k": ?([0-9]+)', 1) AS identifier FROM events""")
def json_fields(spark, sf):
    e = V.read_table(spark, sf, "events")
    nested = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props"))
    out = L.json_fields(e.select("event_id", nested.alias("json")), names=("k",))
    return out.select("event_id", F.coalesce("identifier", F.lit("")).alias("identifier"))
