"""Registered queries over catalogue pages, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.urls import slug
from ..operators import catalogue as C
from ..operators import entities as E
from ..session import ensure_checkpoint_dir
from ..sources import catalogue as S
from . import fixtures as V
from .entity_queries import key
from .entity_queries import LOOKUP
from .registry import Registry

query = Registry()


def _views(then, *names):
    return V.with_views(*(names or ("v_pages",)), then=then)


CATS = """
pc AS (SELECT page_id, title, CAST(year(mix_date) AS VARCHAR) AS category, title AS sortkey FROM v_wiki
  UNION ALL SELECT page_id, title, channel, title FROM v_wiki UNION ALL SELECT page_id, title, series, sortkey FROM v_wiki
  UNION ALL SELECT page_id, title, style, title FROM v_wiki UNION ALL SELECT page_id, title, 'Tracklist: incomplete', title FROM v_wiki),
rp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sortkey DESC, page_id DESC) AS rank FROM pc) WHERE rank <= 10)
"""


@query(_views(CATS + "SELECT page_id, category, sortkey FROM pc"))
def page_categories(spark, sf):
    return C.page_categories(V.v_pages(spark, sf).select("page_id", "title", "wikitext")).select("page_id", "category", "sortkey")


def _cats(spark, sf):
    return C.page_categories(V.v_pages(spark, sf).select("page_id", "title", "wikitext")).drop("wikitext")


@query(_views(CATS + "SELECT category, CAST(rank AS INT) AS rank, page_id, title, sortkey FROM rp"))
def recent_pages(spark, sf):
    return C.recent_pages(_cats(spark, sf)).select("category", "rank", "page_id", "title", "sortkey")


@query(_views(CATS + "SELECT category, string_agg(title, '; ' ORDER BY rank) AS recent FROM rp GROUP BY category"))
def recent_titles(spark, sf):
    return C.recent_titles(_cats(spark, sf)).withColumn("recent", F.array_join("recent", "; "))


CONVENTIONS = CATS + """,
sg AS (SELECT r.category, r.rank, r.page_id, r.sortkey, s.* FROM rp r JOIN v_wiki w USING (page_id), LATERAL (VALUES
   ('details', CASE WHEN w.details LIKE '%StandardShow2h%' THEN 'StandardShow2h' ELSE 'table' END),
   ('image', CASE WHEN w.account % 4 = 0 THEN 'other' ELSE 'same' END),
   ('notes', CASE WHEN w.notes <> '' THEN 'yes' ELSE 'none' END),
   ('notes_host', CASE WHEN w.notes <> '' THEN 'groove.example' ELSE 'none' END), ('player', w.mode),
   ('style', w.style), ('style', w.channel), ('style', w.series)) AS s(signal, answer)),
sx AS (SELECT DISTINCT * FROM sg WHERE signal <> 'style' OR answer <> category),
ct AS (SELECT category, count(*) AS nof, count(*) FILTER (WHERE rank <= 5) AS of5, max(sortkey) AS newest_key FROM rp GROUP BY category),
vt AS (SELECT category, signal, answer, count(*) AS n, count(*) FILTER (WHERE rank <= 5) AS n5 FROM sx GROUP BY ALL),
vd AS (SELECT vt.category, signal, answer, n, nof, newest_key FROM vt JOIN ct USING (category)
  WHERE answer <> 'none' AND (n >= nof * 0.9 OR (of5 >= 5 AND n5 = of5)))
"""


@query(_views(CONVENTIONS + 'SELECT category, signal, answer, n, nof AS "of", newest_key FROM vd'))
def learn_conventions(spark, sf):
    return C.learn_conventions(V.v_pages(spark, sf).select("page_id", "title", "wikitext"))


@query(_views(CONVENTIONS + """,
m AS (SELECT page_id AS mix_id, series AS category, mix_date, CASE WHEN account % 3 = 0 THEN 3600 ELSE 7000 END AS duration_s,
   account % 5 = 0 AS place FROM v_wiki)
SELECT mix_id, category, signal, answer FROM m JOIN vd USING (category)
WHERE CAST(substr(newest_key, 1, 10) AS DATE) + INTERVAL 3 YEAR >= mix_date AND NOT place
  AND NOT (answer = 'StandardShow2h' AND abs(duration_s - 7200) > 7200 * 0.3)"""))
def apply_conventions(spark, sf):
    pages = V.v_pages(spark, sf)
    mixes = pages.select(F.col("page_id").alias("mix_id"), F.col("series").alias("category"), "mix_date",
                         F.when(F.col("account") % 3 == 0, 3600).otherwise(7000).alias("duration_s"), F.lit(True).alias("numbered"),
                         F.when(F.col("account") % 5 == 0, F.array(F.lit("venue"))).otherwise(F.array(F.lit("podcast"))).alias("types"))
    verdicts = C.learn_conventions(pages.select("page_id", "title", "wikitext"))
    return C.apply_conventions(mixes, verdicts).select("mix_id", "category", "signal", "answer")


@query(_views(CATS + """,
ln AS (SELECT r.category, r.page_id, 1 AS line_no, regexp_replace(regexp_extract(player_url, '://([^/]+)', 1), '^www[.]', '') AS host FROM rp r JOIN v_wiki USING (page_id) WHERE mode = 'mirrors'
  UNION ALL SELECT r.category, r.page_id, 2, 'hearthis.at' FROM rp r JOIN v_wiki USING (page_id) WHERE mode = 'mirrors'),
t AS (SELECT category, count(DISTINCT page_id) AS n_pages FROM ln GROUP BY 1),
s AS (SELECT category, host, count(DISTINCT page_id) AS n, min(line_no) AS lo, max(line_no) AS hi FROM ln GROUP BY 1, 2)
SELECT category, host, lo AS slot, n_pages FROM s JOIN t USING (category) WHERE n = n_pages AND lo = hi"""))
def learn_slot(spark, sf):
    return C.learn_slot(V.v_pages(spark, sf).select("page_id", "title", "wikitext"))


IDS = "mix_date || ' - ' || channel || ' - ' || series || ' (' || CASE WHEN account % 3 = 0 THEN 'rp' ELSE substr(segment, 1, 2) END || ' ' || CAST(page_id % 500 AS VARCHAR) || ')'"


@query(_views(f"""
pt AS (SELECT page_id, CAST(mix_date AS VARCHAR) AS md, series AS category, CASE WHEN account % 3 = 0 THEN 'rp' ELSE substr(segment, 1, 2) END AS letters FROM v_pages),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md DESC, page_id DESC) AS rank FROM pt) WHERE rank <= 10),
c AS (SELECT category, upper(letters) AS u, count(*) AS n, min_by(letters, rank) AS prefix, min(rank) AS r FROM tp GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, r) AS k FROM c)
SELECT category, prefix, n FROM b WHERE k = 1 AND n >= 2"""))
def series_id_prefix(spark, sf):
    p = V.sql_view(spark, sf, "v_pages")
    letters = F.when(F.col("account") % 3 == 0, "rp").otherwise(F.substring("segment", 1, 2))
    title = F.concat(F.col("mix_date").cast("string"), F.lit(" - "), "channel", F.lit(" - "), "series", F.lit(" ("), letters,
                     F.lit(" "), (F.col("page_id") % 500).cast("string"), F.lit(")"))
    return C.series_id_prefix(p.select("page_id", title.alias("title"), F.col("series").alias("category"), F.col("mix_date").cast("string").alias("sortkey")))


@query(_views(CATS + """,
e AS (SELECT title, CAST(max(mixes) AS INT) AS stored FROM v_entities GROUP BY title),
t AS (SELECT category AS title, count(*) AS counted FROM pc GROUP BY 1)
SELECT title, stored, coalesce(counted, 0) AS counted, stored - coalesce(counted, 0) AS drift FROM e LEFT JOIN t USING (title) WHERE stored <> coalesce(counted, 0)""", "v_pages", "v_entities"))
def audit_counters(spark, sf):
    entities = V.v_entities(spark, sf).groupBy("title").agg(F.max("mixes").alias("mixes"))
    return C.audit_counters(entities, _cats(spark, sf))


@query(_views("""
u AS (SELECT upload_id, lower(regexp_extract(player_url, '://[^/]+/([^/?#]+/[^/?#]+)', 1)) AS slug FROM v_uploads),
sl AS (SELECT DISTINCT page_id, lower(regexp_extract(player_url, '://[^/]+/([^/?#]+/[^/?#]+)', 1)) AS slug FROM v_pages
  UNION SELECT page_id, 'acct-' || CAST(account + 1 AS VARCHAR) || '/track-' || CAST(page_id + 3 AS VARCHAR) FROM v_pages),
ps AS (SELECT slug, count(*) AS n_pages, min(page_id) AS first_page FROM sl WHERE slug <> '' GROUP BY 1)
SELECT upload_id, slug, n_pages, first_page FROM u JOIN ps USING (slug)"""))
def mirror_usage(spark, sf):
    uploads = V.v_uploads(spark, sf).select("upload_id", slug("player_url").alias("slug"))
    return C.mirror_usage(uploads, V.v_pages(spark, sf))


@query(_views("""
s AS (SELECT page_id, title, series AS category, CAST(sortkey AS DATE) AS day FROM v_pages),
m AS (SELECT upload_id AS mix_id, segment || ' ' || entity AS category, mix_date FROM v_uploads WHERE status = 'O'),
j AS (SELECT mix_id, category, abs(day - mix_date) AS days, page_id, title, CASE WHEN day > mix_date THEN 1 ELSE 0 END AS aft FROM m JOIN s USING (category) WHERE abs(day - mix_date) <= 60),
r AS (SELECT *, row_number() OVER (PARTITION BY mix_id ORDER BY days, aft, CASE WHEN aft = 1 THEN page_id ELSE -page_id END) AS rank FROM j)
SELECT mix_id, category, CAST(rank AS INT) AS rank, CAST(days AS INT) AS days, page_id, title FROM r WHERE rank <= 3"""))
def siblings_around(spark, sf):
    pages = V.sql_view(spark, sf, "v_pages").select("page_id", "title", "sortkey", F.col("series").alias("category"))
    mixes = V.v_uploads(spark, sf).where("status = 'O'").select(
        F.col("upload_id").alias("mix_id"), F.concat("segment", F.lit(" "), "entity").alias("category"), "mix_date")
    return C.siblings_around(mixes, pages)


TITLES = """
tt AS (SELECT upload_id AS page_id, mix_date, channel, entity, account, CAST(year(mix_date) AS VARCHAR) AS year,
  CAST(mix_date AS VARCHAR) || ' - ' || channel || CASE account % 4 WHEN 0 THEN ' & Guest' WHEN 1 THEN ', Friend' WHEN 2 THEN ' @ Fabric, London' ELSE '' END ||
  CASE WHEN account % 4 = 2 THEN '' ELSE ' - ' || entity || CASE WHEN account % 7 = 0 THEN ' (Promo Mix)' ELSE '' END END AS title FROM v_uploads)
"""


def _titles(spark, sf):
    k = F.col("account") % 4
    more = F.when(k == 0, " & Guest").when(k == 1, ", Friend").when(k == 2, " @ Fabric, London").otherwise("")
    entity = F.when(k == 2, "").otherwise(F.concat(F.lit(" - "), "entity", F.when(F.col("account") % 7 == 0, " (Promo Mix)").otherwise("")))
    return V.v_uploads(spark, sf).select(F.col("upload_id").alias("page_id"), F.concat(F.col("mix_date").cast("string"), F.lit(" - "), "channel", more, entity).alias("title"))


@query(_views(TITLES + """SELECT page_id, year, channel || CASE account % 4 WHEN 0 THEN '; Guest' WHEN 1 THEN '; Friend' ELSE '' END AS artists,
  CASE WHEN account % 4 = 2 THEN 'Fabric' ELSE entity END AS entity, CASE WHEN account % 4 = 2 THEN 'Fabric; London' ELSE entity END AS entities FROM tt""", "v_uploads"))
def parse_page_titles(spark, sf):
    out = C.parse_page_titles(_titles(spark, sf))
    return out.select("page_id", "year", F.array_join("artists", "; ").alias("artists"), "entity", F.array_join("entities", "; ").alias("entities"))


@query(_views(f"""
m AS (SELECT upload_id AS mix_id, CAST(mix_date AS VARCHAR) || ' - ' || channel || ' - ' || entity || ' ' || CAST(upload_id % 500 AS VARCHAR) AS title, channel, CAST(year(mix_date) AS VARCHAR) AS y FROM v_uploads),
ex AS (SELECT mix_id, 'exact' AS kind, count(*) AS n, min(m.title) AS titles FROM m JOIN v_pages p USING (title) GROUP BY mix_id),
pk AS (SELECT {key('channel')} AS a, CAST(year(mix_date) AS VARCHAR) AS y, title, page_id FROM v_pages),
rk AS (SELECT *, row_number() OVER (PARTITION BY a, y ORDER BY title DESC, page_id) AS r, count(*) OVER (PARTITION BY a, y) AS n FROM pk),
tk AS (SELECT a, y, any_value(n) AS n, string_agg(title, '; ' ORDER BY r) AS titles FROM rk WHERE r <= 10 GROUP BY a, y)
SELECT * FROM ex UNION ALL SELECT mix_id, 'similar:' || a, n, titles FROM m JOIN tk ON {key('m.channel')} = tk.a AND m.y = tk.y"""))
def duplicate_candidates(spark, sf):
    u = V.v_uploads(spark, sf)
    mixes = u.select(F.col("upload_id").alias("mix_id"), F.concat(F.col("mix_date").cast("string"), F.lit(" - "), "channel", F.lit(" - "), "entity",
                     F.lit(" "), (F.col("upload_id") % 500).cast("string")).alias("title"))
    return C.duplicate_candidates(mixes, V.sql_view(spark, sf, "v_pages").select("page_id", "title"))


@query(_views(TITLES + f""",
{LOOKUP.split("mt AS (")[0]}
bt AS (SELECT key AS k, first(title ORDER BY CASE match_type WHEN 'exact' THEN 0 WHEN 'redirect' THEN 1 ELSE 2 END, mixes DESC, title) AS title,
  first(mixes ORDER BY CASE match_type WHEN 'exact' THEN 0 WHEN 'redirect' THEN 1 ELSE 2 END, mixes DESC, title) AS mixes FROM lt WHERE key <> '' GROUP BY key),
rw AS (SELECT page_id, 0 AS o, 'year' AS kind, year AS category FROM tt UNION ALL SELECT page_id, 1, 'artist', channel FROM tt
  UNION ALL SELECT page_id, 2, 'artist', CASE account % 4 WHEN 0 THEN 'Guest' ELSE 'Friend' END FROM tt WHERE account % 4 < 2
  UNION ALL SELECT page_id, 3, 'bucket', 'Promo Mix' FROM tt WHERE account % 4 <> 2 AND account % 7 = 0
  UNION ALL SELECT page_id, 3, 'entity', entity FROM tt WHERE account % 4 <> 2 AND account % 7 <> 0
  UNION ALL SELECT page_id, 3, 'entity', 'Fabric' FROM tt WHERE account % 4 = 2 UNION ALL SELECT page_id, 4, 'entity', 'London' FROM tt WHERE account % 4 = 2
  UNION ALL SELECT page_id, 5, 'style', 'House' FROM tt UNION ALL SELECT page_id, 6, 'status', 'Tracklist: none' FROM tt),
nm AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS INT) AS pos FROM rw)
SELECT page_id AS mix_id, pos, kind, category, bt.k IS NOT NULL AS known, coalesce(bt.title, category) AS canonical, coalesce(bt.mixes, 0) AS mixes
FROM nm LEFT JOIN bt ON nm.kind IN ('artist', 'entity') AND {key('category')} = bt.k""", "v_uploads", "v_entities"))
def category_plan(spark, sf):
    mixes = _titles(spark, sf).select(F.col("page_id").alias("mix_id"), "title", F.array(F.lit("House")).alias("styles"), F.lit("none").alias("tl_status"))
    lookup = E.best_lookup(V.v_entities(spark, sf), V.v_aliases(spark, sf))
    return C.category_plan(mixes, lookup)


@query(_views("""
u AS (SELECT upload_id, segment, upload_id % 4 AS k FROM v_uploads)
SELECT upload_id, 'https://groove.example/2026/08/12/episode-' || CAST(upload_id AS VARCHAR) AS url FROM u WHERE segment = 'BUILDING' AND k < 3"""))
def notes_url(spark, sf):
    u = V.v_uploads(spark, sf)
    k, no = F.col("upload_id") % 4, F.col("upload_id").cast("string")
    link = F.concat(F.lit("groove.example/2026/08/12/episode-"), no)
    text = F.when(k == 0, F.concat(F.lit("Out now, see www.other.example/none and "), link)).when(k == 1, "Visit groove.example/ today").otherwise("")
    buy = F.when(k == 1, F.concat(F.lit("https://"), link)).when(k == 2, F.concat(F.lit("http://bit.ly/ep"), no)).otherwise("https://other.example/a-long-enough-path")
    uploads = u.select("upload_id", F.col("segment").alias("series"), text.alias("description"), buy.alias("buy_url"))
    redirects = u.select(F.concat(F.lit("http://bit.ly/ep"), no).alias("short"), F.concat(F.lit("https://"), link).alias("target"))
    verdicts = u.where("segment = 'BUILDING'").select(F.col("segment").alias("series"), F.lit("groove.example").alias("host")).distinct()
    return C.notes_url(uploads, verdicts, redirects)


@query(_views(CONVENTIONS + """,
ws AS (SELECT category, answer, n, answer IN ('Techno', 'House', 'Deep House', 'Tech House', 'Ambient') AS is_style FROM vd WHERE signal = 'style'),
wr AS (SELECT *, row_number() OVER (PARTITION BY category, is_style ORDER BY n DESC, answer) AS r FROM ws)
SELECT category, answer, n, CASE WHEN is_style AND r <= 2 THEN 'written' ELSE 'hint' END AS use FROM wr"""))
def learned_styles(spark, sf):
    pages = V.v_pages(spark, sf)
    return C.learned_styles(C.learn_conventions(pages.select("page_id", "title", "wikitext")), pages.select("style").distinct())


@query(_views("""
SELECT page_id, 'https://youtu.be/abcdefghijk' AS added, CAST(CASE WHEN mode = 'mirrors' THEN 3 ELSE 2 END AS INT) AS n_lines,
  CASE WHEN page_id % 3 = 2 THEN CASE WHEN mode = 'mirrors' THEN 'hearthis.at' ELSE 'www.youtube.com' END WHEN page_id % 3 = 0 THEN 'soundcloud.com'
    ELSE CASE WHEN mode = 'mirrors' THEN 'hearthis.at' ELSE 'youtu.be' END END AS first_host FROM v_wiki"""))
def player_blocks(spark, sf):
    pages = V.v_pages(spark, sf)
    new = pages.select("page_id", F.lit("https://youtu.be/abcdefghijk").alias("url"))
    out = C.player_blocks(pages.select("page_id", "wikitext"), new)
    lines = F.filter(F.split("player", "\n"), lambda l: l.startswith(" |"))
    added = F.regexp_extract("wikitext", r"(https://youtu\.be/abcdefghijk)", 1)
    return out.select("page_id", added.alias("added"), F.size(lines).alias("n_lines"),
                      F.regexp_extract(lines[0], r"://([^/]+)", 1).alias("first_host"))


@query(_views("""
SELECT page_id, '2026-01-01 - New Act - Show ' || CAST(page_id AS VARCHAR) AS title,
  replace(CASE WHEN account % 4 = 0 THEN image_line ELSE replace(image_line, title, '2026-01-01 - New Act - Show ' || CAST(page_id AS VARCHAR)) END, '', '') || chr(10) || '== File details ==' || chr(10) || details || chr(10) ||
  '{{Player' || CASE WHEN mode = 'mirrors' THEN '|mode=mirrors' ELSE '' END || chr(10) || ' |' || chr(10) || '}}' || chr(10) ||
  CASE WHEN notes <> '' THEN '== Notes ==' || chr(10) || chr(10) ELSE '' END ||
  '<!-- https://soundcloud.com/acct-' || CAST(account + 1 AS VARCHAR) || '/track-' || CAST(page_id + 3 AS VARCHAR) || ' -->' || chr(10) ||
  '== Tracklist ==' || chr(10) || chr(10) || '[[Category:2026]]' || chr(10) || '[[Category:New Act]]' || chr(10) || '[[Category:' || series || '|' || sortkey || ']]' || chr(10) ||
  '[[Category:' || style || ']]' || chr(10) || '[[Category:Tracklist: incomplete]]' AS wikitext FROM v_wiki"""))
def clone_pages(spark, sf):
    pages = V.v_pages(spark, sf).select("page_id", "title", "wikitext")
    new = pages.select("page_id", F.concat(F.lit("2026-01-01 - New Act - Show "), F.col("page_id").cast("string")).alias("new_title"))
    return C.clone_pages(pages, new)


@query(_views(CATS + "SELECT page_id, any_value(title) AS title, count(*) AS n_categories FROM pc GROUP BY page_id"))
def scan_catalogue(spark, sf):
    """Pages written as an XML export in the checkpoint folder, then read back."""
    path = f"{ensure_checkpoint_dir(spark)}/catalogue-{uuid.uuid4().hex}"
    pages = V.v_pages(spark, sf)
    export = pages.select("title", F.lit(0).alias("ns"), F.col("page_id").alias("id"),
                          F.struct(F.col("last_edit").cast("string").alias("timestamp"), F.col("wikitext").alias("text")).alias("revision"))
    export.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)
    out = S.scan_catalogue(spark, path)
    return out.select("page_id", "title", F.size("categories").cast("bigint").alias("n_categories"))
