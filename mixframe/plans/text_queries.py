"""Registered queries over fields, durations, titles and crawled rows, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities as E
from ..operators import fields
from ..operators import titles as T
from ..sources import html_rows
from . import fixtures as V
from .registry import Registry
from .upload_queries import DATES

query = Registry()


def _views(then, *names):
    return V.with_views(*(names or ("v_tracks",)), then=then)


@query(_views("""
d AS (SELECT tl_id, pos, start_s, tl_id % 5 AS k FROM v_tracks)
SELECT tl_id, pos, CASE k WHEN 4 THEN 0 ELSE start_s END AS seconds_or_0,
  CASE k WHEN 4 THEN '' ELSE CAST(start_s // 3600 AS VARCHAR) || ':' || right('0' || CAST((start_s % 3600) // 60 AS VARCHAR), 2) || ':' || right('0' || CAST(start_s % 60 AS VARCHAR), 2) END AS clock FROM d"""))
def durations(spark, sf):
    s = F.col("start_s")
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    k = F.col("tl_id") % 5
    raw = (F.when(k == 0, F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), two((s % 3600) / 60), F.lit(":"), two(s % 60)))
           .when(k == 1, F.concat(F.floor(s / 60).cast("string"), F.lit(": "), two(s % 60)))
           .when(k == 2, F.concat(F.lit("PT0M"), s.cast("string"), F.lit("S"))).when(k == 3, s.cast("string")).otherwise("n/a"))
    out = fields.durations(V.v_tracks(spark, sf).select("tl_id", "pos", raw.alias("raw")))
    return out.select("tl_id", "pos", "seconds_or_0", F.coalesce("clock", F.lit("")).alias("clock"))


@query(_views("""
SELECT tl_id, pos, CASE tl_id % 6 WHEN 0 THEN artist || ' - ' || title WHEN 1 THEN artist || ', Other - ' || title WHEN 2 THEN artist || ' (feat. Someone) - ' || title
  WHEN 3 THEN artist || ' - ' || title || ' (Night Remix)' WHEN 4 THEN artist || ' - ' || title ELSE artist || ' - ' || title || ' (' || artist || ' Remix)' END AS text,
  CASE WHEN label = 'Brand#1' AND tl_id % 6 = 1 THEN artist || ' Records' WHEN label = 'Brand#1' THEN '' WHEN label = 'Brand#2' THEN 'Small' WHEN label = 'Brand#3' THEN 'Reprint' ELSE 'Label Deep' END AS label FROM v_tracks"""))
def track_fields(spark, sf):
    k, a, t = F.col("tl_id") % 6, F.col("artist"), F.col("title")
    artist = (F.when(k == 0, F.concat(a, F.lit(" (US)"))).when(k == 1, F.concat(a, F.lit(", Other, "), F.upper(a)))
              .when(k == 5, F.concat(a, F.lit(""))).otherwise(a))
    title = (F.when(k == 0, F.concat(t, F.lit(" (2016 - Remaster)"))).when(k == 2, F.concat(t, F.lit(" (feat. Someone) (Radio Edit)")))
             .when(k == 3, F.concat(t, F.lit(" [Night Remix] (Night Remix)"))).when(k == 4, F.concat(t, F.lit(" (Original Mix)")))
             .when(k == 5, F.concat(t, F.lit(" ("), a, F.lit(" Remix)"))).otherwise(t))
    label = F.when(F.col("label") == "Brand#1", F.concat(a, F.lit(" Records"))).when(F.col("label") == "Brand#2", "Small, Sony Music").when(F.col("label") == "Brand#3", "Reprint Back Catalogue").otherwise("Deep Label GmbH")
    tracks = V.v_tracks(spark, sf).select("tl_id", "pos", artist.alias("artist"), title.alias("title"), label.alias("label"))
    majors = spark.range(1).select(F.lit("SONY").alias("label"))
    rules = spark.createDataFrame([("label", 1000, "^Deep (.+)$", "$1 Deep")], "field string, order int, pattern string, replacement string")
    return fields.track_fields(tracks, majors, rules).select("tl_id", "pos", "text", "label")


@query()
def search_keys(spark, sf):
    return fields.search_keys(V.v_uploads(spark, sf).select("upload_id", "title"))


@query()
def title_chunks(spark, sf):
    return T.title_chunks(V.v_uploads(spark, sf).select("upload_id", "title", "created_at"))


@query(_views(DATES + """
SELECT upload_id, best.iso || ' - ' || channel || ' - ' || entity ||
  CASE upload_id % 5 WHEN 2 THEN ' (HPX.' || CAST(upload_id % 500 AS VARCHAR) || ')' WHEN 3 THEN '' ELSE ' ' || CAST(upload_id % 500 AS VARCHAR) END AS suggested,
  channel AS artist, entity FROM v_uploads JOIN best USING (upload_id) WHERE r = 1""", "v_uploads"))
def suggest_titles(spark, sf):
    uploads = V.v_uploads(spark, sf)
    lookup = E.best_lookup(V.v_entities(spark, sf), V.v_aliases(spark, sf))
    out = T.suggest_titles(uploads.select("upload_id", "title", "created_at"), lookup)
    return out.select("upload_id", "suggested", "artist", "entity")


# The crawled pages hold no block of more than eight rows, so the rows are those of the rendered mixes.  Tables come in
# both orders; every third title has a version, by which a block tells its columns.
@query(V.with_views("v_tracks", then="""
n AS (SELECT tl_id, count(*) AS n FROM v_tracks GROUP BY 1)
SELECT -tl_id - 1 AS page_id, CAST(1 AS INT) AS block, CAST(pos AS INT) AS pos, CAST(NULL AS VARCHAR) AS cue, artist, title, CAST(NULL AS VARCHAR) AS label,
  artist || ' - ' || title AS text FROM (SELECT tl_id, pos, artist, title || CASE WHEN pos % 3 = 0 AND tl_id % 2 = 1 THEN ' (Night Remix)' ELSE '' END AS title FROM v_tracks) JOIN n USING (tl_id) WHERE n > 8"""))
def scan_html_rows(spark, sf):
    """Every page as crawled, plus each mix rendered as a list, as a table or as a table with its columns swapped."""
    t = V.v_tracks(spark, sf)
    cell = F.concat(F.lit('<span class="artist">'), "artist", F.lit('</span><span class="title">'), "title", F.lit("</span>"))
    li = F.concat(F.lit("<li>"), cell, F.lit("</li>"))
    title = F.concat("title", F.when(F.col("pos") % 3 == 0, " (Night Remix)").otherwise(""))
    swapped = F.col("tl_id") % 4 == 1
    tr = F.concat(F.lit("<tr><td>"), F.when(swapped, title).otherwise(F.col("artist")), F.lit("</td><td>"), F.when(swapped, F.col("artist")).otherwise(title), F.lit("</td></tr>"))
    rows = F.when(F.col("tl_id") % 2 == 0, li).otherwise(tr)
    made = t.withColumn("_r", rows).groupBy("tl_id").agg(F.expr("listagg(_r, '') WITHIN GROUP (ORDER BY pos)").alias("_b"))
    html = F.when(F.col("tl_id") % 2 == 0, F.concat(F.lit("<ul>"), "_b", F.lit("</ul>"))).otherwise(F.concat(F.lit("<table>"), "_b", F.lit("</table>")))
    made = made.select((-F.col("tl_id") - 1).alias("page_id"), F.lit("https://made.example/").alias("url"), html.alias("html"))
    crawled = V.read_table(spark, sf, "pages").select("page_id", "url", "html")
    spec = spark.createDataFrame([("*", "list", "artist", "artist", None), ("*", "list", "title", "title", None),
                                  ("*", "table", "left", None, 0), ("*", "table", "right", None, 1)],
                                 "host string, kind string, role string, class_pattern string, cell int")
    return html_rows.scan_html_rows(made.unionByName(crawled), spec)
