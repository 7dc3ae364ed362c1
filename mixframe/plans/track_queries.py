"""Registered queries over the rows of one mix, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tracks as T
from ..sources import tracklists as S
from . import fixtures as V
from .registry import Registry

query = Registry()


def _views(then):
    return V.with_views("v_tracks", then=then)


CUE_INT = "TRY_CAST(nullif(regexp_extract(cue, '^([0-9]+)', 1), '') AS INT)"


def pad2(expr: str) -> str:
    return f"(CASE WHEN {expr} < 10 THEN '0' ELSE '' END || CAST({expr} AS VARCHAR))"


def hms(expr: str) -> str:
    return (f"(CAST(({expr}) // 3600 AS VARCHAR) || ':' || right('0' || CAST((({expr}) % 3600) // 60 "
            f"AS VARCHAR), 2) || ':' || right('0' || CAST(({expr}) % 60 AS VARCHAR), 2))")


W1_SQL = """
w1a AS (SELECT *, coalesce(sum(dur_s) OVER (PARTITION BY tl_id ORDER BY pos ROWS BETWEEN
          UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st,
          count(*) FILTER (WHERE dur_s IS NULL) OVER (PARTITION BY tl_id) AS miss FROM v_tracks),
w1b AS (SELECT *, max(st) OVER (PARTITION BY tl_id) AS last_st FROM w1a),
w1 AS (SELECT tl_id, pos, type, text, label, CAST(st AS INT) AS cue_sum,
         CASE WHEN miss = 0 THEN lpad(CAST((st + 30) // 60 AS VARCHAR),
              CASE WHEN (last_st + 30) // 60 > 99 THEN 3 ELSE 2 END, '0') END AS cue FROM w1b)
"""


@query(_views(W1_SQL + "SELECT tl_id, pos, text, cue_sum, cue FROM w1"))
def cues_from_durations(spark, sf):
    out = T.cues_from_durations(V.v_tracks(spark, sf), V.longest_mix(spark, sf))
    return out.select("tl_id", "pos", "text", "cue_sum", "cue")


@query(_views(W1_SQL + """
SELECT tl_id, CAST(0 AS INT) AS part, string_agg(CASE WHEN type = 'gap' THEN '...' ELSE
   CASE WHEN cue IS NULL THEN '' ELSE '[' || cue || '] ' END || text || ' [' || label || ']' END,
   chr(10) ORDER BY pos) AS text
FROM w1 GROUP BY tl_id"""))
def write_tracklists(spark, sf):
    return S.write_tracklists(T.cues_from_durations(V.v_tracks(spark, sf), V.longest_mix(spark, sf)))


@query(_views("""
lines AS (SELECT tl_id, pos, CASE WHEN type = 'gap' THEN '...' ELSE
   (CASE WHEN pos % 2 = 0 THEN '# ' ELSE '' END) ||
   CASE WHEN cue IS NULL THEN '' ELSE '[' || cue || '] ' END || '''''' || text || ' [' || label || ']' END AS line
   FROM v_tracks)
SELECT l.tl_id, l.pos, t.type, CASE WHEN t.type = 'track' THEN t.cue END AS cue,
   CASE WHEN t.type = 'track' THEN t.text END AS text,
   CASE WHEN t.type = 'track' THEN t.label END AS label
FROM lines l JOIN v_tracks t ON l.tl_id = t.tl_id AND l.pos = t.pos"""))
def scan_tracklists(spark, sf):
    """Compose each mix's text, parse it back: the twin is the view itself."""
    t = V.v_tracks(spark, sf)
    line = F.when(F.col("type") == "gap", "...").otherwise(F.concat(
        F.when(F.col("pos") % 2 == 0, "# ").otherwise(""),
        F.when(F.col("cue").isNull(), "").otherwise(F.concat(F.lit("["), "cue", F.lit("] "))),
        F.lit("''"), "text", F.lit(" ["), "label", F.lit("]")))
    texts = t.withColumn("line", line).groupBy("tl_id").agg(
        F.expr("listagg(line, '\n\n') WITHIN GROUP (ORDER BY pos)").alias("text"))
    return S.scan_tracklists(texts, V.longest_mix(spark, sf))


def release_rows(spark, sf):
    """V1 as release rows: longer tracks, some lengths unknown."""
    return V.v_tracks(spark, sf).select(
        F.col("tl_id").alias("release_id"), "pos", "is_heading",
        F.when(F.col("is_heading") | (F.col("label") == "Brand#3"), F.lit(None))
        .otherwise(F.col("dur_s") * 10).alias("dur_s"), F.col("text").alias("title"))


RELEASE = """
rel AS (SELECT tl_id AS release_id, pos, is_heading, text AS title,
  CASE WHEN is_heading OR label = 'Brand#3' THEN NULL ELSE dur_s * 10 END AS dur_s FROM v_tracks),
r1 AS (SELECT *,
  coalesce(sum(CASE WHEN NOT is_heading AND dur_s IS NULL THEN 1 ELSE 0 END) OVER b, 0) AS unk,
  coalesce(sum(CASE WHEN NOT is_heading THEN dur_s END) OVER b, 0) AS cum,
  sum(CASE WHEN NOT is_heading AND dur_s IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY release_id) AS known,
  sum(CASE WHEN NOT is_heading AND dur_s IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY release_id) AS missing,
  sum(CASE WHEN is_heading THEN 1 ELSE 0 END) OVER (PARTITION BY release_id ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chapter
  FROM rel WINDOW b AS (PARTITION BY release_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""


@query(_views(RELEASE + """,
r2 AS (SELECT *, (cum - coalesce(max(CASE WHEN is_heading THEN cum END) OVER (PARTITION BY release_id
   ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)) // 60 AS m FROM r1),
r3 AS (SELECT *, max(CASE WHEN NOT is_heading AND dur_s IS NOT NULL AND unk = 0 THEN m END)
   OVER (PARTITION BY release_id) AS top FROM r2)
SELECT release_id, pos, title, CASE WHEN is_heading OR known = 0 THEN NULL WHEN unk > 0 THEN '??'
   ELSE repeat('0', greatest(CASE WHEN top >= 100 THEN 3 ELSE 2 END - length(CAST(CAST(m AS BIGINT) AS VARCHAR)), 0))
        || CAST(CAST(m AS BIGINT) AS VARCHAR) END AS cue FROM r3"""))
def release_cues(spark, sf):
    out = T.release_cues(release_rows(spark, sf), V.longest_mix(spark, sf))
    return out.select("release_id", "pos", "title", "cue")


@query(_views(RELEASE + """
SELECT release_id, CAST(coalesce(chapter, -1) AS INT) AS chapter, CAST(sum(dur_s) AS INT) AS total_s,
  count(*) AS n_tracks, """ + hms("CAST(sum(dur_s) AS INT)") + """ AS total
FROM r1 WHERE NOT is_heading AND missing = 0
GROUP BY GROUPING SETS ((release_id, chapter), (release_id))"""))
def release_totals(spark, sf):
    return T.release_totals(release_rows(spark, sf), V.longest_mix(spark, sf))


@query(_views("""
tot AS (SELECT tl_id, CAST(max(end_s) + (tl_id % 5) * 100 AS INT) AS total_s FROM v_tracks GROUP BY tl_id),
sg AS (SELECT v.*, total_s, v.start_s + CASE WHEN v.tl_id % 3 = 0 THEN 130 ELSE 0 END AS s,
   v.end_s + CASE WHEN v.tl_id % 3 = 0 THEN 130 ELSE 0 END AS e FROM v_tracks v JOIN tot USING (tl_id)),
sn AS (SELECT *, lead(s) OVER (PARTITION BY tl_id ORDER BY pos) AS nx FROM sg),
em AS (
  SELECT tl_id, pos, 0 AS o, 'track' AS type, '0:00:00' AS cue, '?' AS text, NULL AS label FROM sn WHERE pos = 1 AND s > 120
  UNION ALL SELECT tl_id, pos, 1, 'gap', NULL, NULL, NULL FROM sn WHERE pos = 1 AND s > 120
  UNION ALL SELECT tl_id, pos, 2, 'track', """ + hms("s") + """, text, label FROM sn
  UNION ALL SELECT tl_id, pos, 3, 'gap', NULL, NULL, NULL FROM sn WHERE nx IS NOT NULL AND e < s
  UNION ALL SELECT tl_id, pos, 4, 'track', """ + hms("e") + """, '?', NULL FROM sn WHERE nx IS NOT NULL AND e >= s AND nx - e > 30
  UNION ALL SELECT tl_id, pos, 5, 'gap', NULL, NULL, NULL FROM sn WHERE nx IS NOT NULL AND e >= s AND nx - e > 180
  UNION ALL SELECT tl_id, pos, 6, 'track', """ + hms("greatest(e, 0)") + """, '?', NULL FROM sn WHERE nx IS NULL AND total_s - e > 70
  UNION ALL SELECT tl_id, pos, 7, 'gap', NULL, NULL, NULL FROM sn WHERE nx IS NULL AND total_s - e > 240)
SELECT tl_id, CAST(row_number() OVER (PARTITION BY tl_id ORDER BY pos, o) AS INT) AS pos, type, cue, text, label
FROM em"""))
def insert_gaps_from_segments(spark, sf):
    tracks = V.v_tracks(spark, sf)
    total = tracks.groupBy("tl_id").agg(
        (F.max("end_s") + (F.first("tl_id") % 5) * 100).cast("int").alias("total_s"))
    late = F.when(F.col("tl_id") % 3 == 0, 130).otherwise(0)
    segments = (tracks.withColumn("start_s", F.col("start_s") + late)
                .withColumn("end_s", F.col("end_s") + late))
    return T.insert_gaps_from_segments(segments, total, V.longest_mix(spark, sf))


@query(_views("""
sg AS (SELECT *, start_s + CASE WHEN tl_id % 3 = 0 THEN 50 WHEN tl_id % 3 = 1 THEN 100 ELSE 0 END AS s FROM v_tracks),
sn AS (SELECT *, lead(s) OVER (PARTITION BY tl_id ORDER BY pos) AS nx, max(s) OVER (PARTITION BY tl_id) AS ls,
   (s + 30) // 60 AS m FROM sg),
sp AS (SELECT *, CASE WHEN (ls + 30) // 60 > 99 THEN 3 ELSE 2 END AS w FROM sn),
em AS (
  SELECT tl_id, pos, 0 AS o, 'track' AS type, lpad('0', w, '0') AS cue, '?' AS text, NULL AS label FROM sp WHERE pos = 1 AND m > 1
  UNION ALL SELECT tl_id, pos, 1, 'track', lpad(CAST(CASE WHEN pos = 1 AND m = 1 THEN 0 ELSE m END AS VARCHAR), w, '0'), text, label FROM sp
  UNION ALL SELECT tl_id, pos, 2, 'gap', NULL, NULL, NULL FROM sp WHERE nx - s >= 480)
SELECT tl_id, CAST(row_number() OVER (PARTITION BY tl_id ORDER BY pos, o) AS INT) AS pos, type, cue, text, label FROM em"""))
def insert_gaps_from_starts(spark, sf):
    k = F.col("tl_id") % 3
    tracks = V.v_tracks(spark, sf).withColumn(
        "start_s", F.col("start_s") + F.when(k == 0, 50).when(k == 1, 100).otherwise(0))
    return T.insert_gaps_from_starts(tracks, V.longest_mix(spark, sf))


DIFFS = f"""
ci AS (SELECT *, {CUE_INT} AS c FROM v_tracks),
df AS (SELECT *, CASE WHEN type = 'track' THEN c - lag(CASE WHEN type = 'track' THEN c END)
   OVER (PARTITION BY tl_id ORDER BY pos) END AS diff_prev FROM ci)
"""
FALSE = DIFFS + """,
nx AS (SELECT *, lead(diff_prev) OVER (PARTITION BY tl_id ORDER BY pos) AS d2 FROM df),
fm AS (SELECT *, CASE WHEN type = 'track' AND text = '?' AND (coalesce(diff_prev < 3, false) OR coalesce(d2 < 3, false))
   THEN 'track (false)' ELSE type END AS t2 FROM nx)
"""


@query(_views(DIFFS + "SELECT tl_id, pos, cue, diff_prev FROM df WHERE diff_prev IS NOT NULL"))
def cue_diffs(spark, sf):
    out = T.cue_diffs(V.v_tracks(spark, sf), V.longest_mix(spark, sf))
    return out.where("diff_prev IS NOT NULL").select("tl_id", "pos", "cue", "diff_prev")


@query(_views(FALSE + """,
vd AS (SELECT tl_id, pos, c - lag(c) OVER (PARTITION BY tl_id ORDER BY pos) AS dv FROM fm WHERE t2 = 'track')
SELECT fm.tl_id, fm.pos, t2 AS type, text, CAST(coalesce(dv, -9999) AS INT) AS diff_valid
FROM fm LEFT JOIN vd ON fm.tl_id = vd.tl_id AND fm.pos = vd.pos"""))
def mark_false_unknowns(spark, sf):
    out = T.mark_false_unknowns(V.v_tracks(spark, sf), longest=V.longest_mix(spark, sf))
    return out.select("tl_id", "pos", "type", "text",
                      F.coalesce("diff_valid", F.lit(-9999)).alias("diff_valid"))


@query(_views("""
kk AS (SELECT tl_id, pos, type, CASE WHEN text = '?' THEN '?' ELSE artist END AS text, NULL AS label FROM v_tracks),
k2 AS (SELECT *, CASE WHEN type = 'track' THEN text END AS k FROM kk),
k3 AS (SELECT *, lag(k) OVER (PARTITION BY tl_id ORDER BY pos) AS pk FROM k2)
SELECT tl_id, CAST(row_number() OVER (PARTITION BY tl_id ORDER BY pos) AS INT) AS pos, type, text
FROM k3 WHERE NOT coalesce(k = pk, false)"""))
def drop_adjacent_repeats(spark, sf):
    tracks = V.v_tracks(spark, sf).select(
        "tl_id", "pos", "type", F.when(F.col("text") == "?", "?").otherwise(F.col("artist")).alias("text"),
        F.lit(None).cast("string").alias("label"))
    return T.drop_adjacent_repeats(tracks, V.longest_mix(spark, sf)).drop("label")


FORMAT_SQL = """
fmt AS (SELECT tl_id, pos, type, text, cue, CASE WHEN cue IS NULL THEN NULL
  WHEN cue = '??' THEN '??' WHEN cue = '???' THEN '???'
  WHEN regexp_full_match(cue, '[0-9?]{2}') THEN 'NN' WHEN regexp_full_match(cue, '[0-9?]{3}') THEN 'NNN'
  WHEN regexp_full_match(cue, '[0-9?]:[0-9?]{2}') THEN 'N:NN'
  WHEN regexp_full_match(cue, '[0-9?]{2}:[0-9?]{2}') THEN 'NN:NN'
  WHEN regexp_full_match(cue, '[0-9?]:[0-9?]{2}:[0-9?]{2}') THEN 'N:NN:NN'
  WHEN regexp_full_match(cue, '[0-9?]{2}:[0-9?]{2}:[0-9?]{2}') THEN 'NN:NN:NN' ELSE 'INVALID' END AS f
  FROM v_tracks WHERE type = 'track')
"""


@query(_views(FORMAT_SQL + """
SELECT tl_id, coalesce(string_agg(DISTINCT f, ',' ORDER BY f), '') AS formats, CAST(count(DISTINCT f) AS INT) AS n_formats,
  count(*) FILTER (WHERE f = 'INVALID') AS n_invalid, count(*) FILTER (WHERE f IS NULL) AS n_missing,
  count(DISTINCT f) <= 1 AND count(*) FILTER (WHERE f = 'INVALID') = 0 AS ok
FROM fmt GROUP BY tl_id"""))
def cue_consistency(spark, sf):
    return T.cue_consistency(V.v_tracks(spark, sf))


@query(_views(FORMAT_SQL + """
SELECT tl_id, pos, text, cue, CASE WHEN f IS NULL THEN 'missing' ELSE 'invalid' END AS problem
FROM fmt WHERE f IS NULL OR f = 'INVALID'"""))
def cue_problems(spark, sf):
    return T.cue_problems(V.v_tracks(spark, sf))


@query(_views("""
c AS (SELECT tl_id FROM v_tracks GROUP BY tl_id HAVING count(*) >= 4)
SELECT tl_id, pos, text FROM v_tracks WHERE tl_id IN (SELECT tl_id FROM c)"""))
def filter_short_tracklists(spark, sf):
    return T.filter_short_tracklists(V.v_tracks(spark, sf)).select("tl_id", "pos", "text")


WRAPPED = """CASE WHEN label = 'Brand#1' THEN title || ' (Continuous DJ Mix)' WHEN label = 'Brand#2' THEN 'ID'
  ELSE title END"""


@query(_views(f"""
w AS (SELECT tl_id, pos, label, {WRAPPED} AS title, CASE WHEN label = 'Brand#4' THEN 'undefined - undefined' ELSE text END AS text FROM v_tracks)
SELECT tl_id, pos, title,
  CASE WHEN label IN ('Brand#1', 'Brand#2', 'Brand#4') THEN '?' ELSE text END AS text,
  CASE WHEN label = 'Brand#1' THEN NULL ELSE label END AS label FROM w"""))
def unwrap_continuous_mix(spark, sf):
    t = V.v_tracks(spark, sf)
    title = (F.when(F.col("label") == "Brand#1", F.concat("title", F.lit(" (Continuous DJ Mix)")))
             .when(F.col("label") == "Brand#2", "ID").otherwise(F.col("title")))
    text = F.when(F.col("label") == "Brand#4", "undefined - undefined").otherwise(F.col("text"))
    t = t.select("tl_id", "pos", "label", title.alias("title"), text.alias("text"))
    return T.unwrap_continuous_mix(t).select("tl_id", "pos", "title", "text", "label")


@query(_views("""
c AS (SELECT tl_id, count(*) AS n_lines, count(*) FILTER (WHERE type = 'gap' OR text = '?') AS n_open FROM v_tracks GROUP BY tl_id),
f AS (SELECT *, tl_id % 7 = 0 AS w, tl_id % 5 = 0 AS h, CASE WHEN tl_id % 11 = 0 THEN NULL WHEN n_open > 0 THEN 'incomplete' ELSE 'complete' END AS st FROM c)
SELECT tl_id, n_lines, CASE WHEN n_lines < 4 THEN 'none' WHEN st IS NULL OR w OR h OR st = 'incomplete' THEN 'incomplete' ELSE 'complete' END AS tl_status,
 CASE WHEN st IS NULL THEN '' WHEN w THEN 'warning' WHEN h OR st = 'incomplete' THEN 'hint' ELSE 'complete' END AS severity FROM f"""))
def tracklist_status(spark, sf):
    t = V.v_tracks(spark, sf)
    open_ = F.count_if((F.col("type") == "gap") | (F.col("text") == "?"))
    feedback = (t.groupBy("tl_id").agg(open_.alias("n")).where(F.col("tl_id") % 11 != 0)
                .select("tl_id", F.when(F.col("tl_id") % 7 == 0, 1).otherwise(0).alias("warnings"),
                        F.when(F.col("tl_id") % 5 == 0, 1).otherwise(0).alias("hints"),
                        F.when(F.col("n") > 0, "incomplete").otherwise("complete").alias("status")))
    return T.tracklist_status(t, feedback)


@query(_views("""
h AS (SELECT tl_id, pos, is_heading, text,
  max(CASE WHEN is_heading THEN pos END) OVER b AS hp, max(CASE WHEN NOT is_heading THEN pos END) OVER b AS tp
  FROM v_tracks WINDOW b AS (PARTITION BY tl_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT h.tl_id, CAST(row_number() OVER (PARTITION BY h.tl_id ORDER BY h.pos) AS INT) AS pos,
  CASE WHEN hp > coalesce(tp, 0) THEN '''''''' || v.text || ':'''''' ' ELSE '' END || h.text AS text
FROM h LEFT JOIN v_tracks v ON h.tl_id = v.tl_id AND h.hp = v.pos WHERE NOT h.is_heading""".replace(
    "'''''''' || v.text || ':'''''' '", "repeat(chr(39), 3) || v.text || ':' || repeat(chr(39), 3) || ' '")))
def carry_headings(spark, sf):
    t = V.v_tracks(spark, sf).select("tl_id", "pos", "is_heading", "text")
    return T.carry_headings(t, V.longest_mix(spark, sf)).drop("is_heading")
