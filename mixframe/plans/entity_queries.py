"""Registered queries over names and entities, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities as E
from . import fixtures as V
from .registry import Registry

query = Registry()


def key(expr):
    return f"regexp_replace(lower(strip_accents({expr})), '[^a-z0-9]', '', 'g')"


def _views(then, *names):
    return V.with_views(*(names or ("v_entities",)), then=then)


BASE = "regexp_replace(title, '\\s*\\([^()]*\\)\\s*$', '')"
QUALIFIED = "regexp_matches(title, '\\([^()]*\\)\\s*$')"
LOOKUP = f"""
ty AS (SELECT * FROM v_entities WHERE type IS NOT NULL),
lt AS (SELECT {key('title')} AS key, title, type, mixes, title AS matched_title, 'exact' AS match_type FROM ty
  UNION ALL SELECT {key(BASE)}, title, type, mixes, title, 'qualified' FROM ty WHERE {QUALIFIED}
  UNION ALL SELECT {key('alias')}, title, type, mixes, alias, 'redirect' FROM v_aliases JOIN ty ON target = title),
mt AS (SELECT n.mix_id, n.pos, n.name, lt.title, lt.type, lt.mixes, lt.matched_title, lt.match_type, n.name = lt.title AS exact_case
  FROM v_names n JOIN lt ON {key('n.name')} = lt.key)
"""


def _inputs(spark, sf):
    names = V.v_names(spark, sf).select("mix_id", "pos", "name")
    return names, V.v_entities(spark, sf), V.v_aliases(spark, sf)


@query(_views(f"SELECT mix_id, pos, name, {key('name')} AS key FROM v_names"))
def name_keys(spark, sf):
    return E.name_keys(_inputs(spark, sf)[0])


@query(_views(LOOKUP + "SELECT * FROM mt"))
def lookup_entities(spark, sf):
    return E.lookup_entities(*_inputs(spark, sf))


@query(_views(f"""
hop AS (SELECT {key('alias')} AS key, {key('target')} AS base, alias FROM v_aliases WHERE target NOT IN (SELECT title FROM v_entities WHERE type IS NOT NULL)),
q AS (SELECT {key(BASE)} AS base, title, type, mixes FROM v_entities WHERE type IS NOT NULL AND {QUALIFIED})
SELECT n.mix_id, n.pos, n.name, title, type, mixes, alias AS matched_title, 'qualified' AS match_type
FROM v_names n JOIN hop ON {key('n.name')} = hop.key JOIN q ON hop.base = q.base"""))
def lookup_via_disambiguation(spark, sf):
    return E.lookup_via_disambiguation(*_inputs(spark, sf))


@query(_views(f"""
ty AS (SELECT * FROM v_entities WHERE type IS NOT NULL),
sp AS (SELECT title AS matched_title, title, type, mixes, 0 AS r FROM ty UNION ALL
  SELECT alias, title, type, mixes, 1 FROM v_aliases JOIN ty ON target = title),
wd AS (SELECT *, string_split(matched_title, ' ') AS w FROM sp),
px AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM wd),
pk AS (SELECT *, {key("array_to_string(w[1:i], ' ')")} AS key, CASE WHEN i < len(w) THEN 2 ELSE r END AS o FROM px),
on1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, title ORDER BY o, matched_title) AS rr FROM pk WHERE key <> '') WHERE rr = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o, mixes DESC, title) AS rank FROM on1)
SELECT n.mix_id, n.pos, n.name, title, type, mixes, matched_title, CASE o WHEN 0 THEN 'exact' WHEN 1 THEN 'redirect' ELSE 'prefix' END AS match_type, CAST(rank AS INT) AS rank
FROM v_names n JOIN rk ON {key('n.name')} = rk.key WHERE rank <= 10"""))
def entity_family(spark, sf):
    return E.entity_family(*_inputs(spark, sf))


@query(_views("""
SELECT mix_id, pos, name FROM v_names WHERE name IS NOT NULL AND pos % 8 <> 6 AND name NOT LIKE '% Loft'
  AND NOT (pos % 8 = 1) AND NOT (pos % 8 = 3 AND pos % 2 = 1)""".replace("AND name NOT LIKE '% Loft'", "AND pos % 8 <> 7")
  .replace("AND NOT (pos % 8 = 3 AND pos % 2 = 1)", "").replace("SELECT mix_id, pos, name FROM", "SELECT mix_id, pos, replace(name, '#', ' ') AS name FROM")))
def filter_lookup_names(spark, sf):
    """Nation names are places behind the '@', the lofts are replaced names, parts only count."""
    names = V.v_names(spark, sf)
    stop = names.select(F.concat("n_name", F.lit(" Loft")).alias("name")).distinct()
    places = names.select(F.col("n_name").alias("name")).distinct()
    asked = names.select("mix_id", "pos", "name", (F.col("name") == F.lower("n_name")).alias("behind_at"))
    return E.filter_lookup_names(asked.where("name IS NOT NULL"), stop, places).drop("behind_at")


@query(_views("""
f AS (SELECT mix_id, lower(trim(name)) AS k, min(pos) AS seen, min_by(name, pos) AS name FROM v_names WHERE name IS NOT NULL GROUP BY 1, 2)
SELECT mix_id, CAST(row_number() OVER (PARTITION BY mix_id ORDER BY seen, k) AS INT) AS pos, name FROM f"""))
def distinct_ci(spark, sf):
    return E.distinct_ci(_inputs(spark, sf)[0].where("name IS NOT NULL"))


@query(_views("""
p AS (SELECT mix_id, pos, name, pos % 3 AS priority FROM v_names WHERE name IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY mix_id ORDER BY priority, pos, name) AS ask_no FROM p)
SELECT mix_id, pos, name, priority, CAST(ask_no AS INT) AS ask_no, ask_no <= 10 AS asked FROM r"""))
def cap_candidates(spark, sf):
    names = _inputs(spark, sf)[0].where("name IS NOT NULL").withColumn("priority", F.col("pos") % 3)
    return E.cap_candidates(names)


DISTINCT = LOOKUP + ", dm AS (SELECT DISTINCT name, title, type, mixes, matched_title, match_type FROM mt)"


def _matches(spark, sf):
    return E.lookup_entities(*_inputs(spark, sf)).select("name", "title", "type", "mixes", "matched_title", "match_type").distinct()


RANK = ("CASE WHEN type = 'podcast' THEN 0 ELSE 1 END, CASE match_type WHEN 'exact' THEN 0 WHEN 'redirect' THEN 1 "
        "WHEN 'qualified' THEN 2 ELSE 3 END, mixes DESC, title, matched_title")


@query(_views(DISTINCT + f"SELECT *, CAST(row_number() OVER (PARTITION BY name ORDER BY {RANK}) AS INT) AS rank FROM dm"))
def rank_matches(spark, sf):
    return E.rank_matches(_matches(spark, sf), ["podcast"])


@query(_views(DISTINCT + f""",
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY {RANK}) AS r FROM dm) WHERE r = 1)
SELECT n.mix_id, n.pos, n.name, CASE WHEN {key('title')} = {key('n.name')} THEN title
  WHEN {key('matched_title')} = {key('n.name')} THEN CASE WHEN length({key('title')}) = length({key('n.name')}) AND levenshtein({key('title')}, {key('n.name')}) = 1
    THEN title ELSE matched_title END ELSE n.name END AS canonical
FROM v_names n LEFT JOIN b ON n.name = b.name"""))
def canonical_names(spark, sf):
    return E.canonical_names(_inputs(spark, sf)[0], _matches(spark, sf), ["podcast"])


@query(_views(DISTINCT + f""",
s AS (SELECT name, count(*) AS n FROM dm GROUP BY name),
d AS (SELECT dm.*, CASE WHEN match_type = 'prefix' THEN 30 WHEN {key('dm.name')} = {key('title')} THEN 0 WHEN {key('dm.name')} = {key('matched_title')} THEN 10
   WHEN {key('dm.name')} = {key(BASE)} THEN 5 ELSE 25 END + CASE WHEN mixes = 0 THEN 10 ELSE 0 END + CASE WHEN mixes < 3 AND NOT contains(trim(dm.name), ' ') THEN 20 ELSE 0 END
   + CASE WHEN n > 1 THEN 10 ELSE 0 END + CASE WHEN type = 'venue' AND mixes > 30 THEN 30 ELSE 0 END AS x FROM dm JOIN s ON dm.name = s.name),
c AS (SELECT *, CAST(greatest(10, least(95, 100 - x)) AS INT) AS confidence FROM d)
SELECT name, title, match_type, confidence, CASE WHEN confidence >= 80 THEN 'high' WHEN confidence >= 50 THEN 'medium' ELSE 'low' END AS band FROM c"""))
def match_confidence(spark, sf):
    m = _matches(spark, sf).withColumn("overruled", (F.col("type") == "venue") & (F.col("mixes") > 30))
    return E.match_confidence(m).select("name", "title", "match_type", "confidence", "band")


@query(_views("""
t AS (SELECT o_orderkey AS doc_id, '[' || p_brand || '] ' || c_name || ' - Mix (' || CASE o_orderkey % 4 WHEN 0 THEN p_brand || ' & Other Records'
   WHEN 1 THEN c_name || ', Nowhere' WHEN 2 THEN c_name ELSE p_type END || ')' AS title, p_brand, c_name, p_type, o_orderkey % 4 AS k
   FROM orders JOIN customer ON o_custkey = c_custkey JOIN part ON o_custkey = p_partkey)
SELECT doc_id, CASE WHEN k IN (0, 2) THEN '[' || p_brand || '] ' || c_name || ' - Mix' ELSE title END AS title FROM t""", "v_entities"))
def drop_known_labels(spark, sf):
    o, c, p = (V.read_table(spark, sf, n) for n in ("orders", "customer", "part"))
    t = o.join(c, o.o_custkey == c.c_custkey).join(p, o.o_custkey == p.p_partkey)
    k = F.col("o_orderkey") % 4
    inner = (F.when(k == 0, F.concat("p_brand", F.lit(" & Other Records"))).when(k == 1, F.concat("c_name", F.lit(", Nowhere")))
             .when(k == 2, F.col("c_name")).otherwise(F.col("p_type")))
    titles = t.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("["), "p_brand", F.lit("] "), "c_name", F.lit(" - Mix ("), inner, F.lit(")")).alias("title"))
    return E.drop_known_labels(titles, p.select(F.col("p_brand").alias("name")).distinct(),
                               t.select(F.col("o_orderkey").alias("doc_id"), F.col("c_name").alias("name")))


@query(_views("""
SELECT o_orderkey AS doc_id, CAST(1 AS INT) AS line_no, 'by ' || CASE WHEN c_acctbal >= 5000 THEN c_name ELSE '@c' || CAST(o_custkey AS VARCHAR) END || ' and @nobody-else' AS raw,
  CASE WHEN c_acctbal >= 5000 THEN '@C' || CAST(o_custkey AS VARCHAR) || '=' || c_name ELSE '' END AS replaced
FROM orders JOIN customer ON o_custkey = c_custkey""".replace("ELSE '@c' ||", "ELSE '@C' ||")))
def resolve_handles(spark, sf):
    o, c = V.read_table(spark, sf, "orders"), V.read_table(spark, sf, "customer")
    lines = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("line_no"),
                     F.concat(F.lit("by @C"), "o_custkey", F.lit(" and @nobody-else")).alias("raw"))
    handles = c.where("c_acctbal >= 5000").select(F.concat(F.lit("c"), "c_custkey").alias("handle"), F.col("c_name").alias("name"))
    return E.resolve_handles(lines, handles)


# Tags and the styles they are filed under
STYLE_RENAMES = {"Nu-Disco": ["Disco", "House"], "Jazz-Funk": ["Jazz", "Funk"], "Synth-pop": ["Pop"]}
RENAMES = " UNION ALL ".join(f"SELECT '{t}' AS tag, {i} AS style_no, '{s}' AS style" for t, ss in STYLE_RENAMES.items() for i, s in enumerate(ss))
TAG = "CASE p_size % 5 WHEN 0 THEN 'Nu-Disco' WHEN 1 THEN 'House' WHEN 2 THEN 'Jazz-Funk' WHEN 3 THEN p_brand ELSE 'Synth-pop' END"


@query(_views(f"""
rn AS ({RENAMES}),
tg AS (SELECT tl_id AS mix_id, pos, {TAG} AS tag FROM v_tracks JOIN (SELECT p_name, min(p_brand) AS p_brand, min(p_size) AS p_size FROM part GROUP BY 1) x ON title = p_name),
st AS (SELECT mix_id, pos, coalesce(style_no, 0) AS n, coalesce(style, tg.tag) AS style FROM tg LEFT JOIN rn ON tg.tag = rn.tag),
f AS (SELECT mix_id, style, min(pos * 10 + n) AS seen FROM st GROUP BY 1, 2)
SELECT mix_id, CAST(row_number() OVER (PARTITION BY mix_id ORDER BY seen) AS INT) AS pos, style FROM f""", "v_tracks"))
def map_styles(spark, sf):
    part = V.read_table(spark, sf, "part").groupBy("p_name").agg(F.min("p_brand").alias("p_brand"), F.min("p_size").alias("p_size"))
    t = V.v_tracks(spark, sf).join(part, F.col("title") == F.col("p_name"))
    tags = t.select(F.col("tl_id").alias("mix_id"), "pos", F.expr(TAG).alias("tag"))
    rename = spark.createDataFrame([(t, i, s) for t, ss in STYLE_RENAMES.items() for i, s in enumerate(ss)], "tag string, style_no int, style string")
    return E.map_styles(tags, rename, V.longest_mix(spark, sf))


@query(_views("""
SELECT DISTINCT mix_id, n_name AS name, CASE WHEN mix_id % 3 = 0 THEN n_name || ' (Club)' ELSE n_name || ' (Festival)' END AS title
FROM v_names WHERE mix_id % 3 < 2"""))
def pick_qualified_place(spark, sf):
    names = V.v_names(spark, sf).select("mix_id", "n_name").distinct()
    word = F.when(F.col("mix_id") % 3 == 0, "CLUB").when(F.col("mix_id") % 3 == 1, "Festival").otherwise("Elsewhere")
    places = names.select("mix_id", F.col("n_name").alias("name"), F.array(F.lit("Night"), word).alias("words"))
    asked = names.select(F.col("n_name").alias("name")).distinct()
    matches = E.lookup_entities(asked, V.v_entities(spark, sf), V.v_aliases(spark, sf))
    return E.pick_qualified_place(places, matches)


@query(_views("""
p AS (SELECT DISTINCT mix_id, r_name, CASE mix_id % 5 WHEN 0 THEN r_name || ' Loft' WHEN 1 THEN r_name WHEN 2 THEN '1/2 ' || r_name
  WHEN 3 THEN r_name || ' For Charity' ELSE n_name || ' Loft' END AS name FROM v_names)
SELECT mix_id, name, CASE WHEN mix_id % 5 = 4 THEN name ELSE r_name END AS place FROM p"""))
def venue_base(spark, sf):
    k, r = F.col("mix_id") % 5, F.col("r_name")
    name = (F.when(k == 0, F.concat(r, F.lit(" Loft"))).when(k == 1, r).when(k == 2, F.concat(F.lit("1/2 "), r))
            .when(k == 3, F.concat(r, F.lit(" For Charity"))).otherwise(F.concat("n_name", F.lit(" Loft"))))
    places = V.v_names(spark, sf).select("mix_id", name.alias("name")).distinct()
    return E.venue_base(places, V.v_entities(spark, sf))


@query(_views(f"""
l AS (SELECT tl_id AS mix_id, pos, label FROM v_tracks)
SELECT mix_id, {key('label')} AS key, min_by(label, pos) AS label, count(*) AS n FROM l GROUP BY mix_id, {key('label')}""", "v_tracks"))
def labels_in_tracklists(spark, sf):
    t = V.v_tracks(spark, sf)
    text = F.concat("text", F.lit(" ["), "label", F.when(F.col("pos") % 2 == 0, F.lit(" - CAT 012")).otherwise(""), F.lit("]"))
    return E.labels_in_tracklists(t.select(F.col("tl_id").alias("mix_id"), "pos", text.alias("text")))


@query(_views("""
SELECT upload_id, CAST(greatest(10, least(95, 100 - CASE WHEN is_repost THEN 30 ELSE 0 END - CASE WHEN duration_s IS NULL THEN 20 ELSE 0 END
  - CASE WHEN likes_text IS NULL THEN 25 ELSE 0 END - CASE WHEN is_playlist THEN 40 ELSE 0 END)) AS INT) AS confidence FROM v_uploads""", "v_uploads"))
def title_confidence(spark, sf):
    u = V.v_uploads(spark, sf)
    reason = lambda when, points, text: F.when(when, F.struct(F.lit(points).alias("points"), F.lit(text).alias("reason")))
    reasons = F.filter(F.array(
        reason(F.col("is_repost"), 30, "repost"), reason(F.col("duration_s").isNull(), 20, "no length"),
        reason(F.col("likes_text").isNull(), 25, "no count"), reason(F.col("is_playlist"), 40, "playlist")), lambda r: r.isNotNull())
    return E.title_confidence(u.select("upload_id", reasons.alias("reasons"))).drop("reasons")
