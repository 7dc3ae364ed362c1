"""Registered queries over cues, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cue_jobs as C
from ..operators import ordered as O
from . import fixtures as V
from .registry import Registry

query = Registry()


def _views(then, *names):
    return V.with_views(*(names or ("v_tracks",)), then=then)


def ranges(src, key="tl_id", cue="cue"):
    """CTEs giving kind, low, high, width of every cue of ``src``."""
    lo = "replace({}, '?', '0')"
    hi = "replace({}, '?', '9')"
    p = lambda i: f"string_split({cue}, ':')[{i}]"
    num = lambda t, e: f"TRY_CAST({t.format(e)} AS INT)"
    b = lambda t, e, top: f"least({num(t, e)}, {top})"
    kind = (f"CASE WHEN regexp_full_match({cue}, '[0-9?]{{2,3}}') THEN 'MM' "
            f"WHEN regexp_full_match({cue}, '[0-9?]{{1,2}}:[0-9?]{{2}}:[0-9?]{{2}}') THEN 'HMS' "
            f"WHEN regexp_full_match({cue}, '[0-9?]{{2}}:[0-9?]{{2}}') THEN 'MMSS' "
            f"WHEN regexp_full_match({cue}, '[0-9?]:[0-9?]{{2}}') THEN 'HMM' ELSE 'INVALID' END")

    def bound(t):
        return (f"CASE kind WHEN 'MM' THEN {b(t, cue, 999)} "
                f"WHEN 'MMSS' THEN ({b(t, p(1), 99)} * 60 + {b(t, p(2), 59)} + 30) // 60 "
                f"WHEN 'INVALID' THEN NULL ELSE {b(t, p(1), 99)} * 60 + {b(t, p(2), 59)} END")
    return f"""
k1 AS (SELECT *, {kind} AS kind FROM {src}),
k2 AS (SELECT *, CAST({bound(lo)} AS INT) AS low, CAST({bound(hi)} AS INT) AS high, CASE WHEN kind = 'MM' THEN length({cue}) END AS width FROM k1)
"""


def digit(lo, hi, place):
    return f"(CASE WHEN {lo} // {place} = {hi} // {place} THEN CAST(({lo} // {place}) % 10 AS VARCHAR) ELSE '?' END)"


def hmm(lo, hi):
    a = f"(CASE WHEN {lo} // 60 = {hi} // 60 THEN {lo} % 60 ELSE 0 END)"
    b = f"(CASE WHEN {lo} // 60 = {hi} // 60 THEN {hi} % 60 ELSE 59 END)"
    return (f"(CASE WHEN {lo} // 60 = {hi} // 60 THEN CAST({lo} // 60 AS VARCHAR) ELSE '?' END || ':' || "
            f"{digit(a, b, 10)} || {digit(a, b, 1)})")


def mmm(lo, hi):
    return f"({digit(lo, hi, 100)} || {digit(lo, hi, 10)} || {digit(lo, hi, 1)})"


TOGGLED = f"CASE kind WHEN 'INVALID' THEN cue WHEN 'MM' THEN {hmm('low', 'high')} ELSE {mmm('low', 'high')} END"


@query(_views(ranges("v_tracks") + """SELECT tl_id, pos, cue, kind, coalesce(low, -1) AS min_minutes,
  coalesce(high, -1) AS max_minutes, CAST(coalesce(width, -1) AS INT) AS width FROM k2 WHERE cue IS NOT NULL"""))
def cue_ranges(spark, sf):
    out = C.cue_ranges(V.v_tracks(spark, sf).where("cue IS NOT NULL"))
    n = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return out.select("tl_id", "pos", "cue", "kind", n("min_minutes"), n("max_minutes"), n("width"))


@query(_views(ranges("v_tracks") + f"""SELECT tl_id, pos, cue, {TOGGLED} AS alt_cue,
  '[' || cue || '|' || {TOGGLED} || ']' AS dual FROM k2 WHERE cue IS NOT NULL"""))
def toggle_cues(spark, sf):
    out = C.toggle_cues(V.v_tracks(spark, sf).where("cue IS NOT NULL"))
    return out.select("tl_id", "pos", "cue", "alt_cue", "dual")


ZERO = "CASE WHEN regexp_full_match({0}cue, '0[0-9]{{2}}') THEN 0 WHEN {0}low // 60 = {0}high // 60 THEN {0}low // 60 END"


@query(_views(ranges("v_tracks") + f""",
h1 AS (SELECT *, CASE WHEN low // 60 = high // 60 THEN low // 60 END AS sh FROM k2),
h2 AS (SELECT *, lag(cue) OVER o AS pcue, lead(cue) OVER o AS ncue, lag(low) OVER o AS plow, lag(high) OVER o AS phigh,
   lead(low) OVER o AS nlow, lead(high) OVER o AS nhigh, lead(cue, 2) OVER o AS ocue, lead(low, 2) OVER o AS olow, lead(high, 2) OVER o AS ohigh,
   last_value(sh IGNORE NULLS) OVER (PARTITION BY tl_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo,
   first_value(sh IGNORE NULLS) OVER (PARTITION BY tl_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi
   FROM h1 WINDOW o AS (PARTITION BY tl_id ORDER BY pos)),
h3 AS (SELECT *, CASE WHEN lo = hi THEN lo ELSE coalesce(hi, lo) END AS st,
   phigh + 1 AS blo, nlow - 1 AS bhi FROM h2),
h4 AS (SELECT *, coalesce(st, {ZERO.format('n')}, {ZERO.format('p')}, {ZERO.format('o')}) AS hint,
   CASE WHEN blo > bhi THEN least(plow, nlow) ELSE blo END AS xlo, CASE WHEN blo > bhi THEN greatest(phigh, nhigh) ELSE bhi END AS xhi FROM h3)
SELECT tl_id, pos, cue, CASE WHEN cue IS NULL THEN NULL
  WHEN cue IN ('??', '???') THEN CASE WHEN st IS NOT NULL THEN CAST(st AS VARCHAR) || ':??'
     WHEN plow IS NOT NULL AND nlow IS NOT NULL THEN {hmm('xlo', 'xhi')} ELSE {TOGGLED} END
  WHEN regexp_full_match(cue, '[0-9][?][?]') AND hint = CAST(cue[1] AS INT) THEN cue[1] || ':??'
  WHEN regexp_full_match(cue, '0[?][?]') AND hint IS NOT NULL THEN CAST(hint AS VARCHAR) || ':??'
  WHEN kind = 'HMS' AND length(cue) = 8 THEN cue ELSE {TOGGLED} END AS alt_cue FROM h4""".replace("CAST(cue[1] AS INT)", "TRY_CAST(cue[1] AS INT)")))
def infer_hours(spark, sf):
    tracks = O.deal(V.v_tracks(spark, sf).select("tl_id", "pos", "cue"), "tl_id", V.all_lines(spark, sf))
    out = C.infer_hours(tracks, V.longest_mix(spark, sf))
    return out.select("tl_id", "pos", "cue", "alt_cue")


@query(_views("""
c1 AS (SELECT *, max(CASE WHEN type = 'track' AND contains(cue, ':') THEN 1 ELSE 0 END) OVER (PARTITION BY tl_id) AS colon,
  last_value(CASE WHEN type = 'track' AND contains(cue, ':') THEN string_split(cue, ':')[1] END IGNORE NULLS) OVER
   (PARTITION BY tl_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pre FROM v_tracks)
SELECT tl_id, pos, type, CASE WHEN type = 'track' AND colon = 1 AND (cue IS NULL OR cue = '??') THEN coalesce(pre, '0') || ':??' ELSE cue END AS cue FROM c1"""))
def fill_cue_prefix(spark, sf):
    out = C.fill_cue_prefix(V.v_tracks(spark, sf), longest=V.longest_mix(spark, sf))
    return out.select("tl_id", "pos", "type", "cue")


STYLE = """
s1 AS (SELECT pair_id, min_by(cue, pos) FILTER (WHERE regexp_full_match(cue, '[0-9]+(:[0-9]+)?')) AS c,
   min_by(cue, pos) FILTER (WHERE type = 'track' AND contains(cue, ':')) AS p FROM v_orig GROUP BY pair_id),
style AS (SELECT pair_id, contains(c, ':') AS colon, length(string_split(c, ':')[1]) AS w1, length(string_split(c, ':')[2]) AS w2,
   coalesce(string_split(p, ':')[1], '0') AS pre FROM s1)
"""


def pad(expr, width):
    return f"(repeat('0', greatest(CAST({width} AS INT) - length(CAST({expr} AS VARCHAR)), 0)) || CAST({expr} AS VARCHAR))"


CONVERTED = f"""CASE WHEN cue IS NULL OR colon IS NULL OR NOT regexp_full_match(cue, '[0-9]+(:[0-9]+)?') THEN cue
  WHEN colon AND NOT contains(cue, ':') THEN {pad('pre', 'w1')} || ':' || {pad('CAST(cue AS INT)', 'w2')}
  WHEN colon THEN {pad("(mi * 60 + se) // 60", 'w1')} || ':' || {pad('(mi * 60 + se) % 60', 'w2')}
  WHEN contains(cue, ':') THEN {pad('mi * 60 + se', 'w1')} ELSE {pad('CAST(cue AS INT)', 'w1')} END"""
CONVERT = STYLE + f""",
cv AS (SELECT c.*, colon, w1, w2, pre, TRY_CAST(string_split(cue, ':')[1] AS INT) AS mi, TRY_CAST(string_split(cue, ':')[2] AS INT) AS se
   FROM v_cand c LEFT JOIN style USING (pair_id)),
cw AS (SELECT *, CASE WHEN type = 'track' THEN {CONVERTED} ELSE cue END AS cue2 FROM cv)
"""


@query(_views(CONVERT + "SELECT pair_id, pos, type, cue2 AS cue FROM cw", "v_pairs"))
def convert_cues(spark, sf):
    orig, cand = V.v_pairs(spark, sf)
    return C.convert_cues(cand, C.cue_style(orig)).select("pair_id", "pos", "type", "cue")


@query(_views(CONVERT + """SELECT pair_id, pos, type, CASE WHEN type = 'track' AND trim(coalesce(cue2, '')) = '' THEN
   CASE WHEN colon THEN repeat('?', w1) || ':' || repeat('?', w2) ELSE repeat('?', coalesce(w1, 2)) END ELSE cue2 END AS cue FROM cw""", "v_pairs"))
def align_cue_format(spark, sf):
    orig, cand = V.v_pairs(spark, sf)
    return C.align_cue_format(cand, orig).select("pair_id", "pos", "type", "cue")
