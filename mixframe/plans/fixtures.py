"""Relational views over the test tables that stand for mixes, uploads, pages and names.

Each view exists twice: as a DataFrame (what the jobs read) and as a DuckDB common table
expression (what the SQL twins read).  ``with_views`` builds the WITH clause.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import pad_left
from ..operators import ordered as O
from ..session import read_table, spread

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


@lru_cache(maxsize=32)
def _longest_order(app_id: str, spark: SparkSession, folder: str) -> int:
    return O.largest_group(read_table(spark, folder, "lineitem").select("l_orderkey"), "l_orderkey")


def longest_mix(spark: SparkSession, folder: str) -> int:
    """Lines of the longest order: the size check of V1, asked once per folder."""
    return _longest_order(spark.sparkContext.applicationId, spark, folder)


@lru_cache(maxsize=32)
def _count_lines(app_id: str, spark: SparkSession, folder: str) -> int:
    return read_table(spark, folder, "lineitem").count()


def all_lines(spark: SparkSession, folder: str) -> int:
    """Rows of V1 at most, read off the footers once per folder."""
    return _count_lines(spark.sparkContext.applicationId, spark, folder)


def v_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """V1: one order is one mix, one line one track."""
    size = longest_mix(spark, folder)
    line = read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    line = O.deal(line.withColumnRenamed("l_orderkey", "tl_id"), "tl_id", all_lines(spark, folder))
    line = O.dense_pos(line, "tl_id", LINE_ORDER, size)
    line = line.withColumn("len_s", (F.col("l_quantity") * 10).cast("int"))
    line = O.scan(line, "tl_id", "pos", size, start_s=O.sum_before(F.col("len_s")))
    part = read_table(spark, folder, "part").select("p_partkey", "p_name", "p_brand")
    supp = read_table(spark, folder, "supplier").select("s_suppkey", "s_name")
    out = (line.join(part, F.col("l_partkey") == F.col("p_partkey"))
           .join(supp, F.col("l_suppkey") == F.col("s_suppkey")))
    q = F.col("l_quantity").cast("int")
    start = F.col("start_s").cast("int")
    minute = F.floor(start / 60).cast("int")
    k = F.col("l_suppkey") % 10
    cue = (F.when(k == 0, F.lit("??"))
           .when(k == 1, F.concat(F.floor(minute / 10).cast("string"), F.lit("?")))
           .when(k == 2, F.concat(F.floor(minute / 60).cast("string"), F.lit(":"),
                                  pad_left(minute % 60, 2)))
           .when(k == 3, F.lit(None).cast("string"))
           .otherwise(pad_left(minute, 2)))
    gap = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A")
    step = F.col("l_suppkey") % 5
    return out.select(
        "tl_id", "pos", F.when(gap, "gap").otherwise("track").alias("type"),
        F.col("s_name").alias("artist"), F.col("p_name").alias("title"),
        F.col("p_brand").alias("label"),
        F.when(F.col("l_returnflag") == "R", "?")
        .otherwise(F.concat_ws(" - ", "s_name", "p_name")).alias("text"),
        F.when((F.col("l_tax") == 0) & gap, F.lit(None)).otherwise(F.col("len_s")).alias("dur_s"),
        start.alias("start_s"),
        F.when(step == 0, start - 5).when(step == 1, start + q * 4)
        .otherwise(start + q * 8).alias("end_s"),
        cue.alias("cue"), (F.col("l_suppkey") % 6 == 0).alias("is_heading"),
        F.col("l_linenumber").alias("line_no"))


V_TRACKS = """
v_lines1 AS (
  SELECT l_orderkey AS tl_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY
         l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS INT) AS pos,
         CAST(l_quantity * 10 AS INT) AS len_s, * FROM lineitem),
v_lines2 AS (
  SELECT *, CAST(coalesce(sum(len_s) OVER (PARTITION BY tl_id ORDER BY pos
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start_s FROM v_lines1),
v_tracks AS (
  SELECT tl_id, pos,
    CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'gap' ELSE 'track' END AS type,
    s_name AS artist, p_name AS title, p_brand AS label,
    CASE WHEN l_returnflag = 'R' THEN '?' ELSE s_name || ' - ' || p_name END AS text,
    CASE WHEN l_tax = 0 AND l_linestatus = 'F' AND l_returnflag = 'A' THEN NULL
         ELSE len_s END AS dur_s,
    start_s,
    CASE l_suppkey % 5 WHEN 0 THEN start_s - 5
         WHEN 1 THEN start_s + CAST(l_quantity AS INT) * 4
         ELSE start_s + CAST(l_quantity AS INT) * 8 END AS end_s,
    CASE l_suppkey % 10 WHEN 0 THEN '??'
         WHEN 1 THEN CAST((start_s // 60) // 10 AS VARCHAR) || '?'
         WHEN 2 THEN CAST(start_s // 3600 AS VARCHAR) || ':' ||
                     right('0' || CAST((start_s // 60) % 60 AS VARCHAR), 2)
         WHEN 3 THEN NULL
         ELSE CASE WHEN start_s // 60 < 10 THEN '0' ELSE '' END ||
              CAST(start_s // 60 AS VARCHAR) END AS cue,
    l_suppkey % 6 = 0 AS is_heading, l_linenumber AS line_no
  FROM v_lines2 JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
"""

VIEWS = {"v_tracks": (V_TRACKS, [])}


def with_views(*names: str, then: str) -> str:
    """``WITH <views and what they need> <then>``; ``then`` may open with further CTEs."""
    done: list[str] = []

    def add(name: str) -> None:
        text, needs = VIEWS[name]
        for need in needs:
            add(need)
        if text.strip() not in done:
            done.append(text.strip())

    for name in names:
        add(name)
    then = then.strip()
    glue = ",\n" if not then.upper().startswith("SELECT") else "\n"
    return "WITH " + ",\n".join(done) + glue + then


def v_pairs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two lists per mix: the original as V1 has it, a candidate that knows other things."""
    t = v_tracks(spark, folder)
    track = F.col("type") == "track"
    none = F.lit(None).cast("string")
    brand = F.col("label")
    full = F.concat_ws(" - ", "artist", "title")
    orig = t.select(
        F.col("tl_id").alias("pair_id"), "pos", "type", F.when(track, F.col("cue")).alias("cue"),
        F.when(track, F.col("text")).alias("text"),
        F.when(track & ~F.col("is_heading"), brand).alias("label"),
        F.when(track & (brand == "Brand#1"), F.col("dur_s")).alias("dur"))
    text = (F.when(F.col("is_heading") & (brand == "Brand#5"), "?").when(F.col("text") == "?", full)
            .when(brand.isin("Brand#1", "Brand#2"), F.upper("text"))
            .when(brand == "Brand#3", F.concat(F.substring("text", 1, 2), F.substr("text", F.lit(4))))
            .when(brand == "Brand#4", F.concat(F.lit("Visitor "), F.col("dur_s").cast("string"), F.lit(" - "), "title"))
            .otherwise(F.col("text")))
    minute = F.floor(F.col("start_s") / 60).cast("int")
    cue = F.when(F.col("line_no") == 7, none).when(F.col("line_no") == 3, F.col("cue")).otherwise(pad_left(minute, 2))
    cand = t.select(
        F.col("tl_id").alias("pair_id"), "pos", "type", F.when(track, cue).alias("cue"),
        F.when(track, text).alias("text"), F.when(track, brand).alias("label"),
        F.when(track, F.col("dur_s")).alias("dur"))
    return orig, cand


VIEWS["v_pairs"] = ("""
v_orig AS (SELECT tl_id AS pair_id, pos, type, CASE WHEN type = 'track' THEN cue END AS cue,
  CASE WHEN type = 'track' THEN text END AS text,
  CASE WHEN type = 'track' AND NOT is_heading THEN label END AS label,
  CASE WHEN type = 'track' AND label = 'Brand#1' THEN dur_s END AS dur FROM v_tracks),
v_cand AS (SELECT tl_id AS pair_id, pos, type,
  CASE WHEN type = 'track' THEN CASE WHEN line_no = 7 THEN NULL WHEN line_no = 3 THEN cue
    ELSE CASE WHEN start_s // 60 < 10 THEN '0' ELSE '' END || CAST(start_s // 60 AS VARCHAR) END END AS cue,
  CASE WHEN type = 'track' THEN CASE WHEN is_heading AND label = 'Brand#5' THEN '?'
    WHEN text = '?' THEN artist || ' - ' || title
    WHEN label IN ('Brand#1', 'Brand#2') THEN upper(text)
    WHEN label = 'Brand#3' THEN substr(text, 1, 2) || substr(text, 4)
    WHEN label = 'Brand#4' THEN 'Visitor ' || CAST(dur_s AS VARCHAR) || ' - ' || title ELSE text END END AS text,
  CASE WHEN type = 'track' THEN label END AS label, CASE WHEN type = 'track' THEN dur_s END AS dur
  FROM v_tracks)""", ["v_tracks"])


# The views below have one SQL text for Spark and DuckDB.
def _date_parts(c: str) -> dict:
    return {"y": f"CAST(year({c}) AS STRING)", "m": f"lpad(CAST(month({c}) AS STRING), 2, '0')",
            "d": f"lpad(CAST(day({c}) AS STRING), 2, '0')"}


_D = _date_parts("o_orderdate")
_MONTH = ("CASE month(o_orderdate) WHEN 1 THEN 'January' WHEN 2 THEN 'February' WHEN 3 THEN 'March' WHEN 4 THEN 'April' "
          "WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'July' WHEN 8 THEN 'August' WHEN 9 THEN 'September' "
          "WHEN 10 THEN 'October' WHEN 11 THEN 'November' ELSE 'December' END")

VIEWS["v_uploads"] = (f"""
v_uploads AS (SELECT o_orderkey AS upload_id,
  CASE o_orderkey % 3
    WHEN 0 THEN 'https://soundcloud.com/acct-' || CAST(o_custkey AS STRING) || '/track-' || CAST(o_orderkey AS STRING)
    WHEN 1 THEN 'https://www.mixcloud.com/acct-' || CAST(o_custkey AS STRING) || '/track-' || CAST(o_orderkey AS STRING) || '/'
    ELSE 'https://www.youtube.com/watch?v=' || lpad(CAST(o_orderkey AS STRING), 11, 'x') END AS player_url,
  c_name AS channel, c_mktsegment AS segment, substr(o_orderpriority, 3) || ' Podcast' AS entity,
  c_name || ' - ' || substr(o_orderpriority, 3) || ' Podcast ' ||
    CASE o_orderkey % 5 WHEN 0 THEN '#' || CAST(o_orderkey % 500 AS STRING)
      WHEN 1 THEN 'Vol. ' || CAST(o_orderkey % 500 AS STRING)
      WHEN 2 THEN '/ HPX.' || CAST(o_orderkey % 500 AS STRING)
      WHEN 3 THEN '' ELSE 'Episode ' || CAST(o_orderkey % 500 AS STRING) END || ' | ' ||
    CASE o_orderkey % 4 WHEN 0 THEN {_D['y']} || '-' || {_D['m']} || '-' || {_D['d']}
      WHEN 1 THEN {_D['d']} || '.' || {_D['m']} || '.' || {_D['y']}
      WHEN 2 THEN {_MONTH} || ' ' || CAST(day(o_orderdate) AS STRING) || ', ' || {_D['y']}
      ELSE {_D['d']} || '/' || {_D['m']} || '/' || substr({_D['y']}, 3, 2) END AS title,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INT) AS created_at, CAST(o_orderdate AS DATE) AS mix_date,
  CASE WHEN o_custkey % 13 = 0 THEN NULL WHEN o_custkey % 17 = 0 THEN 0
    ELSE CAST(floor(o_totalprice / 50) AS INT) END AS duration_s,
  CASE WHEN o_custkey % 23 = 0 THEN NULL ELSE CAST(o_custkey % 50 AS STRING) || ' likes' END AS likes_text,
  o_orderkey % 11 = 0 AS is_repost, o_orderkey % 19 = 0 AS is_playlist, o_custkey % 29 = 0 AS is_favorite,
  o_custkey AS account, o_orderstatus AS status, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey)""", [])

VIEWS["v_episodes"] = ("""
v_episodes AS (SELECT o_orderpriority AS source, CAST(o_orderkey % 500 AS INT) AS episode_no, o_orderkey AS entry_no,
  'https://www.mixcloud.com/acct-' || CAST(o_custkey AS STRING) || '/track-' || CAST(o_orderkey AS STRING) || '/' AS url,
  CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE CAST(floor(o_totalprice / 50) AS INT) END AS duration_s,
  o_orderstatus AS status, CAST(o_orderdate AS DATE) AS listed_at FROM orders)""", [])

VIEWS["v_pages"] = (f"""
v_pages AS (SELECT upload_id AS page_id,
  CAST(mix_date AS STRING) || ' - ' || channel || ' - ' || entity || ' ' || CAST(upload_id % 500 AS STRING) AS title,
  CASE WHEN account % 31 = 0 THEN CAST(created_at AS STRING) ELSE CAST(mix_date AS STRING) END AS sortkey,
  mix_date, entity, channel, segment,
  CASE segment WHEN 'AUTOMOBILE' THEN 'Techno' WHEN 'BUILDING' THEN 'House' WHEN 'FURNITURE' THEN 'Deep House'
    WHEN 'HOUSEHOLD' THEN 'Tech House' ELSE 'Ambient' END AS style,
  segment || ' ' || entity AS series, created_at + 30 AS last_edit, player_url, account, price,
  '[[File:' || CASE WHEN account % 4 = 0 THEN 'Flyer' ELSE CAST(mix_date AS STRING) || ' - ' || channel || ' - ' || entity || ' ' || CAST(upload_id % 500 AS STRING) END || '.jpg|right|360px]]' AS image_line,
  CASE WHEN segment IN ('AUTOMOBILE', 'BUILDING') THEN '{{{{StandardShow2h}}}}' ELSE '{{|{{{{NormalTableFormat}}}}' END AS details,
  CASE WHEN segment = 'HOUSEHOLD' THEN 'mirrors' ELSE 'plain' END AS mode,
  CASE WHEN segment = 'BUILDING' THEN 'https://groove.example/2026/' || CAST(upload_id AS STRING) || '-episode' ELSE '' END AS notes
  FROM v_uploads WHERE status = 'F'),
v_wiki AS (SELECT *, image_line || chr(10) || '== File details ==' || chr(10) || details || chr(10) || '{{{{Player' ||
  CASE WHEN mode = 'mirrors' THEN '|mode=mirrors' ELSE '' END || chr(10) || ' |' || player_url || chr(10) ||
  CASE WHEN mode = 'mirrors' THEN ' |https://hearthis.at/' || CAST(page_id AS STRING) || '/' || chr(10) ELSE '' END || '}}}}' || chr(10) ||
  CASE WHEN notes <> '' THEN '== Notes ==' || chr(10) || notes || chr(10) ELSE '' END ||
  '<!-- https://soundcloud.com/acct-' || CAST(account + 1 AS STRING) || '/track-' || CAST(page_id + 3 AS STRING) || ' -->' || chr(10) ||
  '== Tracklist ==' || chr(10) || '# [00] ' || channel || ' - Opening' || chr(10) || chr(10) ||
  '[[Category:' || CAST(year(mix_date) AS STRING) || ']]' || chr(10) || '[[Category:' || channel || ']]' || chr(10) || '[[Category:' || series || '|' || sortkey || ']]' || chr(10) ||
  '[[Category:' || style || ']]' || chr(10) || '[[Category:Tracklist: incomplete]]' AS wikitext FROM v_pages)""", ["v_uploads"])


def sql_view(spark: SparkSession, folder: str, view: str, cte: str | None = None) -> DataFrame:
    """Run one of the shared texts on Spark; ``cte`` names the last table of the view."""
    import re
    text = with_views(view, then=f"SELECT * FROM {cte or view}")
    bases = sorted(set(re.findall(r"\b(?:FROM|JOIN) (orders|customer|supplier|nation|region|part|documents|conversations|events|pages|lineitem)\b", text)))
    text = text.replace("{", "{{").replace("}", "}}")
    for base in bases:
        text = re.sub(rf"\b(FROM|JOIN) {base}\b", rf"\1 {{{base}}}", text)
    tables = {b: read_table(spark, folder, b) for b in bases}
    if "orders" in tables:  # the big table of every shared view
        tables["orders"] = spread(tables["orders"])
    return spark.sql(text, **tables)


def v_uploads(spark, folder):
    return sql_view(spark, folder, "v_uploads")


def v_episodes(spark, folder):
    return sql_view(spark, folder, "v_episodes")


def v_pages(spark, folder):
    return sql_view(spark, folder, "v_pages", "v_wiki")


VIEWS["v_entities"] = ("""
v_entities AS (
  SELECT c_name AS title, 'artist' AS type, CAST(c_custkey % 120 AS INT) AS mixes FROM customer
  UNION ALL SELECT n_name || ' (Club)', 'venue', CAST(n_nationkey * 3 AS INT) FROM nation
  UNION ALL SELECT n_name || ' (Festival)', 'event', CAST(n_nationkey AS INT) FROM nation
  UNION ALL SELECT n_name, CAST(NULL AS STRING), 0 FROM nation
  UNION ALL SELECT r_name || ' Sound System', 'artist', CAST(r_regionkey AS INT) FROM region
  UNION ALL SELECT r_name, 'venue', 40 FROM region
  UNION ALL SELECT r_name || ' Podcast', 'podcast', CAST(100 + r_regionkey AS INT) FROM region
  UNION ALL SELECT DISTINCT substr(o_orderpriority, 3) || ' Podcast', 'podcast', 7 FROM orders
  UNION ALL SELECT DISTINCT p_brand, 'recordlabel', 2 FROM part),
v_aliases AS (
  SELECT s_name AS alias, c_name AS target FROM supplier JOIN customer ON s_suppkey = c_custkey
  UNION ALL SELECT 'Stätion ' || CAST(n_nationkey AS STRING), n_name FROM nation
  UNION ALL SELECT r_name || ' Selectors', r_name || ' Podcast' FROM region),
v_names AS (SELECT o_custkey AS mix_id, o_orderkey AS pos, CASE o_orderkey % 8
    WHEN 0 THEN upper(c_name) WHEN 1 THEN lower(n_name) WHEN 2 THEN replace(s_name, 'pp', 'pp-')
    WHEN 3 THEN r_name WHEN 4 THEN 'Station ' || CAST(n_nationkey AS STRING)
    WHEN 5 THEN replace(r_name, 'A', 'Á') || ' selectors' WHEN 6 THEN 'Part ' || CAST(o_orderkey % 9 AS STRING)
    ELSE n_name || ' Loft' END AS name, n_name, r_name, c_name, n_nationkey
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_suppkey = o_custkey % 50)""", [])


def v_entities(spark, folder):
    return sql_view(spark, folder, "v_entities", "v_entities")


def v_aliases(spark, folder):
    return sql_view(spark, folder, "v_entities", "v_aliases")


def v_names(spark, folder):
    return sql_view(spark, folder, "v_entities", "v_names")


VIEWS["v_lines"] = ("""
v_lines AS (SELECT tl_id AS doc_id, pos - 1 AS line_no, CASE WHEN is_heading AND label = 'Brand#2' THEN 'https://example.org/' || CAST(tl_id AS VARCHAR)
  WHEN type = 'gap' AND line_no % 2 = 0 THEN '' WHEN text = '?' AND label = 'Brand#1' THEN 'Thanks for listening'
  WHEN label = 'Brand#4' THEN CAST(pos AS VARCHAR) || ') ' || artist || ' / ' || title
  WHEN label = 'Brand#5' THEN artist || ' – ' || title || CASE WHEN line_no = 2 THEN ' 00:12:30' ELSE '' END
  ELSE CAST(CASE WHEN line_no = 5 THEN 1 ELSE pos END AS VARCHAR) || '. ' || artist || ' - ' || title END AS raw FROM v_tracks)""", ["v_tracks"])


def v_lines(spark: SparkSession, folder: str) -> DataFrame:
    """V6: the lines of a description composed from each mix, numbered 0..n."""
    brand, pos = F.col("label"), F.col("pos").cast("string")
    number = F.when(F.col("line_no") == 5, "1").otherwise(pos)
    raw = (F.when(F.col("is_heading") & (brand == "Brand#2"), F.concat(F.lit("https://example.org/"), F.col("tl_id").cast("string")))
           .when((F.col("type") == "gap") & (F.col("line_no") % 2 == 0), "")
           .when((F.col("text") == "?") & (brand == "Brand#1"), "Thanks for listening")
           .when(brand == "Brand#4", F.concat(pos, F.lit(") "), "artist", F.lit(" / "), "title"))
           .when(brand == "Brand#5", F.concat("artist", F.lit(" – "), "title", F.when(F.col("line_no") == 2, " 00:12:30").otherwise("")))
           .otherwise(F.concat(number, F.lit(". "), "artist", F.lit(" - "), "title")))
    lines = v_tracks(spark, folder).select(F.col("tl_id").alias("doc_id"), (F.col("pos") - 1).alias("line_no"), raw.alias("raw"))
    return O.deal(lines, "doc_id", all_lines(spark, folder))


def v_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The composed descriptions and all documents, as whole texts."""
    composed = v_lines(spark, folder).groupBy("doc_id").agg(F.expr("listagg(raw, '\n') WITHIN GROUP (ORDER BY line_no)").alias("text"))
    docs = read_table(spark, folder, "documents").select((-F.col("doc_id") - 1).alias("doc_id"), "text")
    return composed.unionByName(docs)


def v_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Comments: every conversation turn, and each mix's tracks put on one line by number or cue."""
    t = v_tracks(spark, folder)
    by_number = F.concat(F.col("pos").cast("string"), F.lit(". "), "artist", F.lit(" - "), "title")
    minute = F.floor(F.col("start_s") / 60).cast("int")
    by_cue = F.concat(F.lit("("), pad_left(minute, 2), F.lit(") "), "artist", F.lit(" - "), "title")
    body = F.when(F.col("tl_id") % 2 == 0, by_number).otherwise(by_cue)
    mixes = (t.withColumn("_b", body).groupBy(F.col("tl_id").alias("player_url"))
             .agg(F.expr("listagg(_b, ' ') WITHIN GROUP (ORDER BY pos)").alias("body")).withColumn("comment_no", F.lit(0).cast("bigint")))
    talk = read_table(spark, folder, "conversations").select(F.col("conv_id").alias("player_url"), (F.col("turn") + 1).cast("bigint").alias("comment_no"), F.col("text").alias("body"))
    return mixes.unionByName(talk)
