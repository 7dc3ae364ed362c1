"""The registered queries of the subpackage, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from ..plans.registry import Registry
from ..session import read_table, stage
from . import (chat_format, decontaminate, embedding_dedup, language_id, ngram_join, prefix_trie, quality, source_mixing, spelling_variants,
               substring_dedup, suffix_array_dedup, toxicity, url_filter)

query = Registry()

ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


# CRC-32 as SQL: the table of the reflected polynomial, then one step per byte of the UTF-8 text.
CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def _crc_sql(text: str) -> str:
    """The unsigned checksum of a not empty SQL text, in a query that has ``crc_table``."""
    octets = f"list_transform(range(1, 1 + 2 * octet_length(encode({text})), 2), lambda j: ('0x' || hex(encode({text}))[j:j + 1])::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


def _held_out(modulus: int, rest: int):
    """Whether a row is kept from learning; one without an id is not, as it has no label either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == rest, F.lit(False))


@query(f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
pieces AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) ELSE [array_to_string(w, ' ')] END) AS piece FROM words WHERE len(w) > 0),
sets AS (SELECT DISTINCT doc_id, piece FROM pieces),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_n FROM sets x JOIN sets y ON x.piece = y.piece AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * both_n >= 85 * (p.n + q.n - both_n)),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.seen)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT node AS doc_id, min(seen) AS component_id FROM reach GROUP BY node) r USING (doc_id)
""")
def op1_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.similar_groups(read_table(spark, sf, "documents").select("doc_id", "text"), size=4, percent=85)


@query(r"""
WITH turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
marked AS (SELECT *, replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>') AS safe FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || role || ': ' || safe || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
""")
def op2_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    one = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text"))
                                                   for i, role in enumerate(("user", "assistant"))])).alias("one")).select("one.*")
    out = chat_format.format_chats(read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(one))
    out = out.withColumn("turns", chat_format.read_turns(F.col("formatted")))
    masked = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat_format.unescape(s["text"], chat_format.CHAT)), "")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.withColumn("masked", masked).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"),
        F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query(f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
parts AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fits AS (SELECT parts.*, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS rank
  FROM parts LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM fits WHERE rank = 1
""")
def op3_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(read_table(spark, sf, "pages").select("page_id", "url"), rules)


@query()
def op4_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = substring_dedup.drop_repeated_windows(read_table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query()
def op5_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text", "lang").withColumn("held_out", _held_out(4, 2))
    field = language_id.fit(docs.filter(~F.col("held_out")))
    return language_id.identify(docs.drop("lang"), field).select("doc_id", "held_out", "lang_pred", "score")


@query()
def op6_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.benchmark_matches(read_table(spark, sf, "documents").select("doc_id", "text"), read_table(spark, sf, "benchmark"))


@query()
def op7_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    out = source_mixing.mix_sources(read_table(spark, sf, "documents").select("doc_id", "source", "text"))
    return out.drop("text")


@query()
def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text").withColumn("held_out", _held_out(3, 1))
    lexicon = toxicity.fit(docs.filter(~F.col("held_out")), read_table(spark, sf, "labels"))
    return toxicity.score(docs, lexicon).select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query()
def op9_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_dedup.near_groups(read_table(spark, sf, "embeddings"))


@query()
def op10_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = suffix_array_dedup.drop_repeated_bytes(read_table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op11_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text").withColumn("held_out", _held_out(5, 0))
    model = quality.fit(docs.filter(~F.col("held_out")), read_table(spark, sf, "labels"))
    return quality.score(docs, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query(f"""
WITH {CRC_TABLE},
numbered AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS source, {_crc_sql("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM numbered), crc_table),
rebuilt AS (SELECT c.conv_id, pos, role, text FROM convs c JOIN numbered n ON n.conv_id = c.source AND pos <= h
  UNION ALL SELECT c.conv_id, pos, role, text FROM convs c JOIN numbered n ON n.conv_id = c.conv_id AND pos > h),
seqs AS (SELECT conv_id, coalesce(s, []) AS s FROM convs LEFT JOIN (SELECT conv_id, list(md5(role || chr(0) || text) || ':' || length(text) ORDER BY pos) AS s FROM rebuilt GROUP BY conv_id) USING (conv_id)),
begins AS (SELECT conv_id, len(s) AS size, unnest(list_transform(range(0, len(s) + 1), lambda d: {{'depth': d, 'node': array_to_string(s[:d], ' '), 'parent': array_to_string(s[:d - 1], ' '),
  'chars': CASE WHEN d = 0 THEN 0 ELSE split_part(s[d], ':', 2)::BIGINT END}})) AS b FROM seqs),
nodes AS (SELECT b.node AS node, b.depth AS depth, CASE WHEN b.depth > 0 THEN b.parent END AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(b.chars) AS own,
  coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = b.depth), '') AS ended FROM begins GROUP BY ALL),
family AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT DISTINCT up.b.node AS node, low.b.node AS under FROM begins up JOIN begins low ON up.conv_id = low.conv_id AND low.b.depth >= up.b.depth),
sums AS (SELECT b.node, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves FROM below b JOIN nodes n ON n.node = b.under LEFT JOIN family f ON f.node = b.under GROUP BY b.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens, sha256(n.ended) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN family f ON f.node = n.node JOIN sums s ON s.node = n.node
""")
def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    turns = stage(prefix_trie.encoded(read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")), "encoded-turns")
    convs = turns.filter("pos = 1").select("conv_id")
    conv = F.col("conv_id")
    rebuilt = prefix_trie.with_heads(turns, convs, conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6, 5)
    return prefix_trie.prefix_trie(rebuilt, convs)


@query(f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all({ASCII_LOWER.replace("text", "array_to_string(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'), ' ')")}, '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS n FROM runs GROUP BY ALL),
sums AS (SELECT run, n, {_crc_sql("(id || ':' || run)")} AS h FROM counted, crc_table),
words AS (SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, sum(n)::BIGINT AS n FROM sums GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
lacking AS (SELECT word, n, unnest(list_transform(range(1, length(word) + 1), lambda i: {{'i': i, 'rest': word[:i - 1] || word[i + 1:]}})) AS l FROM words),
edits AS (SELECT x.word, y.word AS near FROM lacking x JOIN lacking y ON x.l = y.l AND x.word <> y.word
  UNION SELECT l.word, w.word FROM lacking l JOIN words w ON w.word = l.l.rest UNION SELECT w.word, l.word FROM lacking l JOIN words w ON w.word = l.l.rest),
best AS (SELECT e.word, count(*) AS n_near, first(near ORDER BY y.n DESC, near) AS near, max(y.n) AS near_n FROM edits e JOIN words y ON y.word = e.near GROUP BY e.word),
forms AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM forms UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM forms f JOIN walk w ON w.word = f.word JOIN forms e ON e.word = w.at AND e.form IS NULL
""")
def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_variants.spelling_variants(read_table(spark, sf, "documents").select("doc_id", "text"))


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)
