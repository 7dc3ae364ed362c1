"""Registered streaming queries over the events table, with the SQL of their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import STATE_STORE, ensure_checkpoint_dir
from ..streaming import jobs as J
from . import fixtures as V
from .registry import Registry
from .upload_queries import page_players

query = Registry()



def events(spark, sf) -> DataFrame:
    schema = V.read_table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame) -> DataFrame:
    """Run what is there to its end into a table of the checkpoint folder, and read that."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    # read when a query starts; a session may have been built elsewhere
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    (stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state")
     .outputMode("append").trigger(availableNow=True).start(f"{base}/rows").awaitTermination())
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")




@query(V.with_views("v_pages", then="""
k AS (SELECT DISTINCT player_url FROM v_pages)
SELECT event_id, CASE WHEN u.player_url IN (SELECT player_url FROM k) THEN 'used' ELSE 'unused' END AS status
FROM events JOIN v_uploads u ON event_id = u.upload_id"""))
def stream_usage(spark, sf):
    uploads = V.v_uploads(spark, sf).select(F.col("upload_id").alias("event_id"), "player_url")
    own = page_players(spark, sf).join(
        V.sql_view(spark, sf, "v_pages").select(J.player_key("player_url").alias("url_key")).distinct(), "url_key", "left_semi")
    feed = events(spark, sf).join(uploads, "event_id")
    return run(J.stream_usage(feed, own).select("event_id", "status"))


@query("SELECT event_id, event_type FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def stream_hidden(spark, sf):
    hidden = V.read_table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return run(J.stream_hidden(events(spark, sf), hidden, "user_id").select("event_id", "event_type"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, sf):
    return run(J.stream_first_seen(events(spark, sf), ["user_id", "event_type"], "3650 days").select("user_id", "event_type"))


@query("""WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM l),
b AS (SELECT user_id, g, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, n FROM b WHERE ended <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_bursts(spark, sf):
    """A burst comes out once the watermark has passed its end; the newest ones are still open."""
    return run(J.stream_bursts(events(spark, sf), "6 hours", "1 hour", "user_id").select("user_id", "n"))


TTL = """WITH RECURSIVE r AS (SELECT CAST(user_id AS VARCHAR) AS key, ts, CASE WHEN event_type <> 'error' THEN event_type END AS answer FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, answer IS NULL, answer) AS n FROM r),
w AS (SELECT key, n, ts, 'ask' AS kind, answer, ts + CASE WHEN answer IS NULL THEN INTERVAL 1 DAY ELSE INTERVAL 2 DAY END AS ends FROM o WHERE n = 1
  UNION ALL SELECT o.key, o.n, o.ts, CASE WHEN o.ts < w.ends THEN 'hit' ELSE 'ask' END, CASE WHEN o.ts < w.ends THEN w.answer ELSE o.answer END,
    CASE WHEN o.ts < w.ends THEN w.ends ELSE o.ts + CASE WHEN o.answer IS NULL THEN INTERVAL 1 DAY ELSE INTERVAL 2 DAY END END
  FROM w JOIN o ON o.key = w.key AND o.n = w.n + 1)
SELECT key, kind, coalesce(answer, '') AS answer, count(*) AS n FROM w
WHERE date_trunc('second', ts) + INTERVAL 1 SECOND <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2, 3"""


@query(TTL)
def stream_ttl_lookup(spark, sf):
    """Answers kept for two days and misses for one; the requests of the last hour are still open."""
    feed = events(spark, sf).select(F.col("user_id").cast("string").alias("key"), "ts",
                                    F.when(F.col("event_type") != "error", F.col("event_type")).alias("answer"))
    out = run(J.stream_ttl_lookup(feed, "1 hour", (2 * J.DAY, J.DAY)))
    return out.groupBy("key", "kind", F.coalesce("answer", F.lit("")).alias("answer")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS started, event_id % 1000 AS generation, event_type AS value FROM events),
d AS (SELECT key, started, max(generation) AS top FROM e GROUP BY 1, 2),
m AS (SELECT key, started, max(top) OVER (PARTITION BY key ORDER BY started) AS newest FROM d)
SELECT e.key, e.generation, e.value FROM e JOIN m ON m.key = e.key AND m.started = e.started AND m.newest = e.generation
WHERE e.started + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_latest(spark, sf):
    """The answers of the newest generation a user has had up to that day; the last, open day is not settled."""
    feed = events(spark, sf).select(F.col("user_id").cast("string").alias("key"), "ts", (F.col("event_id") % 1000).alias("generation"),
                                    F.col("event_type").alias("value"))
    return run(J.stream_latest(feed, "1 hour", "1 day", 3_650 * J.DAY)).drop("started")
