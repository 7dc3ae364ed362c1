"""Upload dumps: nested API JSON, paginated listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import player_key
from ..session import cut_lineage

NESTED = "^(ARRAY|OBJECT)<"


def read_dumps(spark: SparkSession, paths) -> DataFrame:
    """``(ingest_no, json)`` of JSON-lines dumps; the order is file, then split, then line."""
    return (spark.read.text(paths).select(
        F.struct(F.col("_metadata.file_path").alias("file"),
                 F.col("_metadata.file_block_start").alias("block"),
                 # rises line by line inside a split
                 F.monotonically_increasing_id().alias("line")).alias("ingest_no"),
        F.col("value").alias("json")))


def scan_uploads(dumps: DataFrame) -> DataFrame:
    """Every object with a ``url`` and a numeric ``duration`` (ms), at any depth of the dump.

    ``dumps(ingest_no, json)``.  The values are opened level by level until none is left; only lists
    and objects go on to the next level, which is written before it is read.  Of one address the
    first value counts.
    """
    level = dumps.select("ingest_no", F.lit("").alias("path"), F.try_parse_json("json").alias("v"))
    level = level.where(F.schema_of_variant("v").rlike(NESTED))
    found = None
    while True:
        url = F.coalesce(F.try_variant_get("v", "$.url", "string"),
                         F.try_variant_get("v", "$.permalink_url", "string"))
        ms = F.when(F.schema_of_variant(F.try_variant_get("v", "$.duration", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"),
                    F.try_variant_get("v", "$.duration", "double"))
        hit = level.select("ingest_no", "path", url.alias("player_url"), ms.cast("bigint").alias("duration_ms"),
                           F.try_variant_get("v", "$.title", "string").alias("title"))
        hit = hit.where(F.col("player_url").isNotNull() & F.col("duration_ms").isNotNull())
        found = hit if found is None else found.unionByName(hit)
        level = (level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer()))
                 .select("ingest_no", F.concat("path", F.lit("/"), F.lpad(F.col("pos").cast("string"), 9, "0")).alias("path"),
                         F.col("value").alias("v")).where(F.schema_of_variant("v").rlike(NESTED)))
        level = cut_lineage(level)
        if level.isEmpty():
            break
    keyed = found.withColumn("url_key", player_key("player_url"))
    first = F.min_by(F.struct("player_url", "title", "duration_ms"), F.struct("ingest_no", "path"))
    return keyed.groupBy("url_key").agg(first.alias("r")).select("url_key", "r.*")


def scan_parts(rows: DataFrame, key: str = "url") -> DataFrame:
    """Pages of one listing put together: order kept, the overlap between pages taken out.

    ``rows(listing, part_no, row_no, <key>, ...)``; of a repeated key the first occurrence stays.
    """
    order = F.struct("part_no", "row_no")
    rest = [c for c in rows.columns if c not in ("listing", key)]
    kept = rows.groupBy("listing", key).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return kept.select("listing", key, "r.*")
