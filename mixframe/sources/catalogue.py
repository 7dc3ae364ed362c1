"""Catalogue exports: wiki pages as XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalogue import CATEGORY

EXPORT_SCHEMA = """title STRING, ns INT, id BIGINT, revision STRUCT<timestamp: STRING, text: STRING>"""


def scan_catalogue(spark: SparkSession, path) -> DataFrame:
    """``pages(page_id, title, sortkey, categories, wikitext, last_edit)`` of the main namespace.

    The schema is given, so the export is read once.
    """
    raw = spark.read.format("xml").option("rowTag", "page").schema(EXPORT_SCHEMA).load(path)
    text = F.col("revision.text")
    return raw.where(F.col("ns") == 0).select(
        F.col("id").alias("page_id"), "title", F.col("title").alias("sortkey"),
        F.transform(F.regexp_extract_all(text, F.lit(CATEGORY), 1), lambda c: F.trim(c)).alias("categories"),
        text.alias("wikitext"), F.to_timestamp("revision.timestamp").alias("last_edit"))
