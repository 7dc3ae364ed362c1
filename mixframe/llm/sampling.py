"""Bounded samples of labelled texts, for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounded_sample(docs: DataFrame, rows: int, id_column: str, text_column: str, kind: Column | None = None, labels: DataFrame | None = None) -> DataFrame:
    """``(kind, text)``: at most ``rows`` texts of each kind, those with the smallest hash of id and text.

    The kind is a column of ``docs``, or comes from ``labels`` ``(id, kind)`` with one row per id.  Rows are told
    apart by id and text, so that texts under one id or none are drawn one by one and repeated rows count once.
    Only about four times as many texts as wanted are moved; ids and hashes decide which.  Null kinds, and with
    ``labels`` null ids, are left out; a null text is an empty one.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_column}`").alias("id"), text.alias("text"), *([] if kind is None else [kind.alias("kind")]))
    base = base.withColumn("hash", F.xxhash64("id", "text"))
    place = F.col("hash") / F.lit(2.0**64) + 0.5  # even over 0 to 1
    narrow = base.drop("text")
    if labels is not None:
        narrow = narrow.join(labels, "id")
    type_of_kind = narrow.schema["kind"].dataType.simpleString()
    kinds = narrow.filter("kind IS NOT NULL").groupBy("kind").agg((F.lit(4.0 * rows) / F.approx_count_distinct("hash")).alias("part")).collect()  # one row per kind
    if not kinds:
        return base.sparkSession.createDataFrame([], f"kind {type_of_kind}, text string")
    parts = F.broadcast(base.sparkSession.createDataFrame([(r.kind, r.part) for r in kinds], f"kind {type_of_kind}, part double"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("hash"))
    if labels is None:
        wide = base.filter(place <= max(r.part for r in kinds))
        few = wide.join(parts, "kind").filter(place <= F.col("part")).groupBy("kind", "hash").agg(F.min("text").alias("text"))
        return few.withColumn("rank", rank).filter(F.col("rank") <= rows).select("kind", "text")
    # texts do not meet the labels: hashes do, and at most `rows` of them a kind go to every task that reads texts
    few = narrow.join(parts, "kind").filter(place <= F.col("part")).select("kind", "hash").distinct()
    chosen = few.withColumn("rank", rank).filter(F.col("rank") <= rows).drop("rank")
    return base.join(F.broadcast(chosen), "hash").groupBy("kind", "hash").agg(F.min("text").alias("text")).drop("hash")
