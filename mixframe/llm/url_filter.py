"""URL filters as a sort-merge range join.

With the labels of a host reversed, a host and all its subdomains are one interval of sorted keys, and the
intervals of all rules are nested or apart.  Addresses are range-partitioned by key; a rule goes to every
partition its interval touches.  Each partition is swept in order with a stack of the rules whose interval
is open; the longest of them whose path starts the address's path decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .words import NULL_ID

# Host and path of an address.
HOST, PATH = r"://([^/?#]*)", r"://[^/?#]*([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, HOST, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def key_of(host: Column) -> Column:
    """Labels from the last to the first, a dot behind each."""
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "."), F.lit("."))


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, key, kind, id, host, path, verdict), sorted by the first three; rules are kind 0."""
    stack: list[tuple[bytes, dict[bytes, tuple[str, str]], set[int]]] = []
    now = None
    for rows in batches:
        part, key, kind, ids, host, path, verdict = (c.to_pylist() for c in rows.columns)
        out: list[list] = [[], [], [], [], []]
        for i in range(len(part)):
            if part[i] != now:
                stack, now = [], part[i]
            here, own = key[i].encode(), path[i].encode()
            while stack and not here.startswith(stack[-1][0]):
                stack.pop()
            if kind[i] == 0:
                if not stack or stack[-1][0] != here:
                    stack.append((here, {}, set()))
                # of rules for one place, block comes before allow
                rule = (verdict[i], host[i] + path[i])
                stack[-1][1][own] = max(stack[-1][1].get(own, rule), rule)
                stack[-1][2].add(len(own))
                continue
            best = None
            for level, paths, sizes in stack:
                for size in sizes:
                    rule = paths.get(own[:size]) if size <= len(own) else None
                    if rule and (best is None or len(level) + size >= best[0]):
                        best = (len(level) + size, rule)
            for column, value in zip(out, (ids[i], host[i], path[i], best and best[1][1], best and best[1][0])):
                column.append(value)
        kinds = (pa.int64(), *[pa.string()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["id", "host", "path", "rule", "verdict"])


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages``.

    ``rules`` has the columns host, path and verdict (allow or block).  A rule fits its host and every
    subdomain where the path starts with its own; the longest (host and path together) decides, of two
    for one place the blocking one; without any, ``rule`` is null and ``default`` is the verdict.  A url
    that is null or has no ``://`` has an empty host and path; null ids stay null, repeated rows are all
    judged; rules with a null are left out; an empty table gives no rows.
    """
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    url = F.col(url_column)
    plain = pages.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("key", key_of(F.col("host")))
    # a very common host is split too
    dealt = stage(plain.repartitionByRange(parts, "key", "path", "id").withColumn("part", F.spark_partition_id()), "addresses")
    bounds = dealt.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect()  # a row for each partition
    spans = F.array(*[F.struct(F.lit(b.part).alias("part"), F.lit(b.low).alias("low"), F.lit(b.high).alias("high")) for b in bounds]) if bounds else F.expr(
        "CAST(array() AS array<struct<part: int, low: string, high: string>>)")
    rule = rules.dropna(subset=["host", "path", "verdict"]).select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").withColumn("key", key_of(F.col("host")))
    touched = F.filter(spans, lambda b: (b["high"] >= F.col("key")) & ((b["low"] < F.col("key")) | F.startswith(b["low"], F.col("key"))))
    rule = rule.select(F.explode(F.transform(touched, lambda b: b["part"])).alias("part"), "key", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), "host", "path", "verdict")
    both = rule.unionByName(dealt.select("part", "key", F.lit(1).alias("kind"), "id", "host", "path", F.lit(None).cast("string").alias("verdict")))
    swept = both.repartition(parts, "part").sortWithinPartitions("part", "key", "kind").mapInArrow(sweep, "id long, host string, path string, rule string, verdict string")
    return swept.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("page_id"), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
