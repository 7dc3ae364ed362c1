"""Ordered scans over one mix, exact for mixes of any length.

Every list of the data model is rows keyed by a mix with an explicit ``pos``.  A window
partitioned by the mix is the fastest plan while each mix fits one task, so that is the plan
used up to ``BLOCK`` rows per mix.  The length is checked, not assumed: ``longest`` is the
largest ``pos`` (one aggregate, answered from statistics when ``pos`` is stored).  Beyond it the
same scan runs in blocks of ``BLOCK`` positions: windows inside (mix, block), one summary row per
block, a window over the summaries only, and an equi-join that carries the result back.  No task
ever sees a whole long mix and no row is dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BLOCK = 65_536
# Rows of one task whose windows each sort all of them.
TASK_ROWS = 250_000


@dataclass(frozen=True)
class Scan:
    """One ordered computation: what to combine, over which side of the row."""

    kind: str  # sum, max, last, first
    expr: Column
    reach: str  # before, upto, after, from, all


def sum_before(expr) -> Scan:
    return Scan("sum", expr, "before")


def sum_upto(expr) -> Scan:
    return Scan("sum", expr, "upto")


def max_before(expr) -> Scan:
    return Scan("max", expr, "before")


def max_upto(expr) -> Scan:
    return Scan("max", expr, "upto")


def last_before(expr) -> Scan:
    """Nearest earlier non-null value."""
    return Scan("last", expr, "before")


def last_upto(expr) -> Scan:
    return Scan("last", expr, "upto")


def first_after(expr) -> Scan:
    """Nearest later non-null value."""
    return Scan("first", expr, "after")


def first_from(expr) -> Scan:
    return Scan("first", expr, "from")


def lag(expr) -> Scan:
    """The previous row's value, null or not."""
    return Scan("last", F.struct(expr.alias("v")), "before-row")


def lead(expr) -> Scan:
    return Scan("first", F.struct(expr.alias("v")), "after-row")


def total(kind: str, expr) -> Scan:
    return Scan(kind, expr, "all")


def longest(df: DataFrame, pos: str = "pos") -> int:
    """Largest position of any mix: the size check behind the choice of plan."""
    row = df.agg(F.max(pos).alias("m")).head()
    return int(row.m) if row and row.m is not None else 0


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def deal(df: DataFrame, key, rows: int, task_rows: int = 0) -> DataFrame:
    """The ``rows`` of ``df`` by ``key`` on so many partitions that a task holds about ``TASK_ROWS``.

    Several windows in one task each keep a sorted copy of its rows.  Spark makes partitions by packed bytes, of which short
    rows take few, so their number per task would rise with the table.  A table of less than that per core stays as it is.
    """
    parts = -(-rows // (task_rows or TASK_ROWS))
    return df.repartition(parts, *_keys(key)) if parts > df.sparkSession.sparkContext.defaultParallelism else df


def scan(df: DataFrame, key, pos: str, longest_pos: int | None, block: int = 0,
         **specs: Scan) -> DataFrame:
    """Add one column per spec.  ``longest_pos`` None means: check it here."""
    block = block or BLOCK
    size = longest(df, pos) if longest_pos is None else longest_pos
    if size <= block:
        return _scan_plain(df, _keys(key), pos, specs)
    return _scan_blocks(df, _keys(key), pos, block, specs)


def _over(spec: Scan, part: list, pos, sorted_total: bool = False) -> Column:
    """The spec as a window inside ``part``; first-* runs on the reversed order to stay linear.

    ``sorted_total`` asks for the rows in order for a total as well, so that it shares the sort of the scans beside it.
    """
    first, row_before = Window.unboundedPreceding, -1
    ordered = Window.partitionBy(*part).orderBy(F.col(pos).asc())
    reverse = Window.partitionBy(*part).orderBy(F.col(pos).desc())
    if spec.reach == "all":
        whole = ordered.rowsBetween(first, Window.unboundedFollowing) if sorted_total else Window.partitionBy(*part)
        value = {"sum": F.sum, "max": F.max}[spec.kind](spec.expr).over(whole)
        return F.coalesce(value, F.lit(0)) if spec.kind == "sum" else value
    end = 0 if spec.reach in ("upto", "from") else row_before
    if spec.kind == "sum":
        return F.coalesce(F.sum(spec.expr).over(ordered.rowsBetween(first, end)), F.lit(0))
    if spec.kind == "max":
        return F.max(spec.expr).over(ordered.rowsBetween(first, end))
    if spec.reach == "before-row":
        return F.lag(spec.expr, 1).over(ordered)
    if spec.reach == "after-row":
        return F.lead(spec.expr, 1).over(ordered)
    side = ordered if spec.kind == "last" else reverse
    return F.last(spec.expr, ignorenulls=True).over(side.rowsBetween(first, end))


def _unwrap(spec: Scan, value: Column) -> Column:
    return value.getField("v") if spec.reach.endswith("-row") else value


def _scan_plain(df, keys, pos, specs):
    rising = any(s.reach != "all" and (s.kind != "first" or s.reach == "after-row") for s in specs.values())
    return df.select("*", *[_unwrap(s, _over(s, keys, pos, rising)).alias(n) for n, s in specs.items()])


def _scan_blocks(df, keys, pos, block, specs):
    names = df.columns
    base = df.withColumn("_block", F.floor(F.col(pos) / F.lit(block)))
    aggs = []
    for name, s in specs.items():
        aggs.append({
            "sum": F.sum(s.expr), "max": F.max(s.expr),
            "last": F.max_by(s.expr, F.when(s.expr.isNotNull(), F.col(pos))),
            "first": F.min_by(s.expr, F.when(s.expr.isNotNull(), F.col(pos))),
        }[s.kind].alias(f"_s_{name}"))
    summary = base.groupBy(*keys, "_block").agg(*aggs)
    carried = []
    for name, s in specs.items():
        column = F.col(f"_s_{name}")
        reach = {"upto": "before", "from": "after", "before-row": "before",
                 "after-row": "after"}.get(s.reach, s.reach)
        carried.append(_over(Scan(s.kind, column, reach), keys, "_block").alias(f"_c_{name}"))
    carry = summary.select(*keys, "_block", *carried)
    part = [*keys, "_block"]
    inside = base.select("*", *[
        (F.lit(None) if s.reach == "all" else _over(s, part, pos)).alias(f"_i_{n}")
        for n, s in specs.items()])
    out = null_safe_join(inside, carry, part, "left")
    columns = []
    for name, s in specs.items():
        own, over = F.col(f"_i_{name}"), F.col(f"_c_{name}")
        if s.reach == "all":
            value = over
        elif s.kind == "sum":
            value = own + over
        elif s.kind == "max":
            value = F.greatest(own, over)
        else:
            value = F.coalesce(own, over)
        columns.append(_unwrap(s, value).alias(name))
    return out.select(*names, *columns)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list, how: str = "inner") -> DataFrame:
    """Join on columns of the same name where two NULLs are equal; the left side's keys stay."""
    other = right.select(*[F.col(k).alias(f"_r_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_r_{i}")) for i, k in enumerate(keys)]
    return left.join(other, same, how).drop(*[f"_r_{i}" for i in range(len(keys))])


def dense_pos(df: DataFrame, key, order: list, longest_pos: int | None, block: int = 0,
              name: str = "pos") -> DataFrame:
    """Number the rows of each mix 1..n in ``order`` (a total order inside the mix).

    ``longest_pos`` is the largest group; None means: count the groups here (map-side combined).
    A long group is numbered by a range sort: rows are split by (mix, order), numbered inside
    each split, and shifted by the number of rows of the same mix in earlier splits.
    """
    keys = _keys(key)
    block = block or BLOCK
    size = longest_pos
    if size is None:
        size = largest_group(df, keys)
    if size <= block:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w).cast("int"))
    ranged = df.repartitionByRange(*keys, *order).withColumn("_split", F.spark_partition_id())
    ranged = cut_lineage(ranged)  # the split number must survive the loss of an executor
    inside = Window.partitionBy("_split", *keys).orderBy(*order)
    earlier = (Window.partitionBy(*keys).orderBy("_split")
               .rowsBetween(Window.unboundedPreceding, -1))
    shift = (ranged.groupBy("_split", *keys).agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_shift", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"))
    return (ranged.withColumn("_rn", F.row_number().over(inside))
            .transform(lambda rows: null_safe_join(rows, shift, ["_split", *keys]))
            .withColumn(name, (F.col("_rn") + F.col("_shift")).cast("int"))
            .drop("_split", "_rn", "_shift"))


def largest_group(df: DataFrame, key) -> int:
    row = (df.groupBy(*_keys(key)).agg(F.count(F.lit(1)).alias("n"))
           .agg(F.max("n").alias("m")).head())
    return int(row.m or 0)


def renumber(df: DataFrame, key, pos: str, longest_pos: int | None, block: int = 0) -> DataFrame:
    """Close the holes left by dropped rows."""
    out = scan(df, key, pos, longest_pos, block, _new=sum_upto(F.lit(1)))
    return out.withColumn(pos, F.col("_new").cast("int")).drop("_new")


def emit(df: DataFrame, key, pos: str, rows: Column, longest_pos: int | None,
         block: int = 0) -> DataFrame:
    """Replace each row by the structs of ``rows`` (0..n of them), numbered on through the mix."""
    keys = _keys(key)
    staged = df.select(*keys, F.col(pos).alias("_p"), rows.alias("_rows"))
    staged = scan(staged, keys, "_p", longest_pos, block, _base=sum_before(F.size("_rows")))
    return (staged.select(*keys, "_base", F.posexplode("_rows").alias("_i", "_row"))
            .select(*keys, (F.col("_base") + F.col("_i") + 1).cast("int").alias(pos), "_row.*"))
