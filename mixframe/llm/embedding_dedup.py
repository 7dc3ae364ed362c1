"""Embedding near-dedup by collision-counting projections.

Every unit vector is projected on many random directions.  Two vectors collide on a direction if their
values are at most a window apart, each being the centre of its own window.  Vectors at distance d differ
on a direction by a normal value of standard deviation d, so the share of directions on which a pair at
the threshold collides is known, and the number of misses to allow follows from the recall asked for.

The first direction deals the work: vectors are sorted by it and cut into slabs of bounded size, and only
slabs whose values can collide meet, as a tile of two slabs.  Inside a tile the collisions on the other
directions are counted for all pairs in the window; pairs with enough of them are verified by their
cosine.  A tile gives sums and a spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .graph import components
from .words import NULL_ID

#: Directions, the first of them for dealing.
DIRECTIONS = 24
#: Windows in standard deviations of a pair at the threshold: on the first direction, on the others.
FIRST_WINDOW, WINDOW = 2.6, 2.0
#: Share of the pairs at the threshold that must pass; closer pairs pass more often.
RECALL = 0.95
#: Vectors of a slab.
SLAB_ROWS = 8192
#: Steps per unit of the stored projections.
SCALE = 2048
SEED = 5


def allowed_misses(recall: float = RECALL, directions: int = DIRECTIONS) -> int:
    """The least number of missed collisions to allow so that a pair at the threshold passes with ``recall``."""
    within = lambda w: erf(w / sqrt(2))
    miss, n, passed = 1 - within(WINDOW), directions - 1, 0.0
    for misses in range(n + 1):
        passed += comb(n, misses) * miss**misses * (1 - miss) ** (n - misses)
        if within(FIRST_WINDOW) * passed >= recall:
            return misses
    return n


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, DIRECTIONS))


def unit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, dim, first, places, unit) of every row; null but for the id where a vector has no direction."""
    for rows in batches:
        ids, out = rows.column(0).to_numpy(zero_copy_only=False), []
        vectors = rows.column(1)
        flat = vectors.flatten().cast(pa.float64())
        values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
        sizes = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        for dim in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == dim)
            x = values[begin[at][:, None] + np.arange(dim)]
            largest = np.abs(x).max(axis=1)
            good = np.isfinite(largest) & (largest > 0)
            at, x = at[good], x[good] / largest[good][:, None]
            x /= np.sqrt((x * x).sum(axis=1))[:, None]
            out.append((at, dim, x, np.clip(np.rint(x @ directions(int(dim)) * SCALE), -16383, 16383).astype(np.int16)))
        rest = np.ones(len(ids), dtype=bool)
        for at, dim, x, p in out:
            rest[at] = False
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.full(len(at), dim)), pa.array(p[:, 0].astype(np.int32)),
                                              pa.array([r.tobytes() for r in p], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())],
                                             ["id", "dim", "first", "places", "unit"])
        none = int(rest.sum())
        yield pa.RecordBatch.from_arrays([pa.array(ids[rest]), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary()), pa.nulls(none, pa.binary())],
                                         ["id", "dim", "first", "places", "unit"])


def tile_links(table: pa.Table, threshold: float, first_window: int, window: int, misses: int) -> pa.Table:
    """Links found between two slabs (or inside one): (class, links, root) of every class that has one."""
    side = table["side"].to_numpy()
    dims, ids, copies = table["dim"].to_numpy(), table["class"].to_numpy(), table["copies"].to_numpy()
    found: list[np.ndarray] = []
    for dim in np.unique(dims):
        here = np.flatnonzero(dims == dim)
        rows = table.take(pa.array(here))
        places = np.frombuffer(b"".join(rows["places"].to_pylist()), dtype=np.int16).reshape(len(here), -1)
        units = np.frombuffer(b"".join(rows["unit"].to_pylist()), dtype=np.float64).reshape(len(here), -1)
        order = np.argsort(places[:, 0], kind="stable")
        here, places, units = here[order], places[order], units[order]
        left = np.flatnonzero(side[here] == 0)
        right = np.flatnonzero(side[here] == 1)
        inside = not (side == 1).any()
        right = left if inside else right
        shifted = np.ascontiguousarray(places[right].T).view(np.uint16)
        first = places[right, 0].astype(np.int32)
        for k in range(0, len(left), 64):
            block = left[k : k + 64]
            low = np.searchsorted(first, int(places[block[0], 0]) - first_window, "left")
            high = np.searchsorted(first, int(places[block[-1], 0]) + first_window, "right")
            if inside:
                low = max(low, k)
            if high <= low:
                continue
            missed = np.zeros((len(block), high - low), dtype=np.uint8)
            for j in range(1, places.shape[1]):
                centre = (places[block, j].astype(np.int32) - window).astype(np.int16).view(np.uint16)
                missed += (shifted[j, low:high][None, :] - centre[:, None]) > np.uint16(2 * window)
            near = np.abs(places[block, 0].astype(np.int32)[:, None] - first[low:high][None, :]) <= first_window
            x, y = np.nonzero((missed <= misses) & near)
            if not len(x):
                continue
            cols = np.unique(y)
            cosine = units[block] @ units[right[low + cols]].T
            good = cosine[x, np.searchsorted(cols, y)] >= threshold
            a, b = block[x[good]], right[low + y[good]]
            if inside:
                a, b = a[b > a], b[b > a]
            found.append(np.column_stack((here[a], here[b])))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
    links = np.bincount(pairs[:, 0], weights=copies[pairs[:, 1]], minlength=len(ids)) + np.bincount(pairs[:, 1], weights=copies[pairs[:, 0]], minlength=len(ids))
    root = ids.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, pairs[:, 0], root[pairs[:, 1]])
        np.minimum.at(root, pairs[:, 1], root[pairs[:, 0]])
        if (root == before).all():
            break
    some = np.flatnonzero(links > 0)
    return pa.table({"class": ids[some], "links": links[some].astype(np.int64), "root": root[some]})


def near_groups(vectors: DataFrame, threshold: float = 0.9, recall: float = RECALL, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    Links are pairs with a cosine of ``threshold`` or more, in double precision; of the pairs at the
    threshold at least ``recall`` are found on average, of closer ones more, and none below it is given.
    Equal vectors count as links of each other.  Vectors that are null, empty, zero or hold null or
    non-finite components have no links; vectors of different length are not compared.  A null id is its
    own value, smaller than all others; repeated rows are vectors of their own; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    plain = vectors.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    units = plain.mapInArrow(unit_batches, "id long, dim long, first int, places binary, unit binary").withColumn("key", F.md5("unit"))
    classes = units.filter("unit IS NOT NULL").groupBy("key", "dim", "first").agg(F.min(F.struct("id", "places", "unit")).alias("one"), F.count("*").alias("copies"))
    # equal vectors are one class, named by a number of its own: ids may be shared or null
    classes = stage(classes.select(F.monotonically_increasing_id().alias("class"), "key", "dim", "first", "copies", "one.*"), "classes")
    n = classes.count()
    slabs = 1 + n // SLAB_ROWS
    dealt = stage(classes.repartitionByRange(slabs, "first", "id").withColumn("slab", F.spark_partition_id()), "slabs")
    distance = sqrt(2 - 2 * threshold)
    first_window, window = round(FIRST_WINDOW * distance * SCALE), round(WINDOW * distance * SCALE)
    bounds = dealt.groupBy("slab").agg(F.min("first").alias("low"), F.max("first").alias("high")).orderBy("slab").collect()  # a row for each slab
    meet = [(a.slab, a.slab, b.slab, 0) for a in bounds for b in bounds if a.slab <= b.slab and b.low <= a.high + first_window]
    meet += [(b, a, b, 1) for _, a, b, _ in meet if a != b]
    tiles = dealt.join(spark.createDataFrame(meet, "slab int, a int, b int, side int"), "slab")
    misses = allowed_misses(recall)
    found = tiles.select("a", "b", "side", "class", "dim", "copies", "places", "unit").groupBy("a", "b").applyInArrow(
        lambda t: tile_links(t, threshold, first_window, window, misses), "class long, links long, root long")
    found = stage(found, "found")
    inside = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    named = (classes.select("class", "key", "id", "copies").join(links, "class", "left").join(inside, F.col("class") == F.col("node"), "left")
             .select("key", "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("label")))
    named = stage(named, "named")
    least = named.groupBy("label").agg(F.min("id").alias("component"))
    named = named.join(least, "label").select("key", "n_links", "component")
    out = units.select("id", "key").join(named, "key", "left")
    known = lambda c: F.when(c != NULL_ID, c)
    component = F.coalesce("component", "id")
    return out.select(known(F.col("id")).alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      known(component).alias("component_id"), (F.col("id") == component).alias("kept"))
