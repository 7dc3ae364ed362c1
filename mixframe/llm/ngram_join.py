"""Jaccard self-join of documents by their word shingles: T-occurrence search after DivideSkip.

A document asks for all others in at least T of the inverted lists of its shingles, where T follows from
the threshold.  Its lists are divided: all but T - s are *short*, the rest *long*; who reaches T is in at
least s of the short lists.  Short lists are merged in sorted order (the shuffle's sort-merge does what
the heap does on one machine) and counted; each document found s times is then looked up in the long
lists by binary search, which is done in its sorted set.

List lengths come from a count table of fixed size, filled over all documents: a shingle's rank is the
logarithm of its counter, so a passage shared by many is never among the short lists of a document that
has enough of its own.  Any ranking gives right results, as all documents use one.

Documents with equal sets are one class.  Classes of one group need not all be compared with each other:
first each member of a list is compared with its neighbour and with the list's first member, the one with
the fewest rarer shingles of its own; where that already connects a whole list, the list is done.  Only
lists left with several components are merged in full, across components.  A pair is then taken up only
if its bitmaps allow it: each shingle flips one bit, so two sets differ in at least as many shingles as
their bitmaps differ in bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .graph import components
from .words import NULL_ID, ODD, Words, keys_of, mix, shingles, signed, slices

#: The count table has 2**TABLE_BITS counters; as ranks it takes as many bytes, whatever the corpus.
TABLE_BITS = 22
BLOCK = 1 << 14
#: Short lists in which a candidate must be found (s above).
SHORT_HITS = 2
#: Numbers of 64 bits in a bitmap.
BITMAP = 16


def fingerprints(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One number for each set; sets are taken for equal if these are (64 bits, over the set and its size)."""
    size = np.diff(offsets)
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(mix(hashes ^ np.uint64(ODD[7])), out=total[1:])
    return mix((total[offsets[1:]] - total[offsets[:-1]]) ^ mix(size.astype(np.uint64)))


def bitmaps(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bitmap of each set, as rows of BITMAP numbers."""
    sets, bits = len(offsets) - 1, 64 * BITMAP
    owner = np.repeat(np.arange(sets), np.diff(offsets))
    flips = np.bincount(owner * bits + (hashes % np.uint64(bits)).astype(np.int64), minlength=sets * bits)
    return np.packbits((flips % 2).astype(bool).reshape(sets, bits), axis=1).view(np.int64)


def member_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc, key, class, n, bitmap) and, at the end of a task, its counters by block."""
    counts = np.zeros(1 << TABLE_BITS, dtype=np.int32)
    names = ["doc", "key", "class", "n", "bitmap", "block", "counts"]
    for rows, texts in slices(batches):
        hashes, offsets = shingles(Words(texts, lower=True), size)
        counts += np.bincount((hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64), minlength=len(counts)).astype(np.int32) if len(hashes) else 0
        none = pa.nulls(len(texts), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(keys_of(rows.column(0))), rows.column(2), pa.array(signed(fingerprints(hashes, offsets))),
                                          pa.array(np.diff(offsets)), pa.array(list(bitmaps(hashes, offsets)), pa.list_(pa.int64())), none, pa.nulls(len(texts), pa.binary())], names)
    for block in np.flatnonzero(counts.reshape(-1, BLOCK).any(axis=1)):
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 4 + [pa.nulls(1, pa.list_(pa.int64())), pa.array([block], pa.int32()),
                                         pa.array([counts[block * BLOCK : (block + 1) * BLOCK].tobytes()], pa.binary())], names)


def add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the counters of each block; rows of a block are in one task, in any order."""
    total: dict[int, np.ndarray] = {}
    for rows in batches:
        for block, counts in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            total[block] = total.get(block, 0) + np.frombuffer(counts, dtype=np.int32).astype(np.int64)
    for block, counts in total.items():
        rank = np.ceil(2 * np.log2(counts + 1)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([rank.tobytes()], pa.binary())], ["block", "rank"])


def short_list_batches(batches: Iterator[pa.RecordBatch], size: int, percent: int, ranks) -> Iterator[pa.RecordBatch]:
    """The short lists of each class: (shingle, class, n, place among its lists); a class goes out once a task."""
    seen: set[int] = set()
    for _, texts in slices(batches):
        hashes, offsets = shingles(Words(texts, lower=True), size)
        n, found = np.diff(offsets), signed(fingerprints(hashes, offsets))
        fresh = np.zeros(len(n), dtype=bool)
        for i, name in enumerate(found.tolist()):
            if n[i] and name not in seen:
                seen.add(name)
                fresh[i] = True
        needed = -(-percent * n // 100)
        short = np.where(fresh, n - needed + np.minimum(SHORT_HITS, needed), 0)
        owner = np.repeat(np.arange(len(n)), n)
        mine = np.flatnonzero(fresh[owner])
        owner, hashes = owner[mine], hashes[mine]
        order = np.lexsort((hashes, ranks.value[(hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)], owner))
        owner, hashes = owner[order], hashes[order]
        begin = np.searchsorted(owner, np.arange(len(n)))
        place = np.arange(len(owner)) - begin[owner]
        mine = np.flatnonzero(place < short[owner])
        yield pa.RecordBatch.from_arrays([pa.array(signed(hashes[mine])), pa.array(found[owner[mine]]), pa.array(n[owner[mine]].astype(np.int32)), pa.array(place[mine].astype(np.int32))],
                                         ["shingle", "class", "n", "place"])


def set_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """From rows (doc, text, class): the sorted set of each class, where the text is the class's."""
    for rows, texts in slices(batches):
        hashes, offsets = shingles(Words(texts, lower=True), size)
        asked = rows.column(2).to_numpy(zero_copy_only=False)
        mine = np.flatnonzero(signed(fingerprints(hashes, offsets)) == asked)
        yield pa.RecordBatch.from_arrays([pa.array(asked[mine]), pa.array([hashes[offsets[i] : offsets[i + 1]].tobytes() for i in mine], pa.binary())], ["class", "hashes"])


def probe_batches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Keep the pairs whose sets overlap enough: binary search of the smaller set's shingles in the larger."""
    for rows in batches:
        a, b, x, y = (rows.column(i) for i in range(4))
        good = []
        for p, q in zip(x, y):
            p, q = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (p, q))
            p, q = (p, q) if len(p) <= len(q) else (q, p)
            at = np.searchsorted(q, p)
            both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
            good.append(100 * both >= percent * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def _identified(id_column: str, text_column: str):
    """Id and text of a row, and a hash of the text that tells the texts under one id apart."""
    text = F.col(f"`{text_column}`")
    return F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(NULL_ID)).alias("doc"), text.alias("text"), F.xxhash64(text).alias("key")


def similar_groups(docs: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row: groups of documents linked by similarity.

    Words are runs of other bytes than ASCII white space, A-Z in lower case; a text shorter than ``size``
    words is one shingle.  Two texts are linked if ``100 * intersection >= percent * union``; a text
    without words (empty or null) is linked with nothing.  ``component_id`` is the smallest id reachable.
    A null id is its own value, smaller than all others; rows that repeat an id and text count as links
    of one document; other columns are not read; an empty table gives no rows.
    """
    members, classes = _grouped(docs.select(*_identified(id_column, text_column)), size, percent)
    least = classes.groupBy("label").agg(F.min("least.doc").alias("component_id"))
    named = classes.join(least, "label").select("class", "component_id")
    out = members.join(named, "class", "left")
    known = F.when(F.col("doc") != NULL_ID, F.col("doc"))
    group = F.coalesce("component_id", "doc")
    return out.select(known.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(group != NULL_ID, group).alias("component_id"))


def first_of_groups(docs: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` but for all but one of each group of ``similar_groups``: that with the smallest id.

    A null id is smaller than all others; of several texts under the smallest id one stays, and so does one
    of rows that repeat id and text.  Rows are told apart by id and text: an id that other rows share takes
    none of them along.  Texts without words are in no group and all stay.
    """
    members, classes = _grouped(docs.select(*_identified(id_column, text_column)), size, percent)
    first = classes.groupBy("label").agg(F.min("least").alias("first"))
    named = classes.join(first, "label").select("class", "first")
    rows = members.join(named, "class").groupBy("doc", "key", "first").agg(F.count("*").alias("copies"))
    rows = stage(rows.withColumn("kept", F.struct("doc", "key") == F.col("first")).filter("NOT kept OR copies > 1").select("doc", "key", "kept"), "dropped")
    doc, _, key = _identified(id_column, text_column)
    told = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc, key)
    out = told.join(rows.select("doc", "key"), ["doc", "key"], "left_anti").select("row")
    repeated = rows.filter("kept").select("doc", "key")
    if not repeated.isEmpty():
        out = out.unionAll(told.join(repeated, ["doc", "key"]).groupBy("doc", "key").agg(F.min("row").alias("row")).select("row"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def _grouped(texts: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc, key, class, n), and each class with words: (class, least, label), its first row and its group."""
    spark = texts.sparkSession
    scanned = stage(texts.mapInArrow(lambda it: member_batches(it, size), "doc long, key long, class long, n long, bitmap array<long>, block int, counts binary"), "members")
    members = scanned.filter("doc IS NOT NULL").select("doc", "key", "class", "n")
    bitmap = scanned.filter("doc IS NOT NULL").select("class", "bitmap")
    ranks = _rank_table(scanned, spark)
    short = texts.mapInArrow(lambda it: short_list_batches(it, size, percent, ranks), "shingle long, class long, n int, place int")
    ordered = Window.partitionBy("shingle").orderBy("place", "class")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lists = short.select("shingle", "class", "n", F.lag(F.struct("class", "n")).over(ordered).alias("before"),
                         F.first(F.struct("class", "n")).over(whole).alias("head")).filter("before.class != class")
    lists = stage(lists, "lists")
    compared = _pairs(lists.select("class", "n", F.explode(F.array("before", "head")).alias("other"))
                      .select("class", "n", F.col("other.class").alias("other"), F.col("other.n").alias("other_n")), percent).distinct()
    compared = stage(compared, "pairs")
    links = stage(_verified(compared, texts, members, size, percent), "links")

    inside = components(links)
    everyone = lists.select("shingle", "class", "n").unionByName(lists.select("shingle", F.col("head.class").alias("class"), F.col("head.n").alias("n"))).distinct()
    labelled = stage(everyone.join(inside, F.col("class") == F.col("node"), "left").select(
        "shingle", "class", "n", F.coalesce("component", "class").alias("label")), "labelled")
    open_ = labelled.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).filter(
        "low != high AND size > 2").select("shingle")
    rest = labelled.join(stage(open_, "open"), "shingle")
    asked = bitmap.join(rest.select("class").distinct(), "class").groupBy("class").agg(F.first("bitmap").alias("bitmap"))
    rest = stage(rest.join(asked, "class"), "rest")
    other = rest.select("shingle", F.col("class").alias("other"), F.col("n").alias("other_n"), F.col("label").alias("other_label"), F.col("bitmap").alias("other_bitmap"))
    apart = sum((F.bit_count(F.get("bitmap", F.lit(i)).bitwiseXOR(F.get("other_bitmap", F.lit(i)))) for i in range(BITMAP)), F.lit(0))
    met = rest.join(other, "shingle").filter((F.col("class") < F.col("other")) & (F.col("label") != F.col("other_label"))
                                             & ((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("other_n"))))
    found = (_pairs(met, percent).groupBy("a", "b", "need").agg(F.count("*").alias("hits")).filter(F.col("hits") >= F.least(F.lit(SHORT_HITS), "need"))
             .join(compared, ["a", "b"], "left_anti").select("a", "b"))
    more = stage(_verified(stage(found, "pairs"), texts, members, size, percent), "links")
    inside = components(links.unionByName(more))

    classes = members.filter("n > 0").groupBy("class").agg(F.min(F.struct("doc", "key")).alias("least")).join(inside, F.col("class") == F.col("node"), "left")
    return members, stage(classes.select("class", "least", F.coalesce("component", "class").alias("label")), "classes")


def _rank_table(scanned: DataFrame, spark):
    """The count table as ranks, sent to all tasks: 2**TABLE_BITS bytes for any corpus."""
    counts = scanned.filter("block IS NOT NULL").select("block", "counts").repartition("block")
    table = np.zeros(1 << TABLE_BITS, dtype=np.uint8)
    for row in counts.mapInArrow(add_counts, "block int, rank binary").collect():
        table[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.rank, dtype=np.uint8)
    return spark.sparkContext.broadcast(table)


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the overlap, smaller class first, and the overlap that the larger set needs."""
    low, high = F.least("n", "other_n"), F.greatest("n", "other_n")
    return rows.filter((F.col("class") != F.col("other")) & (100 * low >= percent * high)).select(
        F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b"),
        F.ceil(percent * high / 100).alias("need"))


def _verified(pairs: DataFrame, texts: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    pairs = pairs.select("a", "b")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    asked = members.join(asked, "class").groupBy("class").agg(F.min(F.struct("doc", "key")).alias("one")).select("class", "one.*")
    sets = stage(texts.join(asked, ["doc", "key"]).select("doc", "text", "class").mapInArrow(lambda it: set_batches(it, size), "class long, hashes binary"), "sets")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(lambda it: probe_batches(it, percent), "a long, b long").distinct()
