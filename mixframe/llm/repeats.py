"""Passages that occur earlier in a corpus: what the two repeat removers share.

A text is a sequence of units (words or bytes).  Every window of ``length`` units has one *anchor*, the
smallest hash of a ``core``-unit piece inside it (the leftmost of equals), so equal windows have equal
anchors at the same distance.  The windows of one anchor occurrence form a *leaf*.

1. Leaves travel as two hashes and a position.  Anchors that occur once are dropped (a count that is
   combined before the shuffle, then a join whose skew Spark splits).
2. Equal leaves become one, its first occurrence; all later ones are repeats as a whole.
3. What is left are leaves with one anchor and different surroundings.  Their content is read from the
   text, cut in a left and a right half, and keyed by the longest piece that all windows of a half
   share: a longer prefix than the anchor.  Halves alone under their key are dropped, equal ones are
   merged as before.
4. Each key's halves are dealt to tasks (a key with many is dealt in parts) and handed to ``classes``,
   the index of the operator, which tells equal windows apart.  Parts of one key meet once more by a
   hash of the whole window, so that nothing depends on how a key was dealt.

No step looks at a sample or drops a candidate.  A text is named by its ``doc_id`` and a 64-bit hash, so
texts that share an id, or have none, are kept apart; rows with one ``doc_id`` and one text count as one
occurrence.  A null ``doc_id`` orders first, texts under one id by their hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .words import BYTE_CODE, NULL_ID, SpanHash, Words, joined, keys_of, mix, signed, slices

#: Halves that one part of a key may have; a key with more is dealt in several parts.
PART_ROWS = 20_000
#: Units that a task indexes at once.
CHUNK_UNITS = 1 << 20

LEAD_BITS, N_BITS = 11, 11
LEAVES = "a long, b long, doc long, key long, at long"
HALVES = "a long, b long, doc long, key long, at long, body binary"
MARKS = "doc long, key long, begin long, stop long"


def packed(pos, lead, n):
    """Position, distance to the anchor and number of windows in one ordered number."""
    return ((pos << LEAD_BITS) | lead) << N_BITS | n


def unpacked(at):
    n, at = at & ((1 << N_BITS) - 1), at >> N_BITS
    return at >> LEAD_BITS, at & ((1 << LEAD_BITS) - 1), n


def text_keys(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


class Units:
    """A slice of texts as codes; text i has the units ``begin[i]:end[i]``."""

    def __init__(self, texts: list[bytes], words: bool):
        if words:
            self.words = Words(texts)
            self.codes, self.begin, self.end = self.words.code, self.words.first[:-1], self.words.first[1:]
        else:
            self.buffer, start = joined(texts)
            self.codes, self.begin, self.end = BYTE_CODE[self.buffer], start[:-1], start[1:] - 1


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def find_leaves(units: Units, length: int, core: int):
    """(spans, text, start, lead, count, anchor hash) of the leaves of a slice."""
    spans = SpanHash(units.codes)
    windows = np.maximum(0, units.end - units.begin - length + 1)
    n = int(windows.sum())
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return spans, none, none, none, none, none.view(np.uint64)
    piece = spans.fixed(core)
    # 32 bits order the pieces, 32 bits the positions of a slice
    key = (piece & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(piece), dtype=np.uint64)
    least = sliding_least(key, length - core + 1)
    text = np.repeat(np.arange(len(windows)), windows)
    at = np.arange(n) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(units.begin, windows)
    anchor = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.diff(anchor, prepend=-1))
    count = np.diff(head, append=n)
    return spans, text[head], at[head], anchor[head] - at[head], count, piece[anchor[head]]


def leaf_batches(batches: Iterator[pa.RecordBatch], words: bool, length: int, core: int) -> Iterator[pa.RecordBatch]:
    for rows, texts in slices(batches):
        units, doc, name = Units(texts, words), keys_of(rows.column(0)), text_keys(rows.column(2))
        spans, text, start, lead, count, anchor = find_leaves(units, length, core)
        block = mix(spans(start, start + count - 1 + length) ^ ((lead << 12) | count).astype(np.uint64))
        at = packed(start - units.begin[text], lead, count)
        yield pa.RecordBatch.from_arrays([pa.array(signed(anchor)), pa.array(signed(block)), pa.array(doc[text]), pa.array(name[text]), pa.array(at)],
                                         ["a", "b", "doc", "key", "at"])


def half_batches(batches: Iterator[pa.RecordBatch], words: bool, length: int, core: int) -> Iterator[pa.RecordBatch]:
    """From rows (doc, text, key, at list): the two halves of each listed leaf, with their content."""
    reach = (length - core + 1) // 2
    for rows, texts in slices(batches):
        units, doc, name = Units(texts, words), keys_of(rows.column(0)), text_keys(rows.column(2))
        spans = SpanHash(units.codes)
        wanted = rows.column(3)
        at = wanted.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.repeat(np.arange(len(texts)), wanted.value_lengths().to_numpy(zero_copy_only=False))
        pos, lead, n = unpacked(at)
        start = pos + units.begin[text]
        anchor = start + lead
        # windows that begin `reach` or more before the anchor, and the others
        left = np.clip(anchor - reach - start + 1, 0, n)
        for side, first, count, low, high in ((0, start, left, anchor - reach, anchor + core),
                                              (1, start + left, n - left, anchor, anchor - reach + 1 + length)):
            some = np.flatnonzero(count > 0)
            if not len(some):
                continue
            t, first, count, low, high = text[some], first[some], count[some], low[some], high[some]
            stop = first + count - 1 + length
            key = mix(spans(low, high) + np.uint64(side))
            body = mix(spans(first, stop) ^ ((anchor[some] - first) << 12 | count).astype(np.uint64))
            packed_at = packed(first - units.begin[t], anchor[some] - first, count)
            source = units.codes if words else units.buffer
            content = [source[i:j].tobytes() for i, j in zip(first.tolist(), stop.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(signed(body)), pa.array(doc[t]), pa.array(name[t]), pa.array(packed_at), pa.array(content, pa.binary())],
                                             ["a", "b", "doc", "key", "at", "body"])


def runs(row: np.ndarray, pos: np.ndarray, length: int):
    """Window starts, ascending in each row, to (row, begin, stop) of what they cover."""
    if not len(row):
        return row, pos, pos
    head = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (pos[1:] > pos[:-1] + length))))
    last = np.concatenate((head[1:], [len(row)])) - 1
    return row[head], pos[head], pos[last] + length


def index_batches(batches: Iterator[pa.RecordBatch], words: bool, length: int, by_document: bool, classes: Callable) -> Iterator[pa.RecordBatch]:
    """Index the halves of each part of a key; rows come sorted by key, part and order of occurrence.

    Yields the spans that occur earlier in the part, and for keys in several parts the first occurrence
    of each window (``node`` is set).
    """
    def flush(rows):
        doc, name, at, body, parts = rows
        doc, name, at = (np.array(x, dtype=np.int64) for x in (doc, name, at))
        order = np.lexsort((at, name, doc))  # parts of one key may meet here
        doc, name, at, parts = doc[order], name[order], at[order], np.array(parts)[order]
        pos, lead, n = unpacked(at)
        source = [np.frombuffer(body[i], dtype=np.uint64 if words else np.uint8) for i in order]
        row, offset, kind = classes(source, n, length)
        # the first occurrence of each class
        _, first, inverse = np.unique(kind, return_index=True, return_inverse=True)
        first = first[inverse]
        later = doc[row[first]] < doc[row] if by_document else (np.arange(len(row)) != first) & (
            (doc[row[first]] != doc[row]) | (pos[row[first]] + offset[first] != pos[row] + offset) | (name[row[first]] != name[row]))
        r, begin, stop = runs(row[later], offset[later], length)
        yield batch(doc[r], name[r], pos[r] + begin, pos[r] + stop, np.zeros(len(r), np.int64), np.zeros(len(r), bool))
        several = parts[row] > 1
        if several.any():
            mine = np.flatnonzero(several & ~later)
            whole = np.concatenate(source)
            base = np.cumsum([0] + [len(x) for x in source[:-1]])[row[mine]] + offset[mine]
            node = SpanHash(whole if words else BYTE_CODE[whole])(base, base + length)
            begin = pos[row[mine]] + offset[mine]
            yield batch(doc[row[mine]], name[row[mine]], begin, begin + length, signed(node), np.ones(len(mine), bool))

    def batch(doc, name, begin, stop, node, open_):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(name), pa.array(begin), pa.array(stop), pa.array(node), pa.array(open_)],
                                          ["doc", "key", "begin", "stop", "node", "open"])

    held, size, key = ([], [], [], [], []), 0, None
    for rows in batches:
        for a, part, parts, doc, name, at, body in zip(*(rows.column(i).to_pylist() for i in range(7))):
            if size > CHUNK_UNITS and (a, part) != key:
                yield from flush(held)
                held, size = ([], [], [], [], []), 0
            key = (a, part)
            for column, value in zip(held, (doc, name, at, body, parts)):
                column.append(value)
            size += len(body) // (8 if words else 1)
    if held[0]:
        yield from flush(held)


def earlier_spans(docs: DataFrame, words: bool, length: int, core: int, by_document: bool, classes: Callable) -> DataFrame:
    """``(doc, key, spans)``: what of each text occurs earlier, in units.

    ``docs`` has the columns doc, text and key, a hash of the text.  ``by_document``: only smaller documents count as earlier.
    ``classes(bodies, n, length)`` gets sequences with ``n`` windows each and returns row, offset and class
    of every window, rows ascending.
    """
    def leaves():
        return docs.mapInArrow(lambda it: leaf_batches(it, words, length, core), LEAVES)

    # a table of its own, so that Spark can split a hot anchor in the join
    known = stage(leaves().groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a"), "anchors")
    found = stage(leaves().join(known, "a"), "leaves")
    whole, single = _equal_ones(found, length, by_document)
    wanted = stage(single.select("doc", "key", "at").groupBy("doc", "key").agg(F.collect_set("at").alias("ats")), "wanted")
    halves = docs.join(wanted, ["doc", "key"]).select("doc", "text", "key", "ats").mapInArrow(lambda it: half_batches(it, words, length, core), HALVES)
    halves = stage(halves, "halves")
    known = stage(halves.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a"), "prefixes")
    halves = halves.join(known, "a")
    same, single = _equal_ones(halves.drop("body"), length, by_document)
    size = single.groupBy("a").agg(F.count("*").alias("size"))
    dealt = (single.join(size, "a").withColumn("parts", F.ceil(F.col("size") / PART_ROWS))
             .withColumn("part", F.pmod(F.xxhash64("doc", "key", "at"), F.col("parts"))))
    dealt = (dealt.join(halves.select("a", "doc", "key", "at", "body"), ["a", "doc", "key", "at"]).select("a", "part", "parts", "doc", "key", "at", "body")
             .repartition("a", "part").sortWithinPartitions("a", "part", "doc", "key", "at"))
    indexed = stage(dealt.mapInArrow(lambda it: index_batches(it, words, length, by_document, classes), MARKS + ", node long, open boolean"), "indexed")
    met = indexed.filter("open")
    least = met.groupBy("node").agg(F.min("doc").alias("doc0"), F.min(F.struct("doc", "key", "begin")).alias("first"))
    met = met.join(least, "node").filter("doc > doc0" if by_document else "struct(doc, key, begin) > first")
    marks = whole.unionByName(same).unionByName(indexed.filter("NOT open").select("doc", "key", "begin", "stop")).unionByName(
        met.select("doc", "key", "begin", "stop"))
    return marks.groupBy("doc", "key").agg(F.collect_set(F.struct("begin", "stop")).alias("spans"))


def _equal_ones(rows: DataFrame, length: int, by_document: bool) -> tuple[DataFrame, DataFrame]:
    """Merge rows with equal content (``b``): the spans of the later ones, and the first ones of keys with several contents."""
    firsts = stage(rows.groupBy("a", "b").agg(F.min(F.struct("doc", "key", "at")).alias("first")), "firsts")
    many = firsts.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a")
    single = firsts.join(many, "a")
    if by_document:  # equal ones inside the first document do not settle each other
        single = rows.join(single, ["a", "b"]).filter("doc = first.doc").select("a", "b", "doc", "key", "at")
    else:
        single = single.select("a", "b", "first.doc", "first.key", "first.at")
    later = rows.join(firsts, ["a", "b"]).filter("doc > first.doc" if by_document else "struct(doc, key, at) > first")
    begin = F.shiftright("at", N_BITS + LEAD_BITS)
    return later.select("doc", "key", begin.alias("begin"), (begin + F.col("at").bitwiseAND((1 << N_BITS) - 1) - 1 + length).alias("stop")), single


def covered(spans, size: int) -> np.ndarray:
    """Marks of the units of a text that its spans cover."""
    edge = np.zeros(size + 1, dtype=np.int64)
    for span in spans or ():
        edge[span["begin"]] += 1
        edge[span["stop"]] -= 1
    return np.cumsum(edge[:-1]) > 0


CUT = "n long, n_removed long, removed array<struct<begin: long, stop: long>>, kept binary, readable string"


def readable(raw: bytes) -> str | None:
    """The text without the bytes of characters that are cut in two; None if there are none of these."""
    try:
        raw.decode()
        return None
    except UnicodeDecodeError:
        return raw.decode(errors="ignore")


def cut_batches(batches: Iterator[pa.RecordBatch], words: bool) -> Iterator[pa.RecordBatch]:
    """From rows (spans, text, row): sizes, maximal removed runs in units, and what is left."""
    for rows, texts in slices(batches):
        units, marks = Units(texts, words), rows.column(0).to_pylist()
        out: list[list] = [[], [], [], [], []]
        for i, text in enumerate(texts):
            size = int(units.end[i] - units.begin[i])
            gone = covered(marks[i], size)
            edge = np.flatnonzero(np.diff(gone, prepend=False, append=False))
            if not words:
                kept = units.buffer[units.begin[i] : units.end[i]][~gone].tobytes() if len(edge) else text
            else:
                at = np.flatnonzero(~gone) + units.begin[i]
                kept = b" ".join([units.words.buffer[x:y].tobytes() for x, y in zip(units.words.start[at].tolist(), units.words.end[at].tolist())])
            for column, value in zip(out, (size, int(gone.sum()), [{"begin": int(x), "stop": int(y)} for x, y in edge.reshape(-1, 2)], kept, readable(kept) if len(edge) else None)):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())])), pa.binary(), pa.string())
        yield pa.RecordBatch.from_arrays([rows.column(2), *(pa.array(x, t) for x, t in zip(out, kinds))], ["row", "n", "n_removed", "removed", "kept", "readable"])


def cut(docs: DataFrame, id_column: str, text_column: str, words: bool, finder: Callable) -> DataFrame:
    """``row`` (the other columns of ``docs``) with size, removed runs and what is kept, for every row."""
    doc, text = F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("doc"), F.col(text_column).alias("text")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_column]).alias("row")
    key = F.xxhash64(F.col(text_column)).alias("key")
    spans = finder(docs.select(doc, text, key))
    marked = docs.select(doc, text, row, key).join(spans, ["doc", "key"], "left").select("spans", "text", "row")
    return marked.mapInArrow(lambda it: cut_batches(it, words), f"row {marked.schema['row'].dataType.simpleString()}, {CUT}")
