"""Benchmark decontamination by pigeonhole edit matching over words.

A test item of n words may differ by e words (a share of n).  Cut in e + 1 pieces, at least one piece
of every match is unchanged; pieces are found by hash, at every word of every document.  Around each
such hit Myers' bit-parallel algorithm gives the distance of the item to the best-fitting part of the
text.

An item in a script without spaces (Chinese, Japanese, Thai and their neighbours) is also searched by its
characters, white space left out, in the same way.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import NULL_ID, SpanHash, Words, beside_text, from_row, keys_of, mix, slices

#: Share of an item's words that may be inserted, deleted or replaced.
EDIT_SHARE = 0.2
#: Items that have both fewer words and fewer characters (white space not counted) identify nothing and are left out.
LEAST_WORDS, LEAST_CHARS = 5, 16
# Scripts that do not part words by spaces (Thai to Myanmar, Khmer, kana, Han, the wide planes of Han),
# and white space (that of words, and the space of these scripts).
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
BLANK = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x3000)
#: Text of test items that tasks hold at once; more items are searched in several passes.
ITEM_BYTES = 32 << 20


class Chars:
    """The characters of a slice without white space, A-Z in lower case: ``code``, and ``first[i]:first[i+1]`` of text i."""

    def __init__(self, texts: list[bytes]):
        points = [np.frombuffer(t.decode(errors="replace").encode("utf-32-le"), dtype=np.uint32) for t in texts]
        first = np.cumsum([0] + [len(p) for p in points])
        point = np.concatenate(points) if points else np.zeros(0, np.uint32)
        blank = np.isin(point, BLANK)
        at = np.concatenate(([0], np.cumsum(~blank)))
        self.first = at[first]
        # words that have begun up to each character of a text
        space = np.isin(point, BLANK[:6])
        begins = ~space & np.concatenate(([True], space[:-1]))[: len(space)]
        begins[first[:-1][first[:-1] < len(point)]] = ~space[first[:-1][first[:-1] < len(point)]]
        total = np.concatenate(([0], np.cumsum(begins)))
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        self.word = (total[1:] - total[first[:-1]][owner])[~blank]
        point = point[~blank].astype(np.uint64)
        self.code = mix(np.where((point >= 65) & (point <= 90), point + np.uint64(32), point) + np.uint64(1))


class Items:
    """Test items cut in pieces; by piece length: sorted hashes, and item and position of each.

    ``chars`` holds the items that are searched by characters, None if there are none.
    """

    def __init__(self, rows: list[tuple[int, bytes]], share: float, by_chars: bool = False):
        self.by_chars, self.skipped, self.chars = by_chars, [], None
        units = Chars([text for _, text in rows]) if by_chars else Words([text for _, text in rows], lower=True)
        spans, self.ids, self.words, self.errors = SpanHash(units.code), [], [], []
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        unspaced = []
        for i, (name, raw) in enumerate(rows):
            begin, n = int(units.first[i]), int(units.first[i + 1] - units.first[i])
            if not by_chars:
                text = raw.decode()
                if n < LEAST_WORDS and sum(ord(c) not in BLANK for c in text) < LEAST_CHARS:
                    self.skipped.append(name)
                    continue
                if UNSPACED.search(text):
                    unspaced.append((name, raw))
            errors = int(share * n)
            cuts = [n * j // (errors + 1) for j in range(errors + 2)]
            for a, b in zip(cuts, cuts[1:]):
                code = int(spans(np.array([begin + a]), np.array([begin + b]))[0])
                pieces.setdefault(b - a, []).append((code, len(self.ids), a))
            self.ids.append(name)
            self.words.append(units.code[begin : begin + n])
            self.errors.append(errors)
        self.pieces = {}
        for size, found in pieces.items():
            found.sort()
            code = np.array([c for c, _, _ in found], dtype=np.uint64)
            seen = np.zeros(1 << 16, dtype=bool)
            seen[(code & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.pieces[size] = (code, np.array([i for _, i, _ in found]), np.array([a for _, _, a in found]), seen)
        if unspaced:
            self.chars = Items(unspaced, share, by_chars=True)


def myers(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to a part of ``text``, and where that part ends (the first such)."""
    where: dict[int, int] = {}
    for i, code in enumerate(pattern.tolist()):
        where[code] = where.get(code, 0) | 1 << i
    n = len(pattern)
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best, end = full, 0, n, n, 0
    for j, code in enumerate(text.tolist()):
        equal = where.get(code, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | ~(horizontal | plus) & full, plus & horizontal
        score += 1 if up & top else -1 if down & top else 0
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(vertical | up) & full, up & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


def best_matches(texts: list[bytes], items: Items) -> dict[tuple[int, int], tuple[int, int]]:
    """By text and item id of a slice: distance and last word of the best match; by words if there is one."""
    words, best = Chars(texts) if items.by_chars else Words(texts, lower=True), {}
    spans, tried = SpanHash(words.code), set()
    for size, (codes, item, place, seen) in items.pieces.items():
        here = spans.fixed(size)
        near = np.flatnonzero(seen[(here & np.uint64(0xFFFF)).astype(np.int64)])
        low, high = np.searchsorted(codes, here[near], "left"), np.searchsorted(codes, here[near], "right")
        hit = np.flatnonzero(high > low)
        text = np.searchsorted(words.first, near[hit], "right") - 1
        for at, t, a, b in zip(near[hit].tolist(), text.tolist(), low[hit].tolist(), high[hit].tolist()):
            tried.update((int(item[k]), t, at - int(place[k])) for k in range(a, b))
    for i, t, start in tried:
        errors, n, first = items.errors[i], len(items.words[i]), int(words.first[t])
        begin, stop = max(first, start - errors), min(int(words.first[t + 1]), start + n + errors)
        distance, end = myers(items.words[i], words.code[begin:stop])
        if distance <= errors:
            last = int(words.word[begin + end - 1]) if items.by_chars else begin + end - first
            name = t, items.ids[i]
            best[name] = min(best.get(name, (distance, last)), (distance, last))
    if items.chars:
        best = best_matches(texts, items.chars) | best
    return best


def match_batches(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    """Rows (doc, item, distance, stop): the best match of each item in each text."""
    for rows, texts in slices(batches):
        doc, found = keys_of(rows.column(0)), sorted(best_matches(texts, items).items())
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[[t for (t, _), _ in found]] if found else [], pa.int64()), pa.array([i for (_, i), _ in found], pa.int64()),
             pa.array([d for _, (d, _) in found], pa.int32()), pa.array([e for _, (_, e) in found], pa.int64())], ["doc", "item", "distance", "stop"])


def clean_batches(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    """The rows (row, text) whose text holds no item."""
    for rows, texts in slices(batches):
        clean = np.ones(len(texts), dtype=bool)
        clean[[t for t, _ in best_matches(texts, items)]] = False
        yield rows.filter(pa.array(clean))


def held_items(items: DataFrame, share: float, item_column: str, item_text: str) -> Iterator[Items]:
    """The test items cut in pieces: once, unless they are many; then in passes of bounded size."""
    asked = items.select(F.coalesce(F.col(item_column).cast("long"), F.lit(NULL_ID)).alias("item"), F.col(item_text).alias("text")).filter("text IS NOT NULL")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = 1 + int(size) // ITEM_BYTES
    for i in range(passes):
        mine = asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == i).distinct().collect()
        held = Items([(r.item, r.text.encode()) for r in mine], share)
        if held.skipped:
            logging.getLogger(__name__).warning("test items too short to identify a text: %s",
                                                sorted(("null" if i == NULL_ID else str(i)) for i in held.skipped))
        yield held


def without_matches(docs: DataFrame, items: DataFrame, share: float = EDIT_SHARE, text_column: str = "text",
                    item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no test item, each judged by itself, whatever its id."""
    clean = beside_text(docs, text_column)
    schema = clean.schema
    for held in held_items(items, share, item_column, item_text):
        clean = clean.mapInArrow(lambda it, held=held: clean_batches(it, held), schema)
    return clean.select(*from_row(docs, text_column, []))


def benchmark_matches(docs: DataFrame, items: DataFrame, share: float = EDIT_SHARE, id_column: str = "doc_id", text_column: str = "text",
                      item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, distance, stop_word)`` for every document that holds a test item.

    Words are compared with A-Z in lower case.  ``distance`` is the least number of words to insert,
    delete or replace, at most ``share`` of the item's words; ``stop_word`` is where the first best match
    ends.  An item in a script without spaces that is not found by words is sought by characters; its
    ``distance`` is then in characters, and ``stop_word`` the word its match ends in.  Items with fewer than
    LEAST_WORDS words and fewer than LEAST_CHARS characters match nothing, and the log names them; neither do null texts; repeated rows are found
    alike and given once; null ids stay null; an empty table on either side gives no rows.
    """
    texts = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("doc"), F.col(text_column).alias("text"))
    found = None
    for held in held_items(items, share, item_column, item_text):
        part = texts.mapInArrow(lambda it, held=held: match_batches(it, held), "doc long, item long, distance int, stop long")
        found = part if found is None else found.unionAll(part)
    best = found.groupBy("doc", "item").agg(F.min(F.struct("distance", "stop")).alias("best"))
    known = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return best.select(known("doc").alias("doc_id"), known("item").alias("item_id"), "best.distance", F.col("best.stop").alias("stop_word"))
