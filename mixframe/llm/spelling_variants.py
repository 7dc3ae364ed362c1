"""Spelling variants: words of a corpus that are one edit apart, and the form each of them varies.

The vocabulary is counted over all documents.  Two words one edit apart agree before or behind the edit, so
words are dealt into ranges that share a beginning or an end; each range is a sorted list, scanned once with
the banded edit matrices of all its words side by side.  The rows of a matrix belong to a prefix of the list:
neighbours in the list share the rows of their longest common prefix, and where a prefix is more than one edit
from every word that is still open, all words behind that prefix are skipped.

A range with more than ``RANGE_WORDS`` words is cut in two at the middle of what its words do not share, until
one code point is left; such a range holds at most the words over two free code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

# Runs of letters, and the letters that are lower-cased.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A range of more words than this is cut further.  It changes the speed only.
RANGE_WORDS = 1024


def runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", drop_every: int = 199) -> DataFrame:
    """``(word)``: every lower-cased run of letters; one in ``drop_every``, by checksum of id and run, lacks a code point."""
    run = F.translate("run", UPPER, LOWER)
    found = docs.select(F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).alias("id"),
                        F.explode(F.regexp_extract_all(F.col(f"`{text_column}`"), F.lit(f"({RUN})"))).alias("run")).select("id", run.alias("run"))
    if not drop_every:
        return found.select(F.col("run").alias("word"))
    found = found.withColumn("sum", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("sum") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return found.select(F.when(F.col("sum") % drop_every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """``(word, n)`` of the words with so many code points and occurrences."""
    return words.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _ranges(placed: DataFrame) -> DataFrame:
    """The range of each row: what its words share outside of ``[low, high)`` of the shorter word's ``size`` code points."""
    tail = F.col("size") - F.col("high")
    shared = F.concat(F.substring("word", F.lit(1), F.col("low")), F.lit("\0"), F.when(tail > 0, F.expr("right(word, size - high)")).otherwise(""))
    return placed.withColumn("shared", shared)


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice: the first half of its open part is shared, or the second."""
    middle = F.expr("(low + high) div 2").cast("int")
    return rows.withColumn("half", F.explode(F.array(F.struct(middle.alias("low"), F.col("high").alias("high")),
                                                     F.struct(F.col("low").alias("low"), middle.alias("high"))))).select("word", "n", "size", "half.low", "half.high")


def dealt(words: DataFrame, range_words: int = RANGE_WORDS) -> DataFrame:
    """``(word, n, size, low, high, shared)``: the ranges in which words of length ``size`` meet those of ``size`` and ``size + 1``."""
    length = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("size"), F.lit(0).alias("low")).filter("size > 0").withColumn("high", F.col("size"))
    done, key = [], ["size", "low", "high", "shared"]
    rows = _halved(rows.filter("size > 1")).unionByName(rows.filter("size = 1"))
    while True:
        rows = stage(_ranges(rows), "ranges")
        large = stage(rows.groupBy(*key).agg(F.count("*").alias("words")).filter((F.col("words") > range_words) & (F.col("high") - F.col("low") > 1)).drop("words"), "large-ranges")
        if large.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(large, key, "left_anti").select(rows.columns))
        rows = _halved(rows.join(large, key, "left_semi"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _first_place(common: int, size: int, low: int, high: int) -> bool:
    """Whether a pair that agrees on ``common`` leading code points is reported by this range: halves are tried first half first."""
    a, b = 0, size
    while b - a > high - low:
        middle = (a + b) // 2
        a, b = (middle, b) if common >= middle else (a, middle)
    return (a, b) == (low, high)


def scan(words: list[str], shared: int = 0) -> list[tuple[int, int]]:
    """Pairs ``(i, j)``, i < j, of a sorted list of distinct words with exactly one edit between them.

    All words share their first ``shared`` code points.  A row of the edit matrix of a word holds three
    columns, since farther ones are more than one edit away.
    """
    count = len(words)
    common = [shared] * (count + 1)  # with the word before
    for i in range(1, count):
        x, y, k = words[i - 1], words[i], shared
        while k < len(x) and k < len(y) and x[k] == y[k]:
            k += 1
        common[i] = k
    padded = [w + "\0\0\0" for w in words]
    table = _Table(words) if count > FEW_WORDS else None
    found: list[tuple[int, int]] = []
    # rows[k]: the open words and their three columns behind `shared + k` code points of the present word
    rows: list = [[(j, 1 if shared else 2, 0, 1) for j in range(count)] if table is None else table.first(shared)]
    dead = None  # no word is open behind this many code points
    for i, word in enumerate(words):
        if dead is not None and common[i] >= dead:
            continue
        dead = None
        depth = common[i]
        del rows[depth - shared + 1 :]
        own = common[i + 1] if i + 1 < count else shared  # behind this depth no other word of the list follows
        row = rows[-1]
        for d in range(depth, len(word)):
            if not isinstance(row, list):
                row = table.step(row, d, i, i if d >= own else count)
            else:
                row = _step(row, padded, d, word[d], i if d >= own else count)
            rows.append(row)
            if not len(row):
                if d < own:
                    dead = d + 1
                break
        else:
            for j, left, mid, right in row if isinstance(row, list) else table.tuples(row):
                gap = len(words[j]) - len(word)
                if j < i and -1 <= gap <= 1 and (left, mid, right)[gap + 1] == 1:
                    found.append((j, i))
        if len(rows) - 1 + shared > own:
            del rows[own - shared + 1 :]
    return found


#: Rows of so many open words are worked on as lists, longer ones as arrays.  It changes the speed only.
FEW_WORDS = 32


def _step(row: list[tuple], padded: list[str], d: int, c: str, below: int) -> list[tuple]:
    """The next row for the open words before ``below``: one more code point, ``c``, of the list."""
    out = []
    for j, left, mid, right in row:
        if j < below:
            w = padded[j]
            size = len(w) - 1
            left = min(left + (w[d - 1] != c if d <= size else 1) if d else left, mid + 1)
            mid = min(mid + (w[d] != c if d <= size else 1), right + 1, left + 1)
            right = min(right + (w[d + 1] != c if d < size else 1), mid + 1)
            if left <= 1 or mid <= 1 or right <= 1:
                out.append((j, left, mid, right))
    return out


class _Table:
    """Rows of many open words as arrays: word numbers and three columns."""

    def __init__(self, words: list[str]):
        self.letters = np.zeros((len(words), max(map(len, words)) + 3), dtype=np.int32)
        for i, w in enumerate(words):
            self.letters[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), dtype=np.int32)

    def first(self, shared: int) -> np.ndarray:
        count = len(self.letters)
        return np.stack((np.arange(count), np.full(count, 1 if shared else 2), np.zeros(count, np.int64), np.ones(count, np.int64)), axis=1)

    def step(self, row: np.ndarray, d: int, word: int, below: int):
        at, left, mid, right = row[row[:, 0] < below].T
        c, letters = self.letters[word, d], self.letters
        left = np.minimum(left + (letters[at, d - 1] != c) if d else left, mid + 1)
        mid = np.minimum(np.minimum(mid + (letters[at, d] != c), right + 1), left + 1)
        right = np.minimum(right + (letters[at, d + 1] != c), mid + 1)
        out = np.stack((at, left, mid, right), axis=1)[np.minimum(np.minimum(left, mid), right) <= 1]
        return out if len(out) > FEW_WORDS else self.tuples(out)

    @staticmethod
    def tuples(row: np.ndarray) -> list[tuple]:
        return [tuple(r) for r in row.tolist()]


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (size, low, high, shared, turned, n) sorted by range and word: pairs found, in both directions."""
    key, words, counts = None, [], []

    def pairs():
        size, low, high, _ = key
        tail = size - high
        for i, j in scan(words, max(low, tail)) if len(words) > 1 else ():
            x, y = words[i], words[j]
            if min(len(x), len(y)) != size:
                continue
            if tail > low:
                x, y = x[::-1], y[::-1]
            agree = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), size)
            if _first_place(agree, size, low, high):
                yield x, y, counts[j]
                yield y, x, counts[i]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())],
                                          ["word", "near", "near_n"])

    out: list[tuple[str, str, int]] = []
    for batch in batches:
        for *now, turned, n in zip(*(c.to_pylist() for c in batch.columns)):
            if now != key:
                if key is not None:
                    out.extend(pairs())
                key, words, counts = now, [], []
                if len(out) >= 4096:
                    yield table(out)
                    out = []
            words.append(turned)
            counts.append(n)
    if key is not None:
        out.extend(pairs())
    if out:
        yield table(out)


def near_words(words: DataFrame, range_words: int = RANGE_WORDS) -> DataFrame:
    """``(word, near, near_n)``: every ordered pair of the vocabulary ``(word, n)`` with exactly one edit between."""
    key = ["size", "low", "high", "shared"]
    turned = F.when(F.col("size") - F.col("high") > F.col("low"), F.reverse("word")).otherwise(F.col("word"))
    rows = dealt(words, range_words).select(*key, turned.alias("turned"), "n")
    return rows.repartition(*key).sortWithinPartitions(*key, "turned").mapInArrow(_scan_batches, "word string, near string, near_n long")


def _roots(links: DataFrame, most: int, factor: int) -> DataFrame:
    """``(word, root)`` for ``(word, form)``: forms followed to the last, by doubling.

    A form is ``factor`` times as frequent as its word, so a chain is short.
    """
    longest, n = 1, factor
    while n <= most:
        longest, n = longest + 1, n * factor
    steps = links.select("word", F.col("form").alias("root"))
    reach = 1
    while reach < longest:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = stage(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        reach *= 2
    return steps


def variants(words: DataFrame, factor: int = 5, range_words: int = RANGE_WORDS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for a vocabulary ``(word, n)`` of distinct words.

    ``n_near`` counts the words one inserted, deleted or replaced code point away (0 if none); ``form`` is the
    most frequent of them (ties: the smallest in code-point order) if it occurs ``factor`` times as often as the
    word, else null; ``root`` is where forms followed one after the other end, the word itself without a form.
    Null words are left out; an empty vocabulary gives an empty table.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more, or forms could lead in a circle")
    words = stage(words.filter(F.col("word").isNotNull() & (F.col("word") != "")).select("word", "n"), "vocabulary")
    best = near_words(words, range_words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    is_form = -F.col("best.less") >= factor * F.col("n")
    out = stage(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                       F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    most = words.agg(F.max("n")).first()[0] or 0
    roots = _roots(out.filter("form IS NOT NULL").select("word", "form"), most, factor)
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_length: int = 6, least_count: int = 5,
                      factor: int = 5, drop_every: int = 199, range_words: int = RANGE_WORDS) -> DataFrame:
    """The variants of all words in the whole texts of ``docs``; see ``variants`` for the columns.

    A null or empty text has no words; a null id counts as an empty one; rows that are repeated count each
    time; other columns are not read.  Only A to Z are lower-cased.
    """
    return variants(vocabulary(runs(docs, id_column, text_column, drop_every), least_length, least_count), factor, range_words)
