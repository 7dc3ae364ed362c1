"""Words and hashes of a batch of texts, as numpy arrays over one concatenated buffer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A word is a run of bytes outside these (space and the five ASCII control spaces).
SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)

#: Documents are worked on in slices of about this many bytes; a longer document is a slice of its own.
SLICE_BYTES = 1 << 19

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ODD = [int(x) * 2 + 1 for x in _rng.integers(1 << 60, 1 << 62, 8)]
MASK = (1 << 64) - 1

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = max(n, 1 << 12)
        table = np.full(size, base & MASK, dtype=np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHash:
    """Hashes of any span of a sequence of 64-bit codes, in constant time each."""

    BASE = ODD[0]

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(codes * powers(self.BASE, n), out=self.total[1:])
        self.inverse = powers(pow(self.BASE, -1, 1 << 64), n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.inverse[start])

    def fixed(self, k: int) -> np.ndarray:
        """Of the span of ``k`` from every position on."""
        n = len(self.total) - k
        return mix((self.total[k:] - self.total[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one buffer with one line feed behind each; the start of each, and the end."""
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8), starts


class Words:
    """The words of a slice: ``start``, ``end`` in the buffer, ``code`` (a hash), ``first[i]:first[i+1]`` of text i."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        buffer, self.text_start = joined(texts)
        self.buffer = LOWER[buffer] if lower else buffer
        space = IS_SPACE[buffer]
        edge = np.diff(space.astype(np.int8), prepend=1)
        self.start = np.flatnonzero(edge == -1)
        self.end = np.flatnonzero(edge == 1)
        if len(self.end) and self.end[0] == 0:
            self.end = self.end[1:]
        self.first = np.searchsorted(self.start, self.text_start)
        if len(self.start):
            within = np.arange(len(buffer)) - np.repeat(
                np.concatenate(([0], self.start[1:])), np.diff(np.concatenate((self.start[:1] * 0, self.start[1:], [len(buffer)]))))
            within[: self.start[0]] = 0
            weight = powers(ODD[1], int(within.max()) + 1)[within]
            value = np.where(space, np.uint64(0), BYTE_CODE[self.buffer] * weight)
            self.code = mix(np.add.reduceat(value, self.start))
        else:
            self.code = np.zeros(0, np.uint64)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted: hashes, and the offsets of the texts.

    A text with fewer than ``size`` words has its whole sequence as its one shingle, without words none.
    """
    n, first = len(words.code), words.first
    total = np.zeros(max(0, n - size + 1), dtype=np.uint64)
    for j in range(size):
        total += words.code[j : n - size + 1 + j] * np.uint64(ODD[2 + j % 6] + 2 * (j // 6)) if n >= size else 0
    total = mix(total)
    count = np.diff(first)
    owner = np.repeat(np.arange(len(count)), np.maximum(0, count - size + 1))
    at = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(0, count - size + 1)) - np.maximum(0, count - size + 1), np.maximum(0, count - size + 1))
    hashes = total[first[:-1][owner] + at]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = [int(mix(np.array([(sum((int(words.code[first[i] + j]) * ODD[2 + j % 6]) for j in range(count[i])) + int(count[i])) & MASK], dtype=np.uint64))[0]) for i in short]
        owner, hashes = np.concatenate((owner, short)), np.concatenate((hashes, np.array(extra, dtype=np.uint64)))
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    keep = np.ones(len(owner), dtype=bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    owner, hashes = owner[keep], hashes[keep]
    return hashes, np.searchsorted(owner, np.arange(len(count) + 1))


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows of about ``limit`` bytes of text, with their texts; a null text is empty."""
    for batch in batches:
        column = batch.column(text)
        column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        begin, size, found = 0, 0, []
        for i, value in enumerate(column):
            raw = value.as_py() or b""
            if found and size + len(raw) > limit:
                yield batch.slice(begin, i - begin), found
                begin, size, found = i, 0, []
            found.append(raw)
            size += len(raw) + 1
        if found:
            yield batch.slice(begin, batch.num_rows - begin), found


def beside_text(docs: DataFrame, text_column: str, *more: Column) -> DataFrame:
    """(row, text, ...): the other columns in one, so that each value travels once and no name can clash."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_column]
    return docs.select(F.struct(F.lit(True).alias("__row"), *others).alias("row"), F.col(f"`{text_column}`").alias("text"), *more)


def from_row(docs: DataFrame, text_column: str, without: list[str]) -> list[Column]:
    """The columns of ``docs`` again, but for those a result replaces."""
    return [F.col("text").alias(c) if c == text_column else F.col("row").getField(c).alias(c) for c in docs.columns if c not in without]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def keys_of(column: pa.Array) -> np.ndarray:
    """Ids as int64; a null id comes as the smallest integer."""
    return column.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


#: Stands for a null id inside the jobs.
NULL_ID = -(1 << 63)
