"""Suffix-array dedup with a run-length index.

Per group of texts that share a core (see ``repeats``), a run-compressed Burrows-Wheeler transform is
built.  Of it only the run borders are kept: for the first suffix of each run its text position, the
position of the suffix before it (the end of the run before) and how far the two agree.  Streaming over
the text, the matching statistics of all other positions follow from these samples: inside a run one
step further in the text matches one unit less, one unit further on.  Matches of the asked length link
a position to an equal one; along the links every long match finds the first occurrence.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats

#: Bytes of the shortest piece by which occurrences are brought together.
CORE_BYTES = 24


def suffix_array(symbols: np.ndarray, longest: int) -> np.ndarray:
    """Start positions in lexicographic order; 0 ends a row, and equal rests are ordered by position.

    Ranks by the first 7 symbols, then by twice as many in each round.
    """
    n = len(symbols)
    padded = np.concatenate((symbols, np.zeros(8, symbols.dtype))).astype(np.uint64)
    key, open_ = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    for j in range(7):
        here = np.where(open_, padded[j : n + j], np.uint64(0))
        key = (key << np.uint64(9)) | here
        open_ &= here > 0
    depth = 7
    while True:
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1]))).astype(np.uint64)
        if depth > longest:
            return order
        ends = np.flatnonzero(symbols == 0)
        rest = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)
        follow = np.zeros(n, dtype=np.uint64)
        longer = np.flatnonzero(rest >= depth)
        follow[longer] = rank[longer + depth] + np.uint64(1)
        key = (rank << np.uint64(32)) | follow
        depth *= 2


def agreement(symbols: np.ndarray, x: np.ndarray, y: np.ndarray, step: int = 16) -> np.ndarray:
    """How many units agree from positions x and y on, up to the end of a row."""
    padded = np.concatenate((symbols, np.zeros(step, symbols.dtype)))
    found, live, reach = np.zeros(len(x), dtype=np.int64), np.arange(len(x)), np.arange(step)
    while len(live):
        a, b = padded[(x[live] + found[live])[:, None] + reach], padded[(y[live] + found[live])[:, None] + reach]
        equal = (a == b) & (a > 0)
        run = np.where(equal.all(axis=1), step, equal.argmin(axis=1))
        found[live] += run
        live = live[run == step]
    return found


def run_length_samples(symbols: np.ndarray, longest: int):
    """Of the run heads of the transform, by text position: position, the suffix before it, their agreement."""
    order = suffix_array(symbols, longest)
    before = np.concatenate(([0], symbols[:-1]))[order]  # the transform
    head = np.flatnonzero(np.concatenate(([True], (before[1:] != before[:-1]) | (before[1:] == 0))))
    position, previous = order[head], order[np.maximum(head - 1, 0)]
    match = agreement(symbols, position, previous)
    match[0] = 0  # the very first suffix has none before it
    by_text = np.argsort(position)
    return position[by_text], previous[by_text], match[by_text]


def long_match_classes(bodies: list[np.ndarray], n: np.ndarray, length: int):
    """Row, offset and class of every window: windows are in one class if their content is equal."""
    sizes = np.array([len(b) for b in bodies])
    symbols = np.zeros(int(sizes.sum()) + len(bodies), dtype=np.uint16)
    base = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    inside = np.ones(len(symbols), dtype=bool)
    inside[base + sizes] = False
    symbols[inside] = np.concatenate(bodies).astype(np.uint16) + 1
    position, previous, match = run_length_samples(symbols, int(sizes.max()))
    # stream: the sample at or before each position gives its matching statistics
    at = np.arange(len(symbols))
    sample = np.searchsorted(position, at, "right") - 1
    gone = at - position[sample]
    link = np.where(match[sample] - gone >= length, previous[sample] + gone, at)
    while True:
        further = link[link]
        if (further == link).all():
            break
        link = further
    row = np.repeat(np.arange(len(bodies)), n)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, offset, link[base[row] + offset]


def drop_repeated_bytes(docs: DataFrame, length: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Remove every byte inside a string of ``length`` bytes that also starts earlier in the corpus.

    Earlier means a smaller id, or the same document and an earlier start.  Gives the columns of
    ``docs`` (one named like a result column is replaced), ``n_bytes``, ``n_removed``, ``removed``
    (maximal runs), ``kept`` (the remaining bytes) and the text made of them; bytes of a character that
    a run cuts in two stay in ``kept`` but not in the text.  A null text has no bytes; a null id counts
    as the smallest; rows with one id and one text are one document; an empty table gives no rows.
    """
    finder = partial(repeats.earlier_spans, words=False, length=length, core=min(CORE_BYTES, length), by_document=False, classes=long_match_classes)
    out = repeats.cut(docs, id_column, text_column, False, finder)
    text = F.coalesce("readable", F.col("kept").cast("string"))
    results = {"n_bytes": F.col("n"), "n_removed": F.col("n_removed"), "removed": F.col("removed"), "kept": F.col("kept"), text_column: text}
    kept = [c for c in docs.columns if c not in results]
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], *[v.alias(c) for c, v in results.items()])
