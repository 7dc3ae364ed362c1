"""Substring dedup by prefix-partitioned suffix trees.

Suffixes are split by a prefix (the words of an anchor, extended where an anchor has different
surroundings) into groups that fit a task; each group's suffix tree is built level by level, and its
internal nodes at the depth of a window are the repeats.  See ``repeats`` for how suffixes are dealt.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats

#: Words of the shortest prefix that splits suffixes.
CORE_WORDS = 8


def suffix_tree_nodes(bodies: list[np.ndarray], n: np.ndarray, length: int):
    """Of the suffixes that start at each window: row, offset, and the tree node at depth ``length`` above them.

    A node at depth d is the set of suffixes whose first d words agree.  Nodes of depth 2d are pairs of
    nodes of depth d, so the tree is built in steps that double the depth; node numbers follow the
    lexicographic order of the path labels, leaves under one node are neighbours.
    """
    text = np.concatenate(bodies)
    _, node = np.unique(text, return_inverse=True)
    depth = 1
    while depth < length:
        step = min(depth, length - depth)
        follow = np.full(len(node), 0, dtype=np.int64)
        follow[: len(node) - step] = node[step:]
        _, node = np.unique(node * np.int64(len(text) + 1) + follow, return_inverse=True)
        depth += step
    row = np.repeat(np.arange(len(bodies)), n)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    base = np.cumsum([0] + [len(b) for b in bodies[:-1]])
    return row, offset, node[base[row] + offset]


def drop_repeated_windows(docs: DataFrame, window: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Remove every word inside a run of ``window`` words that also starts in a document with a smaller id.

    Gives the columns of ``docs`` (one named like a result column is replaced), the text reduced to its
    kept words joined by one space, and ``n_words``, ``n_removed`` and ``removed`` (maximal runs of word
    numbers).  A null or empty text has no words and stays an empty text; a null id counts as the
    smallest; rows that share an id do not remove each other's words; an empty table gives no rows.
    """
    finder = partial(repeats.earlier_spans, words=True, length=window, core=min(CORE_WORDS, window), by_document=True, classes=suffix_tree_nodes)
    out = repeats.cut(docs, id_column, text_column, True, finder)
    results = {"n_words": F.col("n"), "n_removed": F.col("n_removed"), "removed": F.col("removed"), text_column: F.col("kept").cast("string")}
    kept = [c for c in docs.columns if c not in results]
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], *[v.alias(c) for c, v in results.items()])
