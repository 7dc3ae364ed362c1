"""Text quality by positive-unlabelled learning.

Only trusted good texts and unlabelled web text are used.  The share of good texts in the unlabelled ones (the
class prior) is estimated from a first classifier of trusted against unlabelled texts: above a score that nearly
every trusted text reaches, the ratio of the two shares bounds the prior, and the tightest such ratio is taken.
A logistic model then minimises the non-negative unbiased risk: the unlabelled texts count as bad, less what the
good ones among them add, and that difference is kept from falling below zero.

Features are the shape of a text, not its subject: shares of character classes and marks, word lengths,
capitals, repeated words, word pairs and lines, and hashed shapes of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import bounded_sample
from .words import ODD, Words, beside_text, from_row, mix, powers, slices

#: The model is fitted on at most so many trusted and so many unlabelled texts.
FIT_ROWS = 4_000
#: Hashed shapes of words.
SHAPES = 256

# Character classes of bytes: other, space, line feed, upper, lower, digit, beyond ASCII; marks have a class each.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CLASS = np.zeros(256, dtype=np.int64)
CLASS[[9, 11, 12, 13, 32]], CLASS[10] = 1, 2
CLASS[65:91], CLASS[97:123], CLASS[48:58], CLASS[128:] = 3, 4, 5, 6
CLASS[list(MARKS)] = np.arange(7, 7 + len(MARKS))
CLASSES = 7 + len(MARKS)
#: Features: classes, shapes, and eleven figures of words and lines.
WIDTH = CLASSES + SHAPES + 11


def _distinct(owner: np.ndarray, code: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text: different values, and how often the most frequent one occurs."""
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])))) if len(owner) else np.zeros(0, np.int64)
    most = np.zeros(texts)
    np.maximum.at(most, owner[first], np.diff(first, append=len(owner)))
    return np.bincount(owner[first], minlength=texts), most


def features(texts: list[bytes]) -> np.ndarray:
    """One row per text; the row of a text without words is zero."""
    words, n = Words(texts), len(texts)
    size = np.diff(words.first)
    out = np.zeros((n, WIDTH), dtype=np.float32)
    kind = CLASS[words.buffer]
    owner = np.repeat(np.arange(n), np.diff(words.text_start))
    inside = np.ones(len(kind), dtype=bool)
    inside[words.text_start[1:] - 1] = False  # the line feed behind each text
    length = np.maximum(1, np.diff(words.text_start) - 1)
    shares = np.bincount(owner[inside] * CLASSES + kind[inside], minlength=n * CLASSES).reshape(n, CLASSES) / length[:, None]
    out[:, :CLASSES] = np.sqrt(shares)
    if not len(words.start):
        out[:] = 0
        return out
    # the shape of a word: its classes one after the other, runs counted once
    change = np.ones(len(kind), dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    change[words.start] = True
    rank = np.cumsum(change)
    step = rank - rank[np.repeat(words.start, np.diff(np.append(words.start, len(kind))))] if words.start[0] == 0 else None
    if step is None:
        lead = int(words.start[0])
        step = np.concatenate((np.zeros(lead, np.int64), rank[lead:] - rank[np.repeat(words.start, np.diff(np.append(words.start, len(kind))))]))
    space = (kind == 1) | (kind == 2)
    value = np.where(change & ~space, (kind + 1).astype(np.uint64) * powers(ODD[3], int(step.max()) + 1)[step], np.uint64(0))
    shape = (mix(np.add.reduceat(value, words.start)) >> np.uint64(64 - 8)).astype(np.int64) % SHAPES
    of = np.repeat(np.arange(n), size)
    count = np.maximum(1, size)
    out[:, CLASSES : CLASSES + SHAPES] = np.sqrt(np.bincount(of * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES) / count[:, None])
    wide = (words.end - words.start).astype(float)
    mean = np.bincount(of, wide, n) / count
    spread = np.sqrt(np.maximum(0, np.bincount(of, wide * wide, n) / count - mean * mean))
    head, tail = kind[words.start], kind[words.end - 1]
    upper = np.concatenate(([0], np.cumsum(kind == 3)))
    capitals = (upper[words.end] - upper[words.start]) * 2 > words.end - words.start
    different, most = _distinct(of, words.code, n)
    second = np.ones(len(of), dtype=bool)  # words with one before them in their text
    second[words.first[:-1][size > 0]] = False
    at = np.flatnonzero(second)
    pairs, _ = _distinct(of[at], mix(words.code[at - 1] + mix(words.code[at])), n)
    again = np.bincount(of[at], words.code[at] == words.code[at - 1], n)
    # lines by the sum of their words' codes, which the order within the line does not change
    line = np.cumsum(kind == 2)[words.start]
    first_of_line = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    lines = np.bincount(of[first_of_line], minlength=n)
    other_lines, _ = _distinct(of[first_of_line], np.add.reduceat(words.code, first_of_line), n)
    out[:, CLASSES + SHAPES :] = np.column_stack((
        np.log1p(size), mean, spread, np.bincount(of, head == 3, n) / count, np.bincount(of, capitals, n) / count, np.bincount(of, tail > 6, n) / count,
        different / count, most / count, again / count, pairs / count, other_lines / np.maximum(1, lines)))
    out[size == 0] = 0
    return out


@dataclass
class Model:
    prior: float
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the constant

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(((x - self.centre) / self.scale) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _descend(good: np.ndarray, web: np.ndarray, gradient, rounds: int = 40, batch: int = 256, rate: float = 0.02, decay: float = 1e-3, seed: int = 5) -> np.ndarray:
    """Weights by Adam over batches of both kinds; ``gradient(score of good, score of web)`` gives the slopes by score."""
    rng = np.random.default_rng(seed)
    w = np.zeros(good.shape[1] + 1)
    first, second, t = np.zeros_like(w), np.zeros_like(w), 0
    steps = max(1, max(len(good), len(web)) // batch)
    for turn in range(rounds):
        a, b = rng.permutation(len(good)), rng.permutation(len(web))
        for s in range(steps):
            x, u = good[a[np.arange(s * batch, (s + 1) * batch) % len(a)]], web[b[np.arange(s * batch, (s + 1) * batch) % len(b)]]
            g_x, g_u = gradient(x @ w[:-1] + w[-1], u @ w[:-1] + w[-1])
            g = np.append(x.T @ g_x + u.T @ g_u + decay * w[:-1], g_x.sum() + g_u.sum())
            t += 1
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            w -= rate * (1 - turn / rounds) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimated_prior(good: np.ndarray, web: np.ndarray, doubt: float = 0.1) -> float:
    """The share of good ones among ``web`` by the best bin of scores that were not fitted on.

    For every score, (share of web above) / (share of good above) is at least the prior; the bound that is
    smallest after an allowance for the size of the samples is taken.
    """
    def trusted_against_web(x, u):
        return -(1 - _logistic(x)) / len(x), _logistic(u) / len(u)

    parts = []
    for side in (0, 1):
        w = _descend(good[side::2], web[side::2], trusted_against_web, rounds=15)
        x, u = np.sort(good[1 - side :: 2] @ w[:-1] + w[-1]), np.sort(web[1 - side :: 2] @ w[:-1] + w[-1])
        if not len(x) or not len(u):
            continue
        share_x = 1 - np.arange(len(x)) / len(x)
        share_u = 1 - np.searchsorted(u, x, "left") / len(u)
        allowance = np.sqrt(np.log(4 / doubt) / (2 * len(x))) + np.sqrt(np.log(4 / doubt) / (2 * len(u)))
        best = np.argmin((share_u + allowance) / share_x)
        parts.append(share_u[best] / share_x[best])
    return float(np.clip(np.mean(parts), 0.01, 0.99)) if parts else 0.5


def train(good: np.ndarray, web: np.ndarray, prior: float | None = None) -> Model:
    """Minimise the non-negative unbiased risk; ``good`` and ``web`` are rows of features."""
    centre, scale = web.mean(axis=0), np.maximum(web.std(axis=0), 0.02)
    x, u = ((good - centre) / scale).astype(np.float64), ((web - centre) / scale).astype(np.float64)
    prior = estimated_prior(x, u) if prior is None else prior

    def risk(zx, zu):
        p, q = _logistic(zx), _logistic(zu)
        bad = np.log1p(np.exp(np.clip(zu, -30, 30))).mean() - prior * np.log1p(np.exp(np.clip(zx, -30, 30))).mean()
        of_bad_x, of_bad_u = -prior * p / len(zx), q / len(zu)
        if bad < 0:  # back to where the risk of the bad ones is not negative
            return -of_bad_x, -of_bad_u
        return -prior * (1 - p) / len(zx) + of_bad_x, of_bad_u

    return Model(prior, centre, scale, _descend(x, u, risk))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in slices(batches, text=1):
        flat = features(texts)
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([r.tobytes() for r in flat], pa.binary())], ["kind", "row"])


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
        fit_rows: int = FIT_ROWS, prior: float | None = None) -> Model | None:
    """Learn from trusted texts (every label of their id is above 0) and from all of ``docs`` as unlabelled text.

    Labels of 0 are not used.  At most ``fit_rows`` texts of either kind, drawn by a hash of id and text; null
    labels and ids are left out, a null text is an empty one.  None if there is no trusted or no other text.
    ``prior`` replaces the estimate.
    """
    trusted = labels.filter(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(
        F.min(F.col(label_column) > 0).alias("good")).filter("good").select("id", F.lit(1).alias("kind"))
    good = bounded_sample(docs, fit_rows, id_column, text_column, labels=trusted)
    web = bounded_sample(docs, fit_rows, id_column, text_column, kind=F.lit(0))
    rows = good.unionByName(web).mapInArrow(_feature_batches, "kind int, row binary").collect()  # 2 * fit_rows rows of features
    good, web = ([np.frombuffer(x, np.float32) for x in sorted(bytes(r.row) for r in rows if r.kind == k)] for k in (1, 0))
    if not good or not web:
        return None
    rng = np.random.default_rng(2)  # sorted and dealt anew: the fit does not depend on the order of the rows
    return train(rng.permutation(np.array(good)), rng.permutation(np.array(web)), prior)


def _score_batches(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for rows, texts in slices(batches, text=1):
        found = np.zeros(len(texts)) if model is None else model.score(features(texts))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(found, pa.float64())], ["row", "text", "score"])


def score(docs: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """The columns of ``docs`` and ``score`` (one of that name is replaced): 0 to 1, higher is likelier good.

    A null, empty or blank text has no shape: all of them get the one score of the zero row.  Without a model
    every score is 0.
    """
    plain = beside_text(docs, text_column)
    out = plain.mapInArrow(lambda it: _score_batches(it, model), f"row {plain.schema['row'].dataType.simpleString()}, text string, score double")
    return out.select(*from_row(docs, text_column, ["score"]), "score")
