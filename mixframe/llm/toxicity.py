"""Toxicity by a weighted lexicon.

Texts are folded first (case, accents, letters of other scripts that look Latin, digits written for
letters).  The lexicon holds word beginnings and whole words that labelled documents show to be far
likelier in toxic ones; its entries and the exception phrases are found in one Aho-Corasick pass.  An
entry inside an exception phrase does not count.  The weight of the hits, as it is and per word, gives the
score by a logistic curve.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import bounded_sample
from .words import beside_text, from_row, slices

#: The classifier is fitted on at most so many labelled documents of either kind, those with the smallest
#: hash of id and text.
FIT_ROWS = 8_000
#: A lexicon entry is in this share of the toxic fit documents at least, and in so many.
LEAST_SHARE, LEAST_DOCUMENTS = 0.008, 3
#: Log odds that make an entry, and the least likelihood ratio statistic against chance.
LEAST_ODDS, LEAST_EVIDENCE = 2.5, 16.0
#: Lengths of word beginnings that can be entries; whole words always can.
STEMS = range(4, 9)

# Letters and digits read as the Latin letter they look like.
LOOKS_LIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "|": "l",
}


class _Fold(dict):
    def __missing__(self, point: int) -> str:
        char = chr(point).lower()
        out = LOOKS_LIKE.get(char)
        if out is None:
            parts = [c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)]
            out = "".join(LOOKS_LIKE.get(c, c if c.isalpha() else " ") for c in parts) if parts else ""
        self[point] = out
        return out


FOLD = _Fold()


def folded_words(text: str) -> list[str]:
    return text.translate(FOLD).split()


@dataclass
class Lexicon:
    """Entries with weights, exception phrases, and the logistic curve: constant, by weight, by weight per word."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-np.inf, 0.0, 0.0)

    def automaton(self):
        if not self.entries:
            return None
        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        for entry, weight in self.entries.items():
            found.add_word(entry, (len(entry), weight))
        found.make_automaton()
        return found


def hits(automaton, words: list[str]) -> tuple[float, float]:
    """Total weight of the entries in a text, and per word."""
    if automaton is None or not words:
        return 0.0, 0.0
    found, spared = [], []
    for end, (size, weight) in automaton.iter(" " + " ".join(words) + " "):
        (spared if weight is None else found).append((end - size + 1, end, weight))
    # an entry is spared if the phrase that reaches farthest of those beginning at or before it covers it
    found.sort(key=lambda hit: hit[0])
    spared.sort(key=lambda hit: hit[0])
    total, reach, k = 0.0, -1, 0
    for begin, end, weight in found:
        while k < len(spared) and spared[k][0] <= begin:
            reach = max(reach, spared[k][1])
            k += 1
        if end > reach:
            total += weight
    return total, total / len(words)


def candidates(word: str) -> set[str]:
    return {f" {word} "} | {f" {word[:k]}" for k in STEMS if len(word) >= k}


def _count_batches(batches: Iterator[pa.RecordBatch], known: set[str] | None) -> Iterator[pa.RecordBatch]:
    """Documents with each candidate, by label: rows (entry, toxic, clean)."""
    for rows, texts in slices(batches, text=1):
        toxic, clean = Counter(), Counter()
        for raw, label in zip(texts, rows.column(0).to_pylist()):
            found = set().union(*map(candidates, set(folded_words(raw.decode(errors="replace")))))
            (toxic if label else clean).update(found if known is None else found & known)
        names = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([clean[x] for x in names], pa.int64())],
                                         ["entry", "toxic", "clean"])


def _phrase_batches(batches: Iterator[pa.RecordBatch], entries: dict[str, float]) -> Iterator[pa.RecordBatch]:
    """Documents with each pair of neighbouring words that holds an entry, by label."""
    for rows, texts in slices(batches, text=1):
        toxic, clean = Counter(), Counter()
        for raw, label in zip(texts, rows.column(0).to_pylist()):
            words = folded_words(raw.decode(errors="replace"))
            hit = [not entries.keys().isdisjoint(candidates(w)) for w in words]
            found = {f" {x} {y} " for x, y, p, q in zip(words, words[1:], hit, hit[1:]) if p or q}
            (toxic if label else clean).update(found)
        names = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([clean[x] for x in names], pa.int64())],
                                         ["entry", "toxic", "clean"])


def _feature_batches(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    automaton = lexicon.automaton()
    for rows, texts in slices(batches, text=1):
        found = [hits(automaton, folded_words(raw.decode(errors="replace"))) for raw in texts]
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([x for x, _ in found], pa.float64()), pa.array([y for _, y in found], pa.float64())],
                                         ["row", "weight", "rate"])


def log_odds(toxic: int, clean: int, toxic_all: int, clean_all: int) -> float:
    return float(np.log((toxic + 0.5) / (toxic_all - toxic + 0.5)) - np.log((clean + 0.5) / (clean_all - clean + 0.5)))


def evidence(toxic: int, clean: int, toxic_all: int, clean_all: int) -> float:
    """Likelihood ratio statistic (G) of an entry's presence against the label."""
    cells = np.array([[toxic, toxic_all - toxic], [clean, clean_all - clean]], dtype=float)
    expected = cells.sum(axis=1, keepdims=True) * cells.sum(axis=0, keepdims=True) / cells.sum()
    seen = cells > 0
    return float(2 * (cells[seen] * np.log(cells[seen] / expected[seen])).sum())


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float, float]:
    """Logistic regression with a small ridge, by Newton's method."""
    a = np.column_stack((np.ones(len(x)), x))
    ridge, w = np.diag([1e-3, 1e-2, 1e-2]), np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
        exceptions: tuple[str, ...] = (), fit_rows: int = FIT_ROWS) -> Lexicon:
    """Learn the lexicon, exception phrases and curve from labelled documents.

    A document with several labels is toxic if one says so; null labels and null ids are left out.
    Without documents of both kinds the lexicon is empty and every score 0.  ``exceptions`` are phrases
    that never count, besides the learned ones: word pairs around an entry seen more in clean documents.
    """
    labels = labels.filter(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(
        F.max((F.col(label_column) > 0).cast("int")).alias("kind"))
    sample = bounded_sample(docs, fit_rows, id_column, text_column, labels=labels).select(F.col("kind").alias("label"), "text").persist()
    try:
        size = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
        toxic_all, clean_all = size.get(1, 0), size.get(0, 0)
        if not toxic_all or not clean_all:
            return Lexicon()
        schema, total = "entry string, toxic long, clean long", (F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        least = max(LEAST_DOCUMENTS, LEAST_SHARE * toxic_all)
        often = sample.filter("label = 1").mapInArrow(lambda it: _count_batches(it, None), schema).groupBy("entry").agg(*total).filter(F.col("toxic") >= least).collect()
        known = {r.entry for r in often}  # at most words per document / LEAST_SHARE
        seen = sample.mapInArrow(lambda it: _count_batches(it, known), schema).groupBy("entry").agg(*total).collect()
        odds = {r.entry: log_odds(r.toxic, r.clean, toxic_all, clean_all) for r in seen
                if evidence(r.toxic, r.clean, toxic_all, clean_all) >= LEAST_EVIDENCE}
        entries: dict[str, float] = {}
        for entry in sorted(odds, key=lambda e: (len(e), e)):  # a longer entry adds nothing to one inside it
            if odds[entry] >= LEAST_ODDS and not any(entry[:k] in entries for k in range(1, len(entry))):
                entries[entry] = odds[entry]
        pairs = sample.mapInArrow(lambda it: _phrase_batches(it, entries), schema).groupBy("entry").agg(*total).filter("clean >= 3").collect()
        spared = {r.entry for r in pairs if log_odds(r.toxic, r.clean, toxic_all, clean_all) < 0}
        spared |= {f" {' '.join(folded_words(x))} " for x in exceptions if folded_words(x)}
        lexicon = Lexicon(entries, tuple(sorted(spared)))
        points = sample.mapInArrow(lambda it: _feature_batches(it, lexicon), "row int, weight double, rate double").toPandas()
        lexicon.curve = fit_curve(features(points.weight.to_numpy(), points.rate.to_numpy()), points.row.to_numpy(dtype=float))
        return lexicon
    finally:
        sample.unpersist()


def features(weight: np.ndarray, rate: np.ndarray) -> np.ndarray:
    return np.column_stack((np.log1p(weight), np.log1p(100 * rate)))


def _score_batches(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    automaton, (constant, *slope) = lexicon.automaton(), lexicon.curve
    for rows, texts in slices(batches, text=1):
        found = np.array([hits(automaton, folded_words(raw.decode(errors="replace"))) for raw in texts])
        x = features(found[:, 0], found[:, 1]) @ np.array(slope) + constant
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.where(np.isneginf(x), 0.0, 1 / (1 + np.exp(-np.clip(x, -700, 700)))))], ["row", "text", "score"])


def score(docs: DataFrame, lexicon: Lexicon, text_column: str = "text") -> DataFrame:
    """The columns of ``docs`` and ``score`` (one of that name is replaced): 0 to 1, higher is likelier toxic.

    A null or empty text has no hits and gets the score of a text without hits.
    """
    plain = beside_text(docs, text_column)
    out = plain.mapInArrow(lambda it: _score_batches(it, lexicon), f"row {plain.schema['row'].dataType.simpleString()}, text string, score double")
    return out.select(*from_row(docs, text_column, ["score"]), "score")
