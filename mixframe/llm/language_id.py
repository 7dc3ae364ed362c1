"""Language identification by a linear-chain conditional random field over words.

Every word of a sentence has a language; its features are the word itself, its beginnings and endings
and its character trigrams, all hashed into one table of weights, and neighbouring words are tied by
learned transitions.  Forward-backward gives the probability of each language at each word, so texts that
change language inside a sentence are labelled word by word; a text's language is the one with the
largest share of all its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import bounded_sample
from .words import IS_SPACE, LOWER, Words, beside_text, from_row, mix, slices

#: The model is fitted on at most so many documents of each language, those with the smallest hash of id and text.
FIT_ROWS = 100
#: Weights are kept for 2**TABLE_BITS hashed features.
TABLE_BITS = 17
#: A sentence ends with one of these bytes.
SENTENCE_ENDS = b".!?"
#: Long sentences are worked on in pieces of so many words side by side.  It changes the speed only.
PIECE = 128
PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
UNKNOWN = "und"


@dataclass
class Field:
    languages: tuple[str, ...]
    weights: np.ndarray  # feature, language
    start: np.ndarray
    change: np.ndarray  # from language, to language


def slot(*parts: np.ndarray) -> np.ndarray:
    code = np.zeros(len(parts[0]), dtype=np.uint64)
    for part in parts:
        code = mix(code + part.astype(np.uint64))
    return (code >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words one after the other, and where each word's begin."""
    n = len(words.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = LOWER[words.buffer].copy()
    text[IS_SPACE[text]] = 0x20
    padded = np.concatenate((np.full(4, 0x20, np.uint8), text, np.full(4, 0x20, np.uint8))).astype(np.uint64)
    start, end = words.start, words.end.copy()
    for _ in range(2):  # endings without punctuation
        end -= PUNCTUATION[text[end - 1]] & (end - start > 1)
    size = end - start
    at, stop = start + 4, end + 4
    kind = lambda k: np.full(n, k, dtype=np.uint64)
    own = [slot(kind(1), words.code)]
    for k in (1, 2, 3):
        parts = [np.where(size > j, padded[at + j], np.uint64(0)) for j in range(k)]
        own.append(slot(kind(10 + k), *parts))
    for k in (1, 2, 3, 4):
        parts = [np.where(size > j, padded[np.maximum(stop - 1 - j, 0)], np.uint64(0)) for j in range(k)]
        own.append(slot(kind(20 + k), *parts))
    grams = np.concatenate(([0], np.cumsum(words.end - start)))
    place = np.arange(grams[-1]) - np.repeat(grams[:-1], words.end - start) + np.repeat(start, words.end - start) + 4
    tri = (padded[place - 1] << np.uint64(16)) | (padded[place] << np.uint64(8)) | padded[place + 1]
    tri = (mix(tri + np.uint64(1 << 32)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    first = np.arange(n) * len(own) + grams[:-1]
    out = np.empty(len(own) * n + len(tri), dtype=np.int64)
    for k, values in enumerate(own):
        out[first + k] = values
    out[np.arange(len(tri)) + np.repeat((np.arange(n) + 1) * len(own), words.end - start)] = tri
    return out, first


def emissions(field_weights: np.ndarray, index: np.ndarray, first: np.ndarray) -> np.ndarray:
    if not len(first):
        return np.zeros((0, field_weights.shape[1]), dtype=np.float32)
    return np.add.reduceat(field_weights[index], first, axis=0)


def forward_backward(scores: np.ndarray, first: np.ndarray, size: np.ndarray, start: np.ndarray, change: np.ndarray, pairs: bool = False,
                     enter: np.ndarray | None = None, leave: np.ndarray | None = None):
    """Probabilities of the labels at each position of each sequence (positions ``first`` .. ``first + size``).

    Sequences run side by side, the longest first, so that the ones still open are always the first ones.
    ``enter`` and ``leave`` are the messages from before and behind each sequence, where it is a piece of a longer one.
    ``pairs``: also the expected number of each transition.
    """
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    enter = None if enter is None else enter[order]
    leave = None if leave is None else leave[order]
    steps = int(size[0]) if len(size) else 0
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    a, s = np.exp(change).astype(local.dtype), np.exp(start).astype(local.dtype)
    ahead, behind = np.empty_like(local), np.empty_like(local)
    open_ = [int(np.searchsorted(-size, -t, "left")) for t in range(steps)]  # sequences longer than t
    for t in range(steps):
        at = first[: open_[t]] + t
        x = local[at] * (ahead[at - 1] @ a if t else s if enter is None else enter)
        ahead[at] = x / x.sum(axis=1, keepdims=True)
    moves = np.zeros_like(a)
    for t in range(steps - 1, -1, -1):
        at = first[: open_[t]] + t
        more = open_[t + 1] if t + 1 < steps else 0
        behind[at[more:]] = 1 if leave is None else leave[more : open_[t]]
        if more:
            right = local[at[:more] + 1] * behind[at[:more] + 1]
            x = right @ a.T
            behind[at[:more]] = x / x.sum(axis=1, keepdims=True)
            if pairs:
                joint = ahead[at[:more]][:, :, None] * a[None] * right[:, None, :]
                moves += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    out = ahead * behind
    out /= out.sum(axis=1, keepdims=True)
    return (out, moves) if pairs else out


def whole_sequences(scores: np.ndarray, first: np.ndarray, size: np.ndarray, start: np.ndarray, change: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """``forward_backward`` for sequences of any length, worked on in pieces side by side; the result is the same.

    What a piece does to a message is a matrix over the labels.  With these the messages are carried from piece to
    piece over the whole sequence, and then each piece runs with the messages that enter it from both sides.
    """
    count = -(-size // piece)
    if not len(size) or count.max() == 1:
        return forward_backward(scores, first, size, start, change)
    of = np.repeat(np.arange(len(size)), count)
    rank = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    begin, length = first[of] + rank * piece, np.minimum(piece, size[of] - rank * piece)
    k = len(start)
    local = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    a, s = np.exp(change), np.exp(start)
    through = np.zeros((len(of), k, k))
    long = np.flatnonzero(count[of] > 1)
    for t in range(piece):
        mine = long[length[long] > t]
        here = local[begin[mine] + t]
        through[mine] = (np.eye(k) if t == 0 else through[mine] @ a) * here[:, None, :]
        through[mine] /= through[mine].max(axis=(1, 2), keepdims=True)
    enter, leave = np.tile(s, (len(of), 1)), np.ones((len(of), k))
    head = np.cumsum(count) - count
    for r in range(1, int(count.max())):
        ahead = head[count > r] + r
        x = np.einsum("ni,nij->nj", enter[ahead - 1], through[ahead - 1]) @ a
        enter[ahead] = x / x.max(axis=1, keepdims=True)
        last = head[count > r] + count[count > r] - 1 - r
        x = np.einsum("nij,nj->ni", through[last + 1], leave[last + 1]) @ a.T
        leave[last] = x / x.max(axis=1, keepdims=True)
    return forward_backward(scores, begin, length, start, change, enter=enter.astype(scores.dtype), leave=leave.astype(scores.dtype))


def sentences(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of each sentence; sentences do not cross texts."""
    n = len(words.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.isin(words.buffer[words.end - 1], np.frombuffer(SENTENCE_ENDS, np.uint8))
    head = np.zeros(n + 1, dtype=bool)
    head[words.first] = True
    head[1:] |= ends
    begin = np.flatnonzero(head[:n])
    return begin, np.diff(begin, append=n)


def train(texts: list[bytes], languages: list[str], rounds: int = 8, lanes: int = 256, length: int = 32, seed: int = 3) -> Field:
    """Fit by stochastic gradient steps on sequences spliced from spans of documents in different languages."""
    names = tuple(sorted(set(languages)))
    rng, k = np.random.default_rng(seed), len(names)
    words = Words(texts)
    index, first = features(words)
    size = np.diff(first, append=len(index))
    label = np.repeat([names.index(x) for x in languages], np.diff(words.first))
    n = len(first)
    weights = np.zeros((1 << TABLE_BITS, k), dtype=np.float32)
    start, change = np.zeros(k), np.zeros((k, k))
    squares, squares_s, squares_c = np.full_like(weights, 1e-6), np.full(k, 1e-6), np.full((k, k), 1e-6)
    by_language = [np.flatnonzero(label == j) for j in range(k)]
    if n < 1:
        return Field(names, weights, start, change)
    for _ in range(max(1, rounds * n // (lanes * length))):
        # spans of neighbouring words; a language is drawn for each span, now and then the same again
        rows = np.empty(lanes * length, dtype=np.int64)
        filled = 0
        while filled < len(rows):
            own = by_language[rng.integers(k)]
            span = min(int(rng.geometric(1 / 16)), len(rows) - filled)
            if len(own):
                at = int(rng.integers(len(own)))
                span = min(span, len(own) - at)
                rows[filled : filled + span] = own[at : at + span]
                filled += span
        counts = size[rows]
        offset = np.concatenate(([0], np.cumsum(counts)[:-1]))
        at = index[np.repeat(first[rows] - offset, counts) + np.arange(int(counts.sum()))]
        scores = np.add.reduceat(weights[at], offset, axis=0).astype(np.float64)
        begin = np.arange(lanes) * length
        p, moves = forward_backward(scores, begin, np.full(lanes, length), start, change, pairs=True)
        truth = label[rows]
        gap = p
        gap[np.arange(len(rows)), truth] -= 1
        spread = np.repeat(gap, counts, axis=0)
        gradient = np.column_stack([np.bincount(at, weights=spread[:, j], minlength=len(weights)) for j in range(k)]).astype(np.float32) / lanes
        squares += gradient * gradient
        weights -= 0.1 * gradient / np.sqrt(squares)
        g = gap[begin].sum(axis=0) / lanes
        squares_s += g * g
        start -= 0.1 * g / np.sqrt(squares_s)
        inner = np.arange(len(rows)).reshape(lanes, length)
        seen = np.zeros((k, k))
        np.add.at(seen, (truth[inner[:, :-1]].ravel(), truth[inner[:, 1:]].ravel()), 1)
        g = (moves - seen) / lanes
        squares_c += g * g
        change -= 0.1 * g / np.sqrt(squares_c)
    return Field(names, weights, start, change)


def fit(docs: DataFrame, text_column: str = "text", label_column: str = "lang", id_column: str = "doc_id", fit_rows: int = FIT_ROWS) -> Field:
    """Fit on ``fit_rows`` documents of each language; null texts and languages are left out.

    Documents are drawn by a hash of id and text, so shared or null ids change nothing.
    """
    known = docs.filter(F.col(f"`{text_column}`").isNotNull())
    rows = bounded_sample(known, fit_rows, id_column, text_column, kind=F.col(f"`{label_column}`")).orderBy(F.xxhash64("text"), "text", "kind").collect()
    return train([r.text.encode() for r in rows], [r.kind for r in rows])


def label_batches(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    """From rows (row, text, has a letter): the language and its share of the words."""
    for rows, texts in slices(batches):
        words = Words(texts)
        index, first = features(words)
        scores = emissions(field.weights, index, first)
        best, share = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
        if len(scores) and field.languages:
            p = whole_sequences(scores, *sentences(words), field.start, field.change)
            total = np.concatenate((np.zeros((1, p.shape[1])), np.cumsum(p, axis=0, dtype=np.float64)))
            mass = total[words.first[1:]] - total[words.first[:-1]]
            best, count = mass.argmax(axis=1), np.maximum(1, np.diff(words.first))
            share = np.clip(mass[np.arange(len(mass)), best] / count, 0, 1)
        names = [field.languages[b] if ok else UNKNOWN for b, ok in zip(best, rows.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(names, pa.string()), pa.array(np.where([x != UNKNOWN for x in names], share, 0.0))], ["row", "text", "lang_pred", "score"])


def identify(docs: DataFrame, field: Field, text_column: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``lang_pred`` and ``score`` (columns of these names are replaced).

    A null text, one without a letter, and every text if no language was learned, is ``und`` with score 0.
    """
    results = ["lang_pred", "score"]
    text = F.col(text_column)
    letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False)) if field.languages else F.lit(False)
    plain = beside_text(docs, text_column, letter.alias("letter"))
    out = plain.mapInArrow(lambda it: label_batches(it, field), f"row {plain.schema['row'].dataType.simpleString()}, text string, lang_pred string, score double")
    return out.select(*from_row(docs, text_column, results), *results)
