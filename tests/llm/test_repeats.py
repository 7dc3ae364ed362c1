"""The two repeat removers against brute force."""

import hashlib
import random
import re

import pytest

from mixframe.llm import repeats, substring_dedup, suffix_array_dedup


def brute_words(docs, window):
    words = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for i, t in docs}
    least = {}
    for i, w in words.items():
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if least[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        out[i] = (len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode())
    return out


def brute_bytes(docs, length):
    raw = {i: (t or "").encode() for i, t in docs}
    least = {}
    for i in sorted(raw):
        for s in range(len(raw[i]) - length + 1):
            least.setdefault(raw[i][s : s + length], (i, s))
    out = {}
    for i, b in raw.items():
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if least[b[s : s + length]] < (i, s):
                gone[s : s + length] = [True] * length
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def corpus(seed, n=160, vocabulary=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(vocabulary)]
    passages = [[rng.choice(words) for _ in range(rng.randint(12, 60))] for _ in range(6)]
    docs = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(0, 5)):
            kind = rng.random()
            if kind < 0.4:
                text += rng.choice(passages)
            elif kind < 0.5:
                text += ["x"] * rng.randint(1, 90)
            else:
                text += [rng.choice(words) for _ in range(rng.randint(1, 40))]
        docs.append((i * 3 - 40, rng.choice([" ", "\n", "\t "]).join(text)))
        if docs and rng.random() < 0.2:
            docs.append((1000 + i, rng.choice(docs)[1]))
    return [*docs, (5000, None), (5001, ""), (5002, "   ")]


@pytest.fixture
def parts(monkeypatch, request):
    monkeypatch.setattr(repeats, "PART_ROWS", request.param)


@pytest.mark.parametrize("parts", [20_000, 2], indirect=True)
@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed, parts):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = substring_dedup.drop_repeated_windows(df, window=11).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in rows} == brute_words(docs, 11)


@pytest.mark.parametrize("parts", [20_000, 2], indirect=True)
@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed, parts):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = suffix_array_dedup.drop_repeated_bytes(df, length=40).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in rows}
    assert got == brute_bytes(docs, 40)
    assert all(r.kept.decode(errors="ignore") == r.text for r in rows)


@pytest.mark.parametrize("job", [substring_dedup.drop_repeated_windows, suffix_array_dedup.drop_repeated_bytes])
def test_odd_rows(spark, job):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(None, long, "k"), (None, None, None), (1, long, "a"), (1, long, "a"), (2, "", "b"), (3, long + " z", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc string").selectExpr("doc_id", "text", "doc", "'x' AS spans", "1 AS removed", "2 AS row")
    out = {(r.doc_id, r.doc): r for r in job(df).collect()}
    assert out[None, "k"].n_removed == 0 and out[None, None].n_removed == 0 and out[2, "b"].text == ""
    assert out[1, "a"].n_removed > 0 and out[3, "c"].text.strip() == "z" and out[3, "c"].spans == "x"
    assert job(df).count() == 6 and job(df.limit(0)).count() == 0


@pytest.mark.parametrize("job", [substring_dedup.drop_repeated_windows, suffix_array_dedup.drop_repeated_bytes])
def test_texts_without_an_id_are_kept_apart(spark, job):
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(60)]
    rows = [(None, " ".join(f"{i}a{rng.randrange(10**6)}" for _ in range(70)), i) for i in range(3000)]
    rows += [(-5, " ".join(["head", *passage]), 3000)] + [(1, " ".join([*(f"{i}b{k}" for k in range(rng.randint(0, 60))), *passage]), i) for i in range(3001, 4500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(4)
    got = {r.n: r.text.split() for r in job(df).collect()}
    assert len(got) == len(rows)
    for doc, text, n in rows:
        words = text.split()
        if doc != 1:
            assert got[n] == words
        else:  # bytes in front of the passage may repeat with it
            own = len(words) - 60
            assert len(got[n]) <= own and got[n][: max(0, own - 1)] == words[: max(0, own - 1)]
