"""Spelling variants against every pair of words compared one by one."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mixframe.llm import spelling_variants as sv


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, factor=5):
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        out[w] = [best if best is not None and counts[best] >= factor * n else None, n, len(near)]
    rows = set()
    for w, (form, n, n_near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, n_near, counts[form] if form else None))
    return rows


def words_of(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=7), min_size=1, max_size=60), st.text("ab", max_size=4))
def test_scan(found, lead):
    words = sorted(lead + w for w in found)
    assert sorted(sv.scan(words, len(lead))) == sorted((i, j) for i, j in itertools.combinations(range(len(words)), 2) if one_edit(words[i], words[j]))


@pytest.mark.parametrize("range_words", [2, 7, 1024])
def test_near_words(spark, range_words):
    rng = random.Random(range_words)
    words = {"".join(rng.choices("abñ", k=rng.randint(1, 7))) for _ in range(250)} | {"same" * 5 + "".join(rng.choices("xyz", k=4)) for _ in range(60)}
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = [(r.word, r.near) for r in sv.near_words(df, range_words).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_variants_of_documents(spark):
    rng = random.Random(8)
    base = ["keyboard", "KEYBOARD", "Schlüssel", "schlussel", "keyboards", "kéyboard", "keyboardss", "ab", "letter", "lettre", "better", "×÷×÷×÷", "Ünderway", "ünderway"]
    docs = [(rng.choice([1, 2, 3, None]), " ".join(rng.choices(base, weights=[200, 90, 30, 5, 25, 4, 3, 9, 60, 2, 12, 3, 2, 6], k=60))) for _ in range(60)]
    docs += [(9, None), (9, ""), (10, "1 2 _"), (11, "x" * 200_000), (12, "keyboardsss " * 5)] + docs[:3]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    got = {tuple(r) for r in sv.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == brute(words_of(docs))
    assert any(form and root not in (w, form) for w, form, root, *_ in got)  # a chain of forms


def test_nothing_to_compare(spark):
    assert sv.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = spark.createDataFrame([(None, None), (1, "one two")], "doc_id long, text string")
    assert sv.spelling_variants(only).count() == 0
    odd = spark.createDataFrame([(None, 5), ("", 9), ("a", 9), ("b", 90)], "word string, n long")
    assert {tuple(r) for r in sv.variants(odd).select("word", "form", "root", "n", "n_near").collect()} == {("a", "b", "b", 9, 1), ("b", None, "b", 90, 1)}
    with pytest.raises(ValueError):
        sv.variants(odd, factor=1)


def test_ties_take_the_smallest_form(spark):
    df = spark.createDataFrame([("cab", 1), ("caé", 50), ("caz", 50), ("caa", 50)], "word string, n long")
    assert {r.word: r.form for r in sv.variants(df).collect()}["cab"] == "caa"
