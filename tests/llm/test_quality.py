"""Positive-unlabelled quality: held-out labels, the prior, the risk, and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixframe.llm import quality
from mixframe.llm.queries import op11_quality_classifier
from mixframe.llm.sampling import bounded_sample

FOLDER = "/root/testdata/sf0.1"


def test_held_out_labels(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality")
    out = op11_quality_classifier(spark, FOLDER)
    assert out.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    assert len(good) > 500 and len(bad) > 80
    assert np.mean([r.predicted for r in good]) >= 0.98 and np.mean([r.predicted for r in bad]) <= 0.1


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.9])
def test_prior_and_risk(prior):
    rng = np.random.default_rng(int(prior * 10))
    good = rng.normal(1.5, 1, (3000, 4))
    kind = rng.random(3000) < prior
    web = np.where(kind[:, None], rng.normal(1.5, 1, (3000, 4)), rng.normal(-1.5, 1, (3000, 4)))
    model = quality.train(good.astype(np.float32), web.astype(np.float32))
    assert abs(model.prior - prior) < 0.08
    assert np.mean((model.score(web) > 0.5) == kind) > 0.95
    assert abs(model.score(web).mean() - prior) < 0.1  # scores are probabilities


def brute(text):
    """A few figures of the features, counted in plain Python."""
    words = text.split()
    if not words:
        return None
    pairs = list(zip(words, words[1:]))
    return [np.log1p(len(words)), np.mean([len(w.encode()) for w in words]), np.std([len(w.encode()) for w in words]),
            len(set(words)) / len(words), max(words.count(w) for w in words) / len(words), sum(a == b for a, b in pairs) / len(words), len(set(pairs)) / len(words)]


def test_features():
    rng = random.Random(3)
    texts = ["", " ", "a", " Ab  cd ", "x!! x!! x!!", "é😀 é", "one two\none two\nthree"] + [
        " ".join(rng.choices(["the", "The", "a|b", "9%", "näh", "END!!"], k=rng.randint(0, 30))) for _ in range(60)]
    got = quality.features([t.encode() for t in texts])
    for t, row in zip(texts, got):
        want = brute(t)
        if want is None:
            assert not row.any()
            continue
        tail = row[-11:]
        assert np.allclose([tail[0], tail[1], tail[2], tail[6], tail[7], tail[8], tail[9]], want, atol=1e-4), t
        assert np.isclose(row[quality.CLASS[ord("!")]] ** 2, t.count("!") / len(t.encode()), atol=1e-6)
        assert np.isclose((row[quality.CLASSES : quality.CLASSES + quality.SHAPES] ** 2).sum(), 1, atol=1e-4)
    alone = np.concatenate([quality.features([t.encode()]) for t in texts])
    assert np.allclose(got, alone, atol=1e-6)  # a text's features do not depend on its neighbours


def test_odd_rows(spark):
    rows = [(i, "Plain words in a row, said once.") for i in range(40)] + [(100 + i, "BAD!! BAD!! |||") for i in range(20)]
    rows += [(None, None), (None, ""), (7, "Another text under one id"), (7, "Another text under one id"), (999, "x " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("mine")).withColumn("row", F.lit(1))
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(7, 0), (None, 1), (3, None), (100, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = quality.score(docs, model)
    assert out.columns == ["doc_id", "text", "row", "score"] and out.count() == len(rows)
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert quality.fit(docs, labels.limit(0)) is None and quality.fit(docs.limit(0), labels) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.0}
    assert quality.score(docs.limit(0), model).count() == 0


def test_sample_with_shared_ids(spark):
    rows = [(4, f"text {i}", "xx") for i in range(4000)] + [(None, f"none {i}", "yy") for i in range(400)] + [(5, "same", "zz")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = bounded_sample(docs, 100, "doc_id", "text", kind=F.col("lang")).collect()
    assert {k: sum(r.kind == k for r in found) for k in ("xx", "yy", "zz")} == {"xx": 100, "yy": 100, "zz": 1}
    labelled = bounded_sample(docs, 50, "doc_id", "text", labels=spark.createDataFrame([(4, 1), (5, 0), (None, 0)], "id long, kind int")).collect()
    assert {k: sum(r.kind == k for r in labelled) for k in (0, 1)} == {0: 1, 1: 50}
