"""What the fitted operators predict, rebuilt in plain Python; ids that are shared or missing; clashing columns in the pipeline."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mixframe.llm import language_id, source_mixing, toxicity

SF = "/root/testdata/sf0.01"


# --- language

def test_predictions_word_by_word(spark):
    """Sentences, messages and shares one word after the other, for whole texts of the given table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    field = language_id.fit(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2), fit_rows=20)
    some = [r for r in docs.orderBy("doc_id").collect() if len(r.text or "") < 1500][:60]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame([(r.doc_id, r.text) for r in some], "doc_id long, text string"), field).collect()}
    start, change = np.exp(field.start), np.exp(field.change)
    for row in some:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (row.text or "").encode())
        if not re.search(r"[^\W\d_]", row.text or ""):
            assert got[row.doc_id].lang_pred == "und"
            continue
        scores = language_id.emissions(field.weights, *language_id.features(language_id.Words([(row.text or "").encode()]))).astype(float)
        local, total, begin = np.exp(scores - scores.max(axis=1, keepdims=True)), np.zeros(len(start)), 0
        for k, word in enumerate(words):
            if k + 1 < len(words) and word[-1:] not in (b".", b"!", b"?"):
                continue
            ahead, behind = [], [np.ones(len(start))]
            for t in range(begin, k + 1):
                x = local[t] * (start if t == begin else ahead[-1] @ change)
                ahead.append(x / x.sum())
            for t in range(k, begin, -1):
                x = change @ (local[t] * behind[0])
                behind.insert(0, x / x.sum())
            for a, b in zip(ahead, behind):
                total += a * b / (a * b).sum()
            begin = k + 1
        best = int(total.argmax())
        assert got[row.doc_id].lang_pred == field.languages[best]
        assert math.isclose(got[row.doc_id].score, total[best] / len(words), abs_tol=1e-4)


@pytest.mark.parametrize("piece", [1, 3, 8, 1000])
def test_pieces_change_nothing(piece):
    rng = np.random.default_rng(piece)
    size = rng.integers(1, 60, 25)
    first = np.cumsum(size) - size
    scores, start, change = rng.normal(0, 3, (int(size.sum()), 4)), rng.normal(0, 1, 4), rng.normal(0, 2, (4, 4))
    want = language_id.forward_backward(scores, first, size, start, change)
    assert np.allclose(language_id.whole_sequences(scores, first, size, start, change, piece), want, atol=1e-9)


def test_language_of_shared_ids(spark):
    rng = random.Random(1)
    kinds = {"xx": ["kala", "talo", "vesi"], "yy": ["strom", "wald", "brot"], "zz": ["qué", "niño", "año"]}
    text = lambda x: " ".join("".join(rng.choices(kinds[x], k=2)) for _ in range(12))
    rows = [(11, text("xx"), "xx") for _ in range(1500)] + [(i, text("yy"), "yy") for i in range(300)] + [(None, text("zz"), "zz") for _ in range(300)]
    field = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert field.languages == ("xx", "yy", "zz")
    fresh = [(x, text(x)) for x in kinds for _ in range(40)]
    out = language_id.identify(spark.createDataFrame(fresh, "want string, text string"), field).collect()
    assert sum(r.want == r.lang_pred for r in out) >= 115


# --- toxicity

def by_hand(lexicon, text):
    """Every place of every entry, looked for one by one; an entry inside an exception does not count."""
    words = toxicity.folded_words(text or "")
    line = " " + " ".join(words) + " "
    places = lambda s: [i for i in range(len(line)) if line.startswith(s, i)]
    spared = [(i, i + len(p)) for p in lexicon.exceptions for i in places(p)]
    weight = sum(w for e, w in lexicon.entries.items() for i in places(e) if not any(a <= i and i + len(e) <= b for a, b in spared)) if words else 0.0
    c, x, y = lexicon.curve
    return 1 / (1 + math.exp(-(c + x * math.log1p(weight) + y * math.log1p(100 * weight / max(1, len(words))))))


def test_scores_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    lexicon = toxicity.fit(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1), labels, exceptions=("of the",))
    rows = [r for r in docs.collect() if len(r.text or "") < 4000]
    assert lexicon.entries and lexicon.exceptions
    got = {r.doc_id: r.score for r in toxicity.score(docs, lexicon).collect()}
    assert all(math.isclose(got[r.doc_id], by_hand(lexicon, r.text), abs_tol=1e-9) for r in rows)


def test_nested_exceptions():
    lexicon = toxicity.Lexicon({" bad": 2.0, " worse": 3.0}, (" not bad ", " bad worse case ", " not bad at all "), (0.0, 1.0, 0.0))
    rng = random.Random(4)
    for _ in range(300):
        text = " ".join(rng.choices(["not", "bad", "worse", "case", "at", "all", "badly"], k=rng.randint(0, 12)))
        weight, _ = toxicity.hits(lexicon.automaton(), toxicity.folded_words(text))
        assert math.isclose(1 / (1 + math.exp(-math.log1p(weight))), by_hand(lexicon, text), abs_tol=1e-9), text


def test_many_hits_and_exceptions():
    lexicon = toxicity.Lexicon({" bad": 1.0}, (" not bad ",))
    weight, rate = toxicity.hits(lexicon.automaton(), ["not", "bad", "bad"] * 60_000)  # 120,000 hits against 60,000 phrases
    assert weight == 60_000 and math.isclose(rate, 1 / 3)


def test_toxicity_of_shared_ids(spark):
    rng = random.Random(6)
    text = lambda bad: " ".join(rng.choices(["kala", "talo", "vesi", "puu"], k=20) + ["idiotx"] * bad)
    rows = [(1, text(0)) for _ in range(3000)] + [(2, text(1)) for _ in range(3000)] + [(3, "same")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels, fit_rows=50)
    out = toxicity.score(spark.createDataFrame([(0, text(0)), (1, text(1))], "want int, text string"), lexicon).collect()
    assert all((r.score >= 0.7) == bool(r.want) for r in out)


# --- mixing

def test_mixing_without_ids(spark):
    rows = [(None, f"text number {i} of many", "big") for i in range(2000)] + [(5, f"other {i}", "small") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = source_mixing.mix_sources(df).collect()
    assert len({r.position for r in out if r.source == "big"}) == 2000 and len(out) == 2100


# --- pipeline

def test_columns_of_the_user_stay(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    own = {"score": F.lit(5.5), "kept": F.lit("mine"), "n_bytes": F.lit("b"), "removed": F.lit(7), "n_removed": F.lit("c"), "row": F.lit(8), "readable": F.lit("d"), "n": F.lit(9)}
    df = docs.withColumns(own)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, work in corpus_pipeline.STAGES[:-1]:
        df = work(spark, df, str(tmp_path))
        assert df.columns == [*docs.columns, *own], name
        rows = df.collect()
        assert rows and all((r.score, r.kept, r.n_bytes, r.removed, r.n_removed, r.row, r.readable, r.n) == (5.5, "mine", "b", 7, "c", 8, "d", 9) for r in rows), name
        df = spark.createDataFrame(rows, df.schema)


def test_stages_without_rows_and_texts(spark, tmp_path):
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, None, None, None, None), (1, "", "xx", "s", 0), (1, "plain words that stay", None, None, 21)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for some, count in ((rows, 3), ([], 0)):
        df = spark.createDataFrame(some, schema)
        for name, work in corpus_pipeline.STAGES:
            df = spark.createDataFrame(work(spark, df, str(tmp_path)).select(*schema.split()[::2]).collect(), schema)
            assert df.count() == count, name
