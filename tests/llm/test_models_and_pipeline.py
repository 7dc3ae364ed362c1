"""The two fitted operators by held-out accuracy, the pipeline by its parts in plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mixframe.llm import language_id, toxicity
from mixframe.llm.queries import query

SF = "/root/testdata/sf0.01"
LANGUAGES = {"xx": ["kala", "talo", "vesi", "puu", "kissa"], "yy": ["strom", "schiff", "wald", "brot", "licht"], "zz": ["ñandú", "qué", "año", "niño", "mañana"]}
BAD = ["idiotx", "schuftig", "gemeinling"]


def prose(rng, language, n):
    return " ".join("".join(rng.choices(LANGUAGES[language], k=2)) + rng.choice(["", "", ".", ","]) for _ in range(n))


# --- language

@pytest.fixture(scope="module")
def field(spark):
    rng = random.Random(1)
    rows = [(i, x, prose(rng, x, rng.randint(5, 60))) for i, x in enumerate(list(LANGUAGES) * 40)]
    return language_id.fit(spark.createDataFrame([*rows, (None, None, "x"), (900, "xx", None)], "doc_id long, lang string, text string"), fit_rows=30)


def test_language_held_out(spark, field):
    rng = random.Random(2)
    rows = [(x, prose(rng, x, rng.randint(1, 200))) for x in list(LANGUAGES) * 60]
    out = language_id.identify(spark.createDataFrame(rows, "want string, text string"), field).collect()
    assert sum(r.want == r.lang_pred for r in out) >= 0.98 * len(out) and all(0 <= r.score <= 1 for r in out)


def test_language_switches_inside_a_sentence(field):
    rng = random.Random(3)
    words = language_id.Words([" ".join(["".join(rng.choices(LANGUAGES[x], k=2)) for x in ["xx"] * 8 + ["yy"] * 8 + ["zz"] * 8]).encode()])
    index, first = language_id.features(words)
    p = language_id.forward_backward(language_id.emissions(field.weights, index, first), *language_id.sentences(words), field.start, field.change)
    got = [field.languages[k] for k in p.argmax(axis=1)]
    assert sum(a == b for a, b in zip(got, ["xx"] * 8 + ["yy"] * 8 + ["zz"] * 8)) >= 22
    assert (field.change.diagonal() > field.change.mean()).all()  # staying was learned


def test_forward_backward_is_what_enumeration_gives():
    import itertools

    import numpy as np
    rng = np.random.default_rng(5)
    size = np.array([3, 1, 4])
    first, scores, start, change = np.array([0, 3, 4]), rng.standard_normal((8, 3)), rng.standard_normal(3), rng.standard_normal((3, 3))
    got = language_id.forward_backward(scores, first, size, start, change)
    for a, n in zip(first, size):
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(start[path[0]] + sum(scores[a + t, k] for t, k in enumerate(path)) + sum(change[x, y] for x, y in zip(path, path[1:])))
            for t, k in enumerate(path):
                want[t, k] += w
        assert np.allclose(got[a : a + n], want / want.sum(axis=1, keepdims=True))


def test_language_odd_rows(spark, field):
    rows = [(None, None), (1, ""), (2, " 12 \n"), (3, "kalatalo " * 30000), (3, "kalatalo " * 30000), (4, "–—€")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("old")).withColumn("row", F.lit(1))
    out = language_id.identify(df, field).collect()
    assert sorted((str(r.doc_id), r.lang_pred, r.score > 0.9) for r in out) == sorted(
        [("None", "und", False), ("1", "und", False), ("2", "und", False), ("3", "xx", True), ("3", "xx", True), ("4", "und", False)])
    assert language_id.identify(df.limit(0), field).count() == 0
    nothing = language_id.fit(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"}


def test_language_query(spark):
    got = query.queries["op5_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    row = got.filter("held_out").selectExpr("avg(CAST(lang_pred = lang AS INT)) AS right").first()
    assert row.right >= 0.97 and got.filter("held_out <> (crc32(CAST(doc_id AS STRING)) % 4 = 2)").count() == 0


# --- toxicity

@pytest.fixture(scope="module")
def toxic_rows():
    rng = random.Random(6)
    rows = []
    for i in range(600):
        words = prose(rng, rng.choice(["xx", "yy"]), rng.randint(5, 80)).split()
        toxic = i % 5 == 0
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        if not toxic and i % 7 == 0:  # harmless in this phrase
            words.insert(0, "clownx fish")
        if toxic and i % 2:
            words.insert(0, "clownx")
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def lexicon(spark, toxic_rows):
    df = spark.createDataFrame(toxic_rows, "doc_id long, text string, toxic int").filter("doc_id % 3 != 1")
    return toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))


def test_toxic_held_out(spark, toxic_rows, lexicon):
    df = spark.createDataFrame(toxic_rows, "doc_id long, text string, toxic int").filter("doc_id % 3 = 1")
    out = toxicity.score(df, lexicon).collect()
    assert all((r.score >= 0.7) == bool(r.toxic) for r in out)


def test_disguised_words(spark, lexicon):
    texts = ["kalatalo 1d10tx puu schuft1g vesi", "kalatalo IDIÖTX puu ѕсhuftig", "kalatalo puu vesi", "kalatalo clownx fish puu vesi talo"]
    out = toxicity.score(spark.createDataFrame([(t,) for t in texts], "text string"), lexicon).collect()
    assert [r.score >= 0.7 for r in sorted(out, key=lambda r: texts.index(r.text))] == [True, True, False, False]


def test_toxic_odd_rows(spark, lexicon):
    rows = [(None, None), (1, ""), (2, "kalatalo " * 50000), (2, "kalatalo " * 50000), (3, "idiotx")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("score", F.lit("old"))
    out = {r.doc_id: r.score for r in toxicity.score(df, lexicon).collect()}
    assert out[None] == out[1] == out[2] < 0.5 < out[3]
    assert toxicity.score(df.limit(0), lexicon).count() == 0
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(df, toxicity.fit(df, none)).collect()} == {0.0}


def test_toxic_query(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = query.queries["op8_toxicity"](spark, SF).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted for r in got if not r.toxic) <= 0.02 * sum(not r.toxic for r in got)
    assert sum(r.predicted for r in got if r.toxic) >= 0.6 * sum(r.toxic for r in got)  # 33 toxic labels to learn from


# --- pipeline

def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    kept = {r.doc_id: r for r in out.collect()}
    assert len(kept) == out.count() and set(docs.columns) <= set(out.columns)
    # toxicity
    toxic = {r.doc_id for r in query.queries["op8_toxicity"](spark, SF).filter("predicted = 1").collect()}
    rest = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in toxic}
    # near copies: five-word shingles, 0.8
    sets = {}
    for i, text in rest.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    by_shingle = {}
    for i, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in by_shingle.values() for n, a in enumerate(ids) for b in ids[n + 1 :]}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    rest = {i: t.encode() for i, t in rest.items() if find(i) == i}
    # earlier strings of 100 bytes
    seen, texts = set(), {}
    for i in sorted(rest):
        b = rest[i]
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            else:
                seen.add(b[s : s + 100])
        left = bytes(x for x, g in zip(b, gone) if not g)
        if left or not b:
            texts[i] = left.decode(errors="ignore")
    # benchmark items: word edit distance up to a fifth
    items = [re.sub("[A-Z]", lambda m: m[0].lower(), r.text).split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def holds(text, item):
        e = int(0.2 * len(item))
        row = list(range(len(item) + 1))
        for t in text:
            new = [0]
            for j, p in enumerate(item, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (p != t)))
            row = new
            if row[-1] <= e:
                return True
        return False
    common = [set(x) for x in items]
    for i in list(texts):
        text = re.sub("[A-Z]", lambda m: m[0].lower(), texts[i]).split()
        words = set(text)
        if any(len(c & words) >= 0.7 * len(c) and holds(text, item) for c, item in zip(common, items) if len(item) >= 5):
            del texts[i]
    assert {i: r.text for i, r in kept.items()} == texts
    assert all(r.n_chars == len(r.text) and r.copies >= 1 for r in kept.values())


def test_stages_judge_rows_one_by_one(spark, tmp_path):
    same = " ".join(f"w{i}" for i in range(60))
    item = " ".join(f"q{i}" for i in range(20))
    other = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    rows = [(None, same, "s"), (None, same, "s"), (None, same + " x", "s"), (5, same, "s"), (7, same + " y", "s"), (5, other[0], "s"),
            (None, other[1], "s"), (None, "", "s"), (None, None, "s"), (8, other[2], "t"), (8, other[2], "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, df, str(tmp_path)).collect()]
    copies = [r for r in kept if r[1] and r[1].startswith(same)]
    assert len(copies) == 1 and copies[0][0] is None
    assert sorted((r for r in kept if r not in copies), key=str) == sorted(
        [(5, other[0], "s"), (None, other[1], "s"), (None, "", "s"), (None, None, "s"), (8, other[2], "s")], key=str)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, "before " + item, "s"), (None, other[0], "s"), (3, item, "s"), (3, other[1], "s"), (4, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [tuple(r) for r in corpus_pipeline.drop_contaminated(spark, df, str(tmp_path)).collect()]
    assert sorted(kept, key=str) == sorted([rows[1], rows[3], rows[4]], key=str)
