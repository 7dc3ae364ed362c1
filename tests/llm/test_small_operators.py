"""Chat formatting, URL filters, decontamination, mixing and embeddings against brute force or exact round trips."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mixframe.llm import chat_format, decontaminate, embedding_dedup, source_mixing, url_filter


# --- chat formatting

def test_round_trip(spark):
    rng = random.Random(4)
    bits = ["### ", "</turn>", "\n", "\\", "#", "###", " ", ":", ": ", "a", "é😀", "### user: ", "<\\/turn>", "#\\## ", "</turn>\n### assistant: ", "\r"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "to:ol", "a: b", "", "x\\"]), "".join(rng.choices(bits, k=rng.randint(0, 9))))
            for c in range(120) for t in range(rng.randint(1, 5))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(df).withColumn("back", chat_format.read_turns(F.col("formatted"))).collect()
    want = {c: [(r, x) for _, _, r, x in g] for c, g in itertools.groupby(rows, key=lambda r: r[0])}
    assert {r.conv_id: [(t.role, t.text) for t in r.back] for r in out} == want
    for r in out:
        assert "".join(s.text for s in r.segments) == r.formatted
        assert [s.loss for s in r.segments] == [x for role, _ in want[r.conv_id] for x in (False, role == "assistant", False)]


@pytest.mark.parametrize("roles,bad", [("sua", None), ("uaua", None), ("ua", None), ("u", 1), ("uu", 1), ("a", 0), ("usa", 1), ("sa", 1), ("uax", 2), ("s", 1)])
def test_turn_order(spark, roles, bad):
    names = {"s": "system", "u": "user", "a": "assistant", "x": None}
    df = spark.createDataFrame([(1, i, names[r], None) for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    row = chat_format.format_chats(df).first()
    assert (row.valid, row.first_bad) == (bad is None, bad)


def test_chat_odd_rows(spark):
    df = spark.createDataFrame([(None, 1, "user", "x"), (None, 1, "user", "x"), (2, None, "user", None), (2, 0, "assistant", "y" * 100000)],
                               "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1)).withColumn("turns", F.lit(2))
    out = {r.conv_id: r for r in chat_format.format_chats(df).collect()}
    assert out[None].formatted.count("user: x") == 2 and out[2].formatted.startswith("### user: </turn>\n### assistant: yyy")
    assert chat_format.format_chats(df.limit(0)).count() == 0


# --- URL filters

def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h) + len(p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[1] if best else "allow"


@pytest.mark.parametrize("parts", ["1", "7"])
def test_urls(spark, parts):
    rng = random.Random(8)
    host = lambda: ".".join(rng.choices(["a", "b", "Org", "com", "ab", "ä"], k=rng.randint(1, 4)))
    path = lambda: "".join(rng.choices(["/", "x", "y", "/x/", "é"], k=rng.randint(0, 4)))
    urls = [rng.choice(["http://", "s://", "", "://"]) + host() + "/" * rng.randint(0, 1) + path() + rng.choice(["", "?q=/x", "#://f"]) for _ in range(600)] + [None, "", "://", "http:///x"]
    rules = list({(h, p): (h, p, v) for h, p, v in ((host().lower(), path(), rng.choice(["allow", "block"])) for _ in range(60))}.values())
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("key", F.lit("z")).withColumn("part", F.lit(1))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out = url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    for i, url in enumerate(urls):
        h, p, rule, verdict = judged(url, rules)
        same_length = {(x, v) for n, v, x in ((len(a) + len(b), v, a + b) for a, b, v in rules if (h == a or h.endswith("." + a)) and p.startswith(b)) if rule and n == len(rule)}
        assert got[i][:2] == (h, p) and ((got[i][2], got[i][3]) == (rule, verdict) or (got[i][2], got[i][3]) in same_length)


def test_urls_odd_rows(spark):
    pages = spark.createDataFrame([(None, "http://a.org/"), (None, "http://a.org/"), (1, None)], "page_id long, url string")
    rules = spark.createDataFrame([("org", "/", "allow"), ("org", "/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    out = url_filter.judge_urls(pages, rules).collect()
    assert sorted(str(tuple(r)) for r in out) == sorted(map(str, [(None, "a.org", "/", "org/", "block")] * 2 + [(1, "", "", None, "allow")]))
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


# --- decontamination

def least_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=70), st.lists(st.integers(0, 3), max_size=90))
def test_myers(pattern, text):
    distance, end = decontaminate.myers(np.array(pattern, dtype=np.uint64), np.array(text, dtype=np.uint64))
    assert distance == least_distance(pattern, text)
    assert distance == len(pattern) or least_distance(pattern, text[:end]) == distance


def test_matches(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(30)]
    docs = []
    for d in range(250):
        text = rng.choices(words, k=rng.randint(0, 60))
        if rng.random() < 0.6:
            piece = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 9)):
                k = rng.randrange(len(piece)) if piece else 0
                piece[k : k + rng.randint(0, 1)] = rng.choice([[], ["new"], [rng.choice(words)]])
            text[len(text) // 2 : len(text) // 2] = piece
        docs.append((d, " ".join(text).upper() if rng.random() < 0.3 else "\n".join(text)))
    df = spark.createDataFrame([*docs, (None, items[0][1]), (900, None), (901, "")], "doc_id long, text string").repartition(3)
    found = decontaminate.benchmark_matches(df, spark.createDataFrame([*items, (77, None), (78, "")], "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.distance for r in found.collect() if r.doc_id is not None}
    want = {}
    for d, text in docs:
        for i, item in items:
            p = item.split()
            distance = least_distance(p, text.lower().split())
            if len(p) >= decontaminate.LEAST_WORDS and distance <= int(decontaminate.EDIT_SHARE * len(p)):
                want[d, i] = distance
    assert got == want and len(want) > 50


def test_matches_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 40)  # several passes
    item = "one two three four five six seven"
    docs = spark.createDataFrame([(None, item, 1), (3, item, 2), (3, item, 2), (4, "x " * 5000 + item, 3)], "doc_id long, text string, distance int").withColumn("item", F.lit(0))
    items = spark.createDataFrame([(1, item), (1, item), (None, item + " eight"), (2, "a b c d e f g h")], "item_id long, text string")
    got = sorted((str(r.doc_id), str(r.item_id), r.distance, r.stop_word) for r in decontaminate.benchmark_matches(docs, items).collect())
    assert got == sorted((d, i, n, s) for d, s in (("None", 7), ("3", 7), ("4", 5007)) for i, n in (("1", 0), ("None", 1)))
    assert decontaminate.benchmark_matches(docs, items.limit(0)).count() == decontaminate.benchmark_matches(docs.limit(0), items).count() == 0


# --- mixing

def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("aaaaaabbbc"), "w " * rng.randint(1, 30)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    out = source_mixing.mix_sources(df, repetitions=2.0).collect()
    tokens = {s: sum(len(t.split()) for _, x, t in rows if x == s) for s in "abc"}
    share = {s: n / sum(tokens.values()) for s, n in tokens.items()}
    exponent = 1 - math.log(2) / math.log(max(share.values()) / min(share.values()))
    power = {s: p**exponent for s, p in share.items()}
    weight = {s: p / sum(power.values()) for s, p in power.items()}
    epochs = {s: weight[s] / share[s] / min(weight[x] / share[x] for x in share) for s in share}
    for s in "abc":
        mine = sorted((r for r in out if r.source == s), key=lambda r: r.position)
        assert math.isclose(mine[0].weight, weight[s], rel_tol=1e-6) and math.isclose(mine[0].epochs, epochs[s], rel_tol=1e-6)
        assert [r.position for r in mine] == list(itertools.accumulate([r.n_tokens for r in mine], initial=0))[:-1]  # a permutation
        drawn = sum(r.n_tokens * r.copies for r in mine)
        assert -1e-6 <= drawn - epochs[s] * tokens[s] < 31 and min(r.copies for r in mine) >= 1
    again = {r.doc_id: r.copies for r in source_mixing.mix_sources(df.repartition(7), repetitions=2.0).collect()}
    assert again == {r.doc_id: r.copies for r in out}
    flat = {r.source: r.weight for r in source_mixing.mix_sources(df, repetitions=None, entropy_share=0.9).collect()}
    entropy = -sum(w * math.log(w) for w in flat.values())
    assert math.isclose(entropy, 0.9 * math.log(3), rel_tol=1e-5)
    small = source_mixing.mix_sources(df, repetitions=2.0, budget_tokens=2000).selectExpr("sum(copies * n_tokens)").first()[0]
    assert 2000 <= small < 2000 + 3 * 31


def test_mixing_odd_rows(spark):
    rows = [(None, None, "a b"), (None, None, "a b"), (1, "x", None), (2, "x", ""), (3, "y", "w " * 30000), (4, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("weight", F.lit(9)).withColumn("bucket", F.lit("q"))
    out = source_mixing.mix_sources(df).collect()
    assert len(out) == 6 and all(r.copies >= 1 and r.bucket == "q" for r in out) and {r.n_tokens for r in out} == {2, 0, 30000, 1}
    assert source_mixing.mix_sources(df.limit(0)).count() == 0


def test_short_items_and_scripts_without_spaces(spark, caplog):
    passage = "北京是中华人民共和国的首都也是全国的政治中心文化中心和国际交往中心"
    thai = "กรุงเทพมหานครเป็นเมืองหลวงและนครที่มีประชากรมากที่สุดของประเทศไทย"
    items = [(1, "photosynthesis converts sunlight"), (2, passage), (3, thai), (4, "yes no"), (5, "two long words elsewhere")]
    docs = [(1, "we know that Photosynthesis\nconverts sunlight well"), (2, "前文很长" * 9 + passage + "后文" * 7), (3, "ก" * 40 + thai[:20] + "x" + thai[21:]),
            (4, "a yes no b"), (5, "photosynthesis turns sunlight"), (6, "前文很长" * 30), (7, "x y " + passage[:10] + "\n" + passage[10:] + " z")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance, r.stop_word) for r in decontaminate.benchmark_matches(df, asked).collect())
    assert got == [(1, 1, 0, 6), (2, 2, 0, 1), (3, 3, 1, 1), (7, 2, 0, 4)]
    assert "['4']" in caplog.text
    assert sorted(r.doc_id for r in decontaminate.without_matches(df, asked).collect()) == [4, 5, 6]


# --- embeddings

def clusters(seed, n=900, dim=24):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 6, dim))
    x = base[rng.integers(0, len(base), n)] + rng.standard_normal((n, dim)) * rng.choice([0.02, 0.15, 0.35], (n, 1))
    x[:60] = x[0]
    return x


@pytest.mark.parametrize("slab", [8192, 100])
def test_embeddings(spark, monkeypatch, slab):
    monkeypatch.setattr(embedding_dedup, "SLAB_ROWS", slab)
    x = clusters(3)
    df = spark.createDataFrame([(i * 2, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.near_groups(df).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    true = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    links = np.array([got[i * 2].n_links for i in range(len(x))])
    assert (links <= true).all() and links.sum() >= 0.95 * true.sum()
    assert all(r.kept == (r.component_id == r.vec_id) and r.component_id <= r.vec_id for r in got.values())


def test_embeddings_odd_rows(spark):
    v, nan = [1.0, 2.0, 3.0], float("nan")
    rows = [(None, v), (2, v), (2, v), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (7, [nan, 1.0, 1.0]), (8, [1.0, 2.0]), (9, [2.0, 4.0, 6.0]), (10, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit(1)).withColumn("id", F.lit(1))
    out = sorted(((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embedding_dedup.near_groups(df).collect()))
    alone = [(str(i), 0, str(i), True) for i in (3, 4, 5, 6, 7, 8, 10)]
    assert out == sorted([("None", 3, "None", True), ("2", 3, "None", False), ("2", 3, "None", False), ("9", 3, "None", False), *alone])
    assert embedding_dedup.near_groups(df.limit(0)).count() == 0


def test_embeddings_without_an_id_are_kept_apart(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(None, a), (None, b), (3, a), (4, b), (4, [0.0, 1.0, 0.01, 0.0]), (5, [0.0, 0.0, 1.0, 0.0])]
    out = embedding_dedup.near_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(((str(r.vec_id), r.n_links, str(r.component_id)) for r in out)) == sorted(
        [("None", 1, "None"), ("None", 2, "None"), ("3", 1, "None"), ("4", 2, "None"), ("4", 2, "None"), ("5", 0, "5")])
