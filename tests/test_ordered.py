"""The blocked plan must give what the plain window plan gives, on lists of any length."""

import itertools
import random

import pytest

from pyspark.sql import functions as F

from mixframe.operators import credits, cue_jobs, match, ordered as O, tracks as T


def sample(spark, seed=1, keys=4, rows=23):
    rng = random.Random(seed)
    data = [(k, p, rng.choice([None, 1, 2, 5]), rng.choice(["a", "b", None]))
            for k in range(keys) for p in range(1, rng.randint(1, rows) + 1)]
    return spark.createDataFrame(data, "tl_id bigint, pos int, v int, s string")


def rows(df):
    return sorted(map(str, df.collect()))


def specs():
    v, s = F.col("v"), F.col("s")
    return dict(a=O.sum_before(v), b=O.sum_upto(v), c=O.max_before(v), d=O.max_upto(v), e=O.last_before(s),
                f=O.last_upto(s), g=O.first_after(s), h=O.first_from(s), i=O.lag(s), j=O.lead(s),
                k=O.total("sum", v), m=O.total("max", v))


def test_blocks_equal_windows(spark):
    for seed in range(4):
        df = sample(spark, seed)
        plain = O.scan(df, "tl_id", "pos", None, **specs())
        for block in (2, 3, 7):
            assert rows(O.scan(df, "tl_id", "pos", None, block=block, **specs())) == rows(plain)


def test_dense_pos_by_range_sort(spark):
    df = sample(spark, 3).withColumn("o", F.col("pos") * 10).drop("pos")
    assert rows(O.dense_pos(df, "tl_id", ["o"], None)) == rows(O.dense_pos(df, "tl_id", ["o"], None, block=2))


def test_emit_and_renumber(spark):
    df = sample(spark, 5)
    many = F.when(F.col("v") == 1, F.array().cast("array<struct<x:int>>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.coalesce("v", F.lit(1))), lambda i: F.struct(i.alias("x"))))
    a, b = (O.emit(df, "tl_id", "pos", many, None, block=n) for n in (0, 3))
    assert rows(a) == rows(b)
    per = a.groupBy("tl_id").agg(F.max("pos").alias("m"), F.count("*").alias("n"))
    assert per.where("m <> n").isEmpty()


def tracks(spark, seed):
    rng = random.Random(seed)
    cues = ["00", "07", "1?", "??", None, "1:05", "0??", "112"]
    data = [(k, p, rng.choice(["track"] * 4 + ["gap"]), rng.choice(cues), rng.choice(["?", "A - B", "C - D"]), None,
             rng.choice([10, 60, 400]), 100 * p, 100 * p + rng.choice([-5, 20, 99]), rng.random() < .2)
            for k in range(5) for p in range(1, rng.randint(2, 20))]
    return spark.createDataFrame(data, "tl_id bigint, pos int, type string, cue string, text string, label string, "
                                       "dur_s int, start_s int, end_s int, is_heading boolean")


def test_jobs_on_long_mixes(spark, monkeypatch):
    """Every mix counts as long once a block holds three rows."""
    t = tracks(spark, 9)
    release = t.withColumnRenamed("tl_id", "release_id")
    total = t.groupBy("tl_id").agg((F.max("end_s") + 300).alias("total_s"))
    jobs = [lambda: T.cues_from_durations(t), lambda: T.release_cues(release), lambda: T.release_totals(release),
            lambda: T.insert_gaps_from_segments(t, total), lambda: T.insert_gaps_from_starts(t),
            lambda: T.mark_false_unknowns(t), lambda: T.drop_adjacent_repeats(t), lambda: T.carry_headings(t),
            lambda: cue_jobs.infer_hours(t), lambda: cue_jobs.fill_cue_prefix(t)]
    plain = [rows(j()) for j in jobs]
    monkeypatch.setattr(O, "BLOCK", 3)
    assert [rows(j()) for j in jobs] == plain


def pair_rows(spark, seed, n=40):
    rng = random.Random(seed)
    words = ["night", "train", "deep", "acid", "house", "blue", "moon", "echo"]
    def line():
        return " ".join(rng.sample(words, 2)) + " - " + " ".join(rng.sample(words, 3))
    base = [line() for _ in range(n)]
    def typo(t):
        i = rng.randrange(len(t))
        return t[:i] + rng.choice("xyz ") + t[i + 1:]
    o = [(1, i + 1, "track", t) for i, t in enumerate(base)]
    c = [(1, i + 1, "track", rng.choice([t, typo(t), typo(typo(t)), line()])) for i, t in enumerate(base)]
    schema = "pair_id int, pos int, type string, text string"
    return spark.createDataFrame(c, schema), spark.createDataFrame(o, schema)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def alike(a, b):
    return 1 - edits(a, b) / max(len(a), len(b))


def subset_texts(names, title):
    names = sorted(n.lower() for n in names)
    return [" & ".join(c) + " - " + title.lower() for k in range(1, len(names) + 1) for c in itertools.combinations(names, k)]


def test_rings_find_the_best(spark):
    cand, orig = pair_rows(spark, 2)
    got = {r.pos: (r.target_pos, round(r.score, 9)) for r in match.best_match(match.track_norms(cand), match.track_norms(orig)).collect()}
    lines = [r.text for r in orig.orderBy("pos").collect()]
    for r in cand.collect():
        best = max((round(alike(r.text.strip(), o.strip()), 9), -p) for p, o in enumerate(lines, 1))
        assert got[r.pos] == (-best[1], best[0]), r.text


def test_best_subset_is_what_brute_force_finds():
    rng = random.Random(11)
    for _ in range(150):
        word = lambda n: "".join(rng.choices("abc", k=rng.randint(1, n)))
        a = sorted({word(4) for _ in range(rng.randint(1, 5))})
        b = sorted({rng.choice(a) if rng.random() < 0.4 else word(4) for _ in range(rng.randint(1, 4))})
        s, t = word(8), word(8)
        want = max(alike(x, y) for x in subset_texts(a, s) for y in subset_texts(b, t))
        assert abs(credits.best_similarity(credits.graph(a, s), credits.graph(b, t)) - want) < 1e-9
        assert abs(credits.best_similarity(credits.graph(a, s), credits.graph(b, t), 0.8) - max(want, 0.8)) < 1e-9


def test_three_artists_against_two(spark):
    schema = "pair_id int, pos int, type string, text string"
    cand = spark.createDataFrame([(1, 1, "track", "Al & Bo - Song"), (1, 2, "track", "Xi, Yo & Zed - Other tune")], schema)
    orig = spark.createDataFrame([(1, 1, "track", "Al & Bo & Cy - Snog"), (1, 2, "track", "Zedd, Xi & Quo - Other tunes")], schema)
    cn, on = match.track_norms(cand), match.track_norms(orig)
    best = {r.pos: (r.target_pos, r.score) for r in match.best_match(cn, on).collect()}
    assert best[1] == (1, pytest.approx(12 / 14))
    exact = match.match_tracks_exact(cn, on)
    assert {(r.cand_pos, r.orig_pos) for r in match.match_tracks_fuzzy(cn, on, exact).collect()} == {(1, 1), (2, 2)}


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.95])
def test_every_similar_subset_is_found(spark, threshold):
    """One to twelve artists; a candidate is matched just when some subset of its names is alike."""
    rng = random.Random(int(threshold * 100))
    pool = ["Al", "Bo", "Cy", "Dee", "Echo", "Fay", "Gus", "Hal", "Ivy", "Jo", "Kim", "Lou", "Moe", "Nan"]
    def line(n, title):
        names = rng.sample(pool, n)
        if rng.random() < 0.5:
            names[0] = names[0][:-1] + "q"
        return names, title
    titles = ["Night", "Nigth", "Deep Blue", "Deep Blu", "Long Way Down", "Acid", "Train"]
    c = [line(n, rng.choice(titles)) for n in (1, 2, 3, 4, 5, 3, 2, 6, 3, 12)]
    o = [line(n, rng.choice(titles)) for n in (3, 1, 2, 5, 4, 3, 2, 7, 3)]
    schema = "pair_id int, pos int, type string, text string"
    rows_of = lambda side: spark.createDataFrame([(1, i + 1, "track", " & ".join(a) + " - " + t) for i, (a, t) in enumerate(side)], schema)
    cn, on = match.track_norms(rows_of(c)), match.track_norms(rows_of(o))
    exact = match.match_tracks_exact(cn, on)
    got = {r.cand_pos for r in exact.unionByName(match.match_tracks_fuzzy(cn, on, exact, threshold)).collect()}
    graphs = [[credits.graph(sorted(n.lower() for n in a), t.lower()) for a, t in side] for side in (c, o)]
    best = {i + 1: max(credits.best_similarity(x, y) for y in graphs[1]) for i, x in enumerate(graphs[0])}
    assert {i for i, s in best.items() if s >= threshold and len(c[i - 1][0]) >= 3} <= got
    assert all(best[i] >= threshold - 1e-9 for i in got)
    scores = {r.pos: r.score for r in match.best_match(cn, on).collect()}
    for i, (a, t) in enumerate(c[:-1], 1):
        want = max(alike(x, y) for x in subset_texts(a, t) for b, s in o if len(b) < 6 for y in subset_texts(b, s)) if len(a) < 6 else best[i]
        assert want - 1e-9 <= scores[i] and abs(scores[i] - best[i]) < 1e-9


@pytest.mark.parametrize("threshold", [0.8, 0.6, 0.95])
def test_fuzzy_is_what_brute_force_finds(spark, threshold):
    cand, orig = pair_rows(spark, 7, 25)
    c = [r.text.lower() for r in cand.orderBy("pos").collect()]
    o = [r.text.lower() for r in orig.orderBy("pos").collect()]

    def distance(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
            prev = cur
        return prev[-1]

    def similar(a, b):
        n = max(len(a), len(b))
        return abs(len(a) - len(b)) <= int((1 - threshold) * n) and (n - distance(a, b)) / n >= threshold

    def norm(t):
        return " ".join(t.split())

    want = {}
    for i, text in enumerate(map(norm, c), 1):
        originals = list(enumerate(map(norm, o), 1))
        same = [p for p, t in originals if t == text]
        if same:
            want[i] = same[-1]
            continue
        pool = [(p, t) for p, t in originals if t[0] == text[0]] or originals
        near = sorted(((p, t) for p, t in originals if abs(len(t) - len(text)) <= 6), key=lambda x: (len(x[1]), x[0]))
        if near and len(near) < len(pool):
            pool = near
        hit = next((p for p, t in pool if similar(t, text)), None)
        if hit:
            want[i] = hit
    cn, on = match.track_norms(cand), match.track_norms(orig)
    exact = match.match_tracks_exact(cn, on)
    both = exact.unionByName(match.match_tracks_fuzzy(cn, on, exact, threshold))
    assert {r.cand_pos: r.orig_pos for r in both.collect()} == want
