"""N-gram Jaccard join against brute force."""

import random
import re

import pytest

from mixframe.llm.ngram_join import similar_groups


def brute(rows, size, percent):
    sets = {}
    for i, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed,size,percent", [(1, 4, 85), (2, 5, 80), (3, 2, 50)])
def test_groups(spark, seed, size, percent):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)]
    rows, n = [], 0
    passage = [rng.choice(words) for _ in range(40)]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        if rng.random() < 0.4:
            base[:0] = passage
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice([*words, "NEW", "Ä"])
            rows.append((n * 7 % 1009, rng.choice([" ", "\t", " \n "]).join(x.upper() if rng.random() < 0.2 and x.isascii() else x for x in copy)))
            n += 1
    rows += [(2000, ""), (2001, None), (2002, " \n"), (2003, "one two"), (2004, "One  two"), (2005, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(df, size, percent).collect()}
    assert got == brute(rows, size, percent)


def test_odd_rows(spark):
    same = " ".join(f"w{i}" for i in range(50))
    rows = [(None, same, 1), (None, None, 1), (5, same, 1), (5, same, 1), (7, same + " x", 2), (9, "", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int").withColumnRenamed("component_id", "class")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similar_groups(df).collect()), key=str)
    assert out == sorted([(None, 46, None), (None, 0, None), (5, 46, None), (5, 46, None), (7, 47, None), (9, 0, 9)], key=str)
    assert similar_groups(df.limit(0)).count() == 0
