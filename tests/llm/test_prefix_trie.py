"""The prefix trie against dictionaries of all beginnings."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mixframe.llm import prefix_trie as pt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(seqs):
    """Rows of the trie over {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1]) if node else 0
    return sorted((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children[node], leaves[node], saved[node],
                   hashlib.sha256(",".join(str(c) for c in sorted(convs) if len(seqs[c]) == len(node)).encode()).hexdigest()) for node, convs in members.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


def ordered_turns(rows):
    seqs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            seqs[c].append((-1 if turn is None else 0, turn or 0, role or "", text or ""))
    return {c: [(r, x) for *_, r, x in sorted(s, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))] for c, s in seqs.items()}


def made_up(rng, convs, longest, texts):
    rows = []
    for c in range(-convs // 3, convs):
        for t in range(rng.randint(1, longest)):
            rows.append((c * 7, t, rng.choice(["user", "assistant"]) if t > 2 else "user", rng.choice(texts) * rng.randint(0, 2)))
    return rows


@pytest.mark.parametrize("block,shard", [(1, 1), (2, 5), (3, 20), (4096, 8), (4096, 1 << 16)])
def test_against_dictionaries(spark, block, shard):
    rng = random.Random(block * 31 + shard)
    rows = made_up(rng, 40, 9, ["a", "é😀", "bb"])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = pt.encoded(df)
    assert rows_of(pt.prefix_trie(turns, turns.filter("pos = 1").select("conv_id"), block, shard)) == brute(ordered_turns(rows))


def test_heads_of_other_conversations(spark):
    rng = random.Random(2)
    rows = [(c, t, "user", rng.choice("ab")) for c in [0, 1, 2, 5, 99, 100, 105, 201, 205, -3, -120, 307] for t in range(rng.randint(1, 7))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    seqs, want = ordered_turns(rows), {}
    for c, s in seqs.items():
        h, source = zlib.crc32(str(c).encode()) % 6, c - int(c - 100 * int(c / 100))
        want[c] = seqs.get(source, [])[:h] + s[h:]
    assert any(not s for s in want.values())  # a conversation of which nothing is left is a member of the root
    turns = pt.encoded(df)
    convs, conv = turns.filter("pos = 1").select("conv_id"), F.col("conv_id")
    rebuilt = pt.with_heads(turns, convs, conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6, 5)
    assert rows_of(pt.prefix_trie(rebuilt, convs, 2, 6)) == brute(want)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, None, None), (1, 0, "user", "x"), (2, 0, "", ""), (2, 1, None, None), (None, 0, "user", "lost"),
            (3, 0, "b", "a"), (3, 0, "a", "b"), (4, 0, "user", "long " * 100_000), (5, 0, "user", "long " * 100_000)] + [(6, t, "user", "y") for t in range(700)]
    rows += [(7, t, "user", "y") for t in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(3)).withColumn("id1", F.lit(3)).withColumn("depth", F.lit(3))
    turns = pt.encoded(df)
    assert rows_of(pt.prefix_trie(turns, turns.filter("pos = 1").select("conv_id"), 64, 128)) == brute(ordered_turns(rows))
    none = pt.encoded(df.limit(0))
    assert pt.prefix_trie(none, none.select("conv_id")).count() == 0


def test_digest_of_many_ids(spark):
    rows = [(c, 0, "user", "same") for c in range(30_000)]
    turns = pt.encoded(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        got = rows_of(pt.prefix_trie(turns, turns.select("conv_id")))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(ordered_turns(rows))


def test_medians_balance():
    assert sorted(pt.by_medians(100)) == list(range(100))
    tree = pt.Tree()
    for i in pt.by_medians(1023):
        tree.insert([i], 1, i, None, 0)

    def deep(node):
        steps = [(node, 1)]
        most = 0
        while steps:
            n, d = steps.pop()
            most = max(most, d)
            steps += [(m, d + 1) for m in (tree.lower[n], tree.higher[n]) if m]
        return most
    assert deep(tree.equal[0]) == 10
