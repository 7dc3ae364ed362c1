"""Conversation prefix trie: which beginnings conversations share, and what storing them once would save.

Turns become numbers of 128 bits, and a conversation a sequence of them.  Distinct sequences are range-sorted;
each run of neighbours is a shard that fits a task.  A shard gives its turns a dictionary of its own and keeps its
sequences in a ternary search tree: a node has a turn, a lower, an equal and a higher link, and sequences go in by
medians, which keeps the tree balanced.  One pass over the nodes, children first, sums members, leaves and savings.

A node whose subtree may go on in another shard (a beginning of the first or last sequence) is a boundary node.
Boundary nodes of one identity are merged, and their subtrees summed along ancestors in doubling steps.
A sequence longer than ``BLOCK_TURNS`` is cut into blocks, each inserted below the node where the one before ends;
the nodes above such a cut are boundary nodes too, so no conversation has to fit a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import dense_pos
from ..session import stage

#: Turns of one block of a conversation, and of one shard at most (one block always fits).  They change the speed only.
BLOCK_TURNS = 4096
SHARD_TURNS = 1 << 16

NODE = ("shard binary, whole boolean, k1 long, k2 long, p1 long, p2 long, depth long, conv_id long, parent_conv_id long, n_convs long, "
        "n_children long, n_leaves long, saved long, chars long, ends string")


def encoded(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, id1, id2, chars)`` of rows ``(conv_id, turn, role, text)``: numbered from 1, turns as numbers.

    Rows come by turn, null first, then by role and text; a null role or text is empty; a repeated row is
    another turn; rows without a conv_id belong to no conversation and are left out.
    """
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = dense_pos(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], None)
    return rows.select("conv_id", F.col("pos").cast("long").alias("pos"), F.xxhash64(F.lit(1), "role", "text").alias("id1"),
                       F.xxhash64(F.lit(2), "text", "role").alias("id2"), F.char_length("text").cast("long").alias("chars"))


def with_heads(turns: DataFrame, convs: DataFrame, source: Column, size: Column, most: int) -> DataFrame:
    """The turns of ``convs`` (one row per conv_id) with the first ``size`` (``most`` at most) replaced by those of conversation ``source``."""
    plan = convs.select("conv_id", source.alias("source"), size.cast("long").alias("size"))
    heads = plan.join(turns.filter(F.col("pos") <= most).withColumnRenamed("conv_id", "source"), "source").filter("pos <= size")
    own = turns.join(plan, "conv_id").filter("pos > size")
    return heads.select(turns.columns).unionByName(own.select(turns.columns))


def _blocks(turns: DataFrame, convs: DataFrame, block_turns: int) -> DataFrame:
    """A row per block of a conversation: what identifies the node above (p) and the node at its end (k), and its turns."""
    placed = dense_pos(turns, "conv_id", [F.col("pos")], None, name="place").select(
        "conv_id", F.col("place").cast("long").alias("place"), F.xxhash64(F.lit(3), "id1", "id2", "place").alias("z1"),
        F.xxhash64(F.lit(4), "id2", "id1", "place").alias("z2"), "chars")
    blocks = placed.withColumn("block", F.expr(f"(place - 1) div {block_turns}")).groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("place", "z1", "z2", "chars"))).alias("turns"), F.bit_xor("z1").alias("x1"), F.bit_xor("z2").alias("x2"))
    empty = convs.select("conv_id").join(blocks.select("conv_id").filter("block = 0"), "conv_id", "left_anti").select(
        "conv_id", F.lit(0).cast("long").alias("block"), F.array().cast("array<struct<place:bigint,z1:bigint,z2:bigint,chars:bigint>>").alias("turns"),
        F.lit(0).cast("long").alias("x1"), F.lit(0).cast("long").alias("x2"))
    upto = Window.partitionBy("conv_id").orderBy("block")
    return blocks.unionByName(empty).select(
        "*", F.bit_xor("x1").over(upto).alias("k1"), F.bit_xor("x2").over(upto).alias("k2"), F.lead("block").over(upto).isNull().alias("ends")).select(
        "conv_id", "block", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "k1", "k2", "turns", "ends")


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (k1, k2, conv_id) in this order: SHA-256 of the ids of each key, comma-joined, one batch in memory at a time."""
    key, digest = None, None
    for batch in batches:
        k1, k2, ids = (c.to_numpy() for c in batch.columns)
        if not len(ids):
            continue
        first = np.flatnonzero(np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))))
        done = []
        for a, b in zip(first, np.append(first[1:], len(ids))):
            now, text = (int(k1[a]), int(k2[a])), ",".join(map(str, ids[a:b].tolist())).encode()
            if now == key:
                digest.update(b"," + text)
            else:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = now, hashlib.sha256(text)
        yield _table(done, ["k1", "k2", "ends"], [pa.int64(), pa.int64(), pa.string()])
    if key is not None:
        yield _table([(*key, digest.hexdigest())], ["k1", "k2", "ends"], [pa.int64(), pa.int64(), pa.string()])


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


class Tree:
    """A ternary search tree over sequences of numbers; node 0 is the node above all of them."""

    def __init__(self):
        self.turn, self.lower, self.equal, self.higher, self.up = [-1], [0], [0], [0], [-1]
        self.n_convs, self.conv_id, self.ends, self.at = [0], [None], [None], [None]

    def _new(self, turn: int, up: int, at: int) -> int:
        for column, value in ((self.turn, turn), (self.lower, 0), (self.equal, 0), (self.higher, 0), (self.up, up),
                              (self.n_convs, 0), (self.conv_id, None), (self.ends, None), (self.at, at)):
            column.append(value)
        return len(self.turn) - 1

    def insert(self, sequence: list[int], n_convs: int, conv_id: int, ends: str | None, offset: int) -> int:
        """Adds the members of one sequence along its path; ``offset`` is where its turns stand in the shard."""
        turn, lower, equal, higher = self.turn, self.lower, self.equal, self.higher
        node = 0
        self._count(0, n_convs, conv_id)
        for place, wanted in enumerate(sequence, offset):
            child = equal[node]
            if not child:
                child = equal[node] = self._new(wanted, node, place)
            while turn[child] != wanted:
                links = lower if wanted < turn[child] else higher
                if not links[child]:
                    links[child] = self._new(wanted, node, place)
                child = links[child]
            node = child
            self._count(node, n_convs, conv_id)
        if ends is not None:
            self.ends[node] = ends
        return node

    def _count(self, node: int, n_convs: int, conv_id: int) -> None:
        self.n_convs[node] += n_convs
        if self.conv_id[node] is None or conv_id < self.conv_id[node]:
            self.conv_id[node] = conv_id

    def path(self, node: int) -> Iterator[int]:
        while node >= 0:
            yield node
            node = self.up[node]


def by_medians(count: int) -> Iterator[int]:
    """0 .. count - 1, the middle first, then the middles of both sides, and so on."""
    spans = [(0, count)]
    for low, high in spans:  # grows while it is read
        if low < high:
            middle = (low + high) // 2
            yield middle
            spans += [(low, middle), (middle + 1, high)]


def shard_nodes(block: int, above: tuple[int, int], rows: list[tuple], block_turns: int) -> list[tuple]:
    """The nodes of a sorted run of sequences below one node, as NODE rows.

    ``rows``: (z1, z2, chars) as arrays, members, smallest conv_id, digest of the ids that end here, goes on.
    """
    lengths = np.array([len(r[0]) for r in rows])
    starts = np.concatenate(([0], np.cumsum(lengths)))
    z1, z2, chars = (np.concatenate([r[k] for r in rows]) for k in range(3))
    pairs = np.rec.fromarrays([z1, z2])
    words = np.unique(pairs, return_inverse=True)[1].tolist()  # the dictionary of the shard, in the order of the turns
    tree, last = Tree(), [0] * len(rows)
    for i in by_medians(len(rows)):
        _, _, _, n_convs, conv_id, ends, _ = rows[i]
        last[i] = tree.insert(words[starts[i] : starts[i + 1]], n_convs, conv_id, ends, int(starts[i]))
    nodes = len(tree.turn)
    shared = [False] * nodes  # boundary nodes
    for i, row in enumerate(rows):
        if i in (0, len(rows) - 1) or row[6]:
            for node in tree.path(last[i]):
                if shared[node]:
                    break
                shared[node] = True
    # children stand behind their parents, so one pass from the back sums each subtree before it is added above
    n_children, n_leaves, saved = [0] * nodes, [0] * nodes, [0] * nodes
    z1, z2, chars = z1.tolist(), z2.tolist(), chars.tolist()
    for node in range(nodes - 1, 0, -1):
        up = tree.up[node]
        if not shared[node]:
            n_leaves[node] += n_children[node] == 0
            saved[node] += (tree.n_convs[node] - 1) * chars[tree.at[node]]
            n_children[up] += 1
            n_leaves[up] += n_leaves[node]
            saved[up] += saved[node]
    shard = hashlib.sha256(repr((block, above, tree.n_convs[0], z1[: lengths[0]], z2[: lengths[0]], int(lengths[0]))).encode()).digest()[:16]
    k1, k2, depth, out = [above[0]] * nodes, [above[1]] * nodes, [block * block_turns] * nodes, []
    for node in range(nodes):
        up, at = tree.up[node], tree.at[node]
        if node:
            k1[node], k2[node], depth[node] = k1[up] ^ z1[at], k2[up] ^ z2[at], depth[up] + 1
            out.append((shard, not shared[node], k1[node], k2[node], k1[up], k2[up], depth[node], tree.conv_id[node], None if shared[up] else tree.conv_id[up],
                        tree.n_convs[node], n_children[node], n_leaves[node], saved[node], chars[at], tree.ends[node]))
        elif block:  # counted by the block above, which ends in this node
            out.append((shard, False, *above, None, None, depth[0], None, None, 0, n_children[0], n_leaves[0], saved[0], None, None))
        else:
            out.append((shard, False, *above, None, None, 0, tree.conv_id[0], None, tree.n_convs[0], n_children[0], n_leaves[0], saved[0], 0, tree.ends[0]))
    return out


def _shard_batches(batches: Iterator[pa.RecordBatch], block_turns: int, shard_turns: int) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in NODE.split(", ")]
    types = [{"binary": pa.binary(), "boolean": pa.bool_(), "long": pa.int64(), "string": pa.string()}[f.split()[1]] for f in NODE.split(", ")]
    key, rows, held = None, [], 0
    for batch in batches:
        turns = batch.column("turns")
        begin, flat = turns.offsets.to_numpy(), turns.flatten()
        base = begin[0]
        z1, z2, chars = (flat.field(flat.type.get_field_index(n)).to_numpy() for n in ("z1", "z2", "chars"))
        others = zip(*(batch.column(n).to_pylist() for n in ("block", "p1", "p2", "n_convs", "conv_id", "ends", "goes_on")))
        for i, (block, p1, p2, n_convs, conv_id, ends, goes_on) in enumerate(others):
            a, b = begin[i] - base, begin[i + 1] - base
            now = (block, p1, p2)
            if rows and (now != key or held + b - a > shard_turns):
                yield _table(shard_nodes(key[0], key[1:], rows, block_turns), names, types)
                rows, held = [], 0
            key = now
            rows.append((z1[a:b].copy(), z2[a:b].copy(), chars[a:b].copy(), n_convs, conv_id, ends, goes_on))
            held += b - a
    if rows:
        yield _table(shard_nodes(key[0], key[1:], rows, block_turns), names, types)


def _merged(parts: DataFrame) -> DataFrame:
    """Boundary nodes over all shards: final columns, and (k1, k2)."""
    merged = stage(parts.groupBy("k1", "k2", "depth").agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("chars").alias("chars"), F.max("ends").alias("ends")), "boundary")
    children = merged.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("more"))
    sums = merged.join(children, ["k1", "k2"], "left").withColumn("n_children", F.col("inner") + F.coalesce("more", F.lit(0)))
    sums = stage(sums.select("k1", "k2", "depth", "p1", "p2", "conv_id", "n_convs", "n_children", "ends",
                             (F.col("leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("n_leaves"),
                             (F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved")), "boundary")
    deepest = sums.agg(F.max("depth")).first()[0] or 0
    # total: sums over the descendants less than `reach` below; (a1, a2): the ancestor `reach` above
    total, reach = sums.select("k1", "k2", F.col("p1").alias("a1"), F.col("p2").alias("a2"), "n_leaves", "saved"), 1
    while reach <= deepest:
        below = total.filter("a1 IS NOT NULL").groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        above = total.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        total = stage(total.join(below, ["k1", "k2"], "left").join(above, ["a1", "a2"], "left").select(
            "k1", "k2", F.col("b1").alias("a1"), F.col("b2").alias("a2"), (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
            (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "boundary-sums")
        reach *= 2
    parents = sums.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    return sums.drop("n_leaves", "saved").join(total.drop("a1", "a2"), ["k1", "k2"]).join(parents, ["p1", "p2"], "left")


def prefix_trie(turns: DataFrame, convs: DataFrame, block_turns: int = BLOCK_TURNS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row per distinct beginning of the conversations, the empty one included.

    ``turns``: ``encoded`` rows, in the order of ``pos`` (holes are closed); ``convs``: one row per conv_id, also
    of conversations without turns, which are members of the root.  Gives ``conv_id`` (the smallest member; its
    turn number ``depth`` is the last of the beginning, which finds the text), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (over the subtree: (members - 1) * code points of
    the last text) and ``ends_sha256`` (of the ids of the members that end here, ascending, comma-joined).
    Without conversations there is no node.
    """
    blocks = stage(_blocks(turns, convs, block_turns), "trie-blocks")
    ends = blocks.filter("ends").select("k1", "k2", "conv_id").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv_id")
    ends = ends.mapInArrow(_digest_batches, "k1 long, k2 long, ends string")
    # blocks of equal turns below one node are one sequence with several members
    distinct = blocks.groupBy("block", "p1", "p2", "k1", "k2").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"),
                                                               F.first("turns").alias("turns"), (~F.every("ends")).alias("goes_on"))
    rows = distinct.join(ends, ["k1", "k2"], "left").select("block", "p1", "p2", "turns", "n_convs", "conv_id", "ends", "goes_on")
    key = ["block", "p1", "p2", "turns"]
    nodes = stage(rows.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(lambda it: _shard_batches(it, block_turns, shard_turns), NODE), "trie-nodes")
    parts, whole = nodes.filter("NOT whole"), nodes.filter("whole")
    merged = stage(_merged(parts), "boundary-nodes")
    # the parent of a whole node is in its own shard: whole, or one of the few boundary nodes of this shard
    known = parts.select("shard", "k1", "k2").join(merged.select("k1", "k2", F.col("conv_id").alias("p_conv_id")), ["k1", "k2"]).select(
        "shard", F.col("k1").alias("p1"), F.col("k2").alias("p2"), "p_conv_id")
    under = whole.filter("parent_conv_id IS NULL").join(known, ["shard", "p1", "p2"]).withColumn("parent_conv_id", F.col("p_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
               F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")]
    return merged.select(columns).unionByName(whole.filter("parent_conv_id IS NOT NULL").select(columns)).unionByName(under.select(columns))
