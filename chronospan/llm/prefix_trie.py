"""Trie of the prefixes that conversations share, from the sorted conversations and the lengths of their neighbours' common prefixes.

A conversation is a sequence of 128-bit digests, one for each turn. Sorted (by sequence, then id) and cut into blocks of consecutive
ones, two neighbours share as many turns as their common prefix is long; a node of depth d holds the conversations between two places
where that length falls below d. So the trie is the Cartesian tree over the array of these lengths, with equal ones merged into one
node and each depth between a node and its parent made a node of its own.

Nodes that lie within a block are finished there, by one sweep with a stack (the nearest smaller lengths on both sides). The other ones
are the prefixes that stand open at a block's border, at most as many as two neighbours share; each block hands on its part of them.
A part belongs to the node that begins in the nearest block to the left whose smallest length is below the depth, which the list of
block minima tells every block at once; parts of a node are then summed (counts, leaves, savings, smallest id).

Memory: a task holds one block of the sorted table, 20 bytes a turn. The digests of one conversation must fit in a task (400 turns take
8 kB, a million turns 20 MB); their texts never meet. The hash over the ids that end in a node is fed piece by piece.

Results in special cases: rows without conv_id belong to no conversation; null roles and texts are empty; turns of equal number are
ordered by digest; turns that repeat count each; an empty table has no nodes, not even the root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import discard, shared_folder, written

DIGEST = 16
NO_IDS = hashlib.sha256(b"").hexdigest()
_NODES = (
    "block int, is_open boolean, start int, depth int, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends string, ends_sha256 string, parent_conv_id long, parent_start int"
)


def rebuilt(conversations: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, seq, words): conversation c begins with the first h turns of conversation c - c % group and goes on with its own after
    its first h; h is crc32(c) modulo ``most``. seq holds a digest of 16 bytes for each turn, words their numbers of words."""
    rows = conversations.where(F.col("conv_id").isNotNull())
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    rows = rows.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), F.struct(F.col("turn"), digest.alias("digest"), words.alias("words")).alias("turn"))
    # Dealt by base once: the groups of conversations and the join with their base need no other exchange.
    own = rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    heads = own.where("conv_id = base").select("base", F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    joined = own.join(heads, "base", "left").withColumn("h", h)
    first = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    turns = F.concat(first, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))))
    joined = joined.select("conv_id", turns.alias("turns"))
    return joined.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("seq"), F.col("turns.words").alias("words"))


def common(a: bytes, b: bytes) -> int:
    """How many turns two sequences share at their beginning."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:  # the first ``low`` turns agree
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low * DIGEST : middle * DIGEST] == b[low * DIGEST : middle * DIGEST] else (low, middle - 1)
    return low


class _Part:
    """What a block holds of one node: of all of it, or of what lies within the block."""

    __slots__ = ("start", "depth", "words", "n", "least", "children", "leaves", "saved", "ends", "rows", "inner", "begun")

    def __init__(self, start: int, depth: int, words: int, begun: bool):
        self.start, self.depth, self.words, self.begun = start, depth, words, begun
        self.n = self.children = self.leaves = self.saved = 0
        self.least, self.ends, self.rows, self.inner = None, [], [], False


def block_nodes(block: int, convs: list[tuple[bytes, int, list[int]]], left: int, right: int, starts: list[int]) -> list[list]:
    """The nodes of one block, and its parts of nodes that reach beyond it, in the columns of _NODES.

    convs: (seq, conv_id, words), sorted. left, right: turns shared with the conversation before and behind the block, -1 where there
    is none. starts: for each depth up to left, the block in which the node of that depth begins.
    """
    out: list[list] = []
    stack: list[_Part] = []

    def close(ended: bool) -> None:
        x = stack.pop()
        up = stack[-1] if stack else None
        if ended and not x.inner:
            x.leaves = 1
        x.saved += x.n * x.words - x.begun * x.words
        if up:
            up.n, up.leaves, up.saved, up.inner = up.n + x.n, up.leaves + x.leaves, up.saved + x.saved, True
            up.least = x.least if up.least is None else min(up.least, x.least)
        ids, whole = ",".join(map(str, x.ends)), ended and x.begun
        # Of a part, parent_start says where the parent begins; it counts where the node itself begins.
        row = [block, not whole, x.start, x.depth, x.least, x.n, x.children, x.leaves, x.saved, None if whole else ids, hashlib.sha256(ids.encode()).hexdigest() if whole else None, None, up.start if up and not whole else None]
        for r in x.rows:
            r[11 if whole else 12] = x.least if whole else x.start
        if whole and up:
            up.rows.append(row)
        out.append(row)

    before = None
    for k, (seq, conv_id, words) in enumerate(convs):
        shared = common(before, seq) if k else left
        if k:
            while len(stack) > shared + 1:
                close(True)
        else:
            stack += [_Part(starts[d], d, words[d - 1] if d else 0, False) for d in range(left + 1)]
        for d in range(shared + 1, len(words) + 1):
            if d:
                stack[-1].children += 1
            stack.append(_Part(block, d, words[d - 1] if d else 0, True))
        top = stack[-1]
        top.n += 1
        top.least = conv_id if top.least is None else min(top.least, conv_id)
        top.ends.append(conv_id)
        before = seq
    while stack:
        close(len(stack) > right + 1)
    return out


def _borders(order: DataFrame) -> list[tuple[int, int, int]]:
    """(block, turns shared with the block before, smallest number that two neighbours in it share) by block: three integers for each
    partition of the sorted table. Of sorted sequences the first and the last share what the two neighbours with least in common do."""
    ends = order.groupBy("block").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    ends = ends.withColumn("before", F.lag("last").over(Window.orderBy("block")))

    def run(batches):
        for b in batches:
            first, last, before = (b.column(c).to_pylist() for c in ("first", "last", "before"))
            left = [-1 if p is None else common(p, f) for p, f in zip(before, first, strict=True)]
            yield pa.record_batch([b.column("block"), pa.array(left, pa.int32()), pa.array(map(common, first, last), pa.int32())], ["block", "left", "inner"])

    return sorted(tuple(r) for r in ends.mapInArrow(run, "block int, left int, inner int").collect())


def _hashed_ends(parts: DataFrame) -> DataFrame:
    """(start, depth, ends_sha256): the hash over the ids of all parts, in the order of their blocks. One piece at a time is in memory."""

    def run(batches):
        key, state, keys, out = None, None, [], []
        for b in batches:
            for start, depth, ends in zip(*(b.column(c).to_pylist() for c in ("start", "depth", "ends")), strict=True):
                if (start, depth) == key:
                    state.update(b",")
                else:
                    if state:
                        keys.append(key)
                        out.append(state.hexdigest())
                    key, state = (start, depth), hashlib.sha256()
                state.update(ends.encode())
        if state:
            keys.append(key)
            out.append(state.hexdigest())
        yield pa.record_batch([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array(out, pa.string())], ["start", "depth", "ends_sha256"])

    some = parts.where("ends != ''").select("start", "depth", "block", "ends")
    return some.repartition("start", "depth").sortWithinPartitions("start", "depth", "block").mapInArrow(run, "start int, depth int, ends_sha256 string")


def trie(convs: DataFrame) -> DataFrame:
    """The nodes of conversations (conv_id, seq, words), as the query's contract names them."""
    spark = convs.sparkSession
    raw, by_block = shared_folder(spark, "trie-convs"), shared_folder(spark, "trie-sorted")
    convs = written(convs, "", raw)
    order = convs.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").withColumn("block", F.spark_partition_id())
    order = written(order, "", by_block)
    discard(spark, raw)
    borders = _borders(order)
    numbers = np.array([b for b, _, _ in borders], np.int64)
    minima = np.array([min(left, inner) for _, left, inner in borders], np.int64)
    lefts = [left for _, left, _ in borders]

    def run(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        at = int(np.searchsorted(numbers, block))
        starts = [int(numbers[np.flatnonzero(minima[:at] < d)[-1]]) for d in range(lefts[at] + 1)]
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("seq", "conv_id", "words")), strict=True))
        found = block_nodes(block, rows, lefts[at], lefts[at + 1] if at + 1 < len(lefts) else -1, starts)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

    nodes = written(order.groupBy("block").applyInArrow(run, _NODES), "trie-nodes")
    discard(spark, by_block)
    parts = nodes.where("is_open")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = parts.groupBy("start", "depth").agg(F.min("conv_id").alias("conv_id"), *sums, F.max(F.when(F.col("block") == F.col("start"), F.col("parent_start"))).alias("parent_start"))
    # Where a node's parent is open, its block knows where the parent begins; its smallest member comes back to the block.
    known = parts.select("block", "start", "depth").join(merged.select("start", "depth", "conv_id"), ["start", "depth"])
    known = known.select(F.col("block").alias("_b"), F.col("start").alias("_s"), (F.col("depth") + 1).alias("_d"), F.col("conv_id").alias("_c"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = merged.join(_hashed_ends(parts), ["start", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_IDS))).withColumn("block", F.col("start"))
    asking = nodes.where("not is_open and parent_start is not null").drop("parent_conv_id", "is_open", "ends")
    asking = asking.unionByName(whole.where("depth > 0"))
    met = (F.col("block") == F.col("_b")) & (F.col("parent_start") == F.col("_s")) & (F.col("depth") == F.col("_d"))
    answered = asking.join(known, met).withColumn("parent_conv_id", F.col("_c")).select(columns)
    top = whole.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(columns)
    done = nodes.where("not is_open and parent_start is null").select(columns)
    return done.unionByName(answered).unionByName(top).withColumn("depth", F.col("depth").cast("long"))


_ARROW = pa.schema([
    ("block", pa.int32()), ("is_open", pa.bool_()), ("start", pa.int32()), ("depth", pa.int32()), ("conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()), ("ends_sha256", pa.string()),
    ("parent_conv_id", pa.int64()), ("parent_start", pa.int32()),
])
