"""SimHash near-duplicates by vantage-point trees over Hamming distance.

Fingerprints are made of 3-word shingles. All distinct fingerprints are cut into shards by a vantage-point tree:
at a node, those within radius m of the vantage point go to the near side, the others to the far side. By the
triangle inequality two fingerprints at distance r or less can lie on different sides only if the far one is at
most m + r from the vantage point; those are also sent to the near side. So every linked pair meets in at least
one shard, whatever the tree: the tree is fitted on a bounded sample, but the result is exact.

In its shard, a tree of the same kind finds the pairs; what leaves the shard is not the pairs but the smallest
member of each one's component there, one row per fingerprint at most. Global components come from those rows by
hooking and pointer jumping, with joins and partial aggregates only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import blocks, discard, fresh, shared_folder, written

#: Fingerprints that the tree of shards is fitted on, at most (8 bytes each).
SAMPLE = 1 << 20
#: Sampled fingerprints per leaf, at least; and the number of fingerprints that a shard should have.
LEAF_SAMPLE, SHARD_ROWS = 8, 4000
#: Below so many, a node compares all its members with each other, in tiles.
SMALL = 256
TILE = 2048

# ---- fingerprints -------------------------------------------------------------------------------------------

#: Entry b has the bits of byte b spread over eight bytes, the lowest bit first.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of the hashes; 0 if there are none."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    for k in range(0, n, 255 * 512):
        part = _SPREAD[hashes[k : k + 255 * 512].astype("<u8").view(np.uint8)].reshape(-1, 8)
        # 255 rows fit into a byte of each lane before it overflows.
        sums = np.add.reduceat(part, np.arange(0, len(part), 255), axis=0)
        counts += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Of UTF-8 bytes: A-Z lower-cased, words joined by single spaces, runs of ``shingle`` words hashed by XXH64 (seed 42)."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return majority_bits(np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    return majority_bits(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n))


def fingerprints(docs: DataFrame, name: str, shingle: int = 3, text: str = "text", drop_text: bool = False) -> DataFrame:
    """docs and a column ``name`` (long): each text's fingerprint, 0 for null and empty ones. drop_text leaves the text out."""
    at = docs.columns.index(text)
    kept = [i for i in range(len(docs.columns)) if not (drop_text and i == at)]
    schema = T.StructType([*[docs.schema.fields[i] for i in kept], T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, at):
                texts = b.column(at).cast(pa.binary()).to_pylist()
                found = np.array([fingerprint(t, shingle) if t else 0 for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], pa.array(found)], schema.names)

    return docs.mapInArrow(run, schema)


# ---- trees --------------------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Inner node i: vantage[i], radius[i], and the nodes (i >= 0) or shards (~shard) on its near and far side."""

    vantage: np.ndarray
    radius: np.ndarray
    near: np.ndarray
    far: np.ndarray
    root: int
    n_shards: int


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def _split(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point and the radius that cut the points most evenly, of a few tried; None if none cuts them."""
    best = None
    for v in points[rng.integers(0, len(points), 5)]:
        d = distance(points, v)
        for m in {int(np.median(d)), int(np.median(d)) - 1}:
            near = int((d <= m).sum())
            size = max(near, len(points) - near)
            if 0 < near < len(points) and (best is None or size < best[0]):
                best = (size, v, m)
    return None if best is None else (best[1], best[2])


def plant(sample: np.ndarray, total: int) -> Tree:
    """A tree over ``total`` fingerprints, of which sample are some, with shards of about SHARD_ROWS of them without overlap.
    It goes no deeper than the sample bears."""
    rng = np.random.default_rng(7)
    vantage, radius, near, far, shards = [], [], [], [], 0

    def grow(points: np.ndarray) -> int:
        nonlocal shards
        cut = None
        if len(points) >= 2 * LEAF_SAMPLE and len(points) * max(1.0, total / max(1, len(sample))) > SHARD_ROWS / 4:
            cut = _split(points, rng)
        if cut is None:
            shards += 1
            return ~(shards - 1)
        i = len(vantage)
        vantage.append(cut[0])
        radius.append(cut[1])
        near.append(0)
        far.append(0)
        inside = distance(points, cut[0]) <= cut[1]
        near[i] = grow(points[inside])
        far[i] = grow(points[~inside])
        return i

    root = grow(sample)
    return Tree(np.array(vantage, np.uint64), np.array(radius, np.int64), np.array(near, np.int64), np.array(far, np.int64), root, shards)


def route(tree: Tree, points: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of point, shard) for every shard that a point belongs to."""
    out_i, out_s = [], []
    todo = [(tree.root, np.arange(len(points)))]
    while todo:
        node, idx = todo.pop()
        if not len(idx):
            continue
        if node < 0:
            out_i.append(idx)
            out_s.append(np.full(len(idx), ~node, np.int64))
            continue
        d, m = distance(points[idx], tree.vantage[node]), tree.radius[node]
        todo += [(int(tree.near[node]), idx[d <= m + r]), (int(tree.far[node]), idx[d > m])]
    return (np.concatenate(out_i), np.concatenate(out_s)) if out_i else (np.empty(0, np.int64), np.empty(0, np.int64))


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after linking a[k] with b[k] for all k; a root is the smallest index of its component."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        hi, lo = np.maximum(x, y)[apart], np.minimum(x, y)[apart]
        np.minimum.at(parent, hi, lo)
        parent = _roots(parent)


def components(points: np.ndarray, r: int) -> np.ndarray:
    """For sorted distinct fingerprints the index of the smallest one in each one's component of links at distance r or less."""
    rng = np.random.default_rng(11)
    parent = np.arange(len(points))
    todo = [np.arange(len(points))]
    while todo:
        idx = todo.pop()
        if len(idx) > SMALL and (cut := _split(points[idx], rng)):
            d = distance(points[idx], cut[0])
            near, far = idx[d <= cut[1] + r], idx[d > cut[1]]
            if len(near) <= 0.9 * len(idx):
                todo += [near, far]
                continue
        for i in range(0, len(idx), TILE):
            for j in range(i, len(idx), TILE):
                a, b = np.nonzero(np.bitwise_count(points[idx[i : i + TILE], None] ^ points[None, idx[j : j + TILE]]) <= r)
                real = (i + a) < (j + b)
                if real.any():
                    parent = _join(parent, idx[i + a[real]], idx[j + b[real]])
    return parent


# ---- the operator -------------------------------------------------------------------------------------------


def shard_links(distinct: DataFrame, r: int) -> DataFrame:
    """From distinct fingerprints ``fp``: (fp, low), the smallest fingerprint in its component within a shard, where that is another one."""
    total = distinct.count()
    share = min(1.0, SAMPLE / max(1, total))
    drawn = distinct if share == 1.0 else distinct.where((F.abs(F.xxhash64("fp", F.lit(3))) % 1_000_003) < int(share * 1_000_003))
    sample = np.sort(drawn.limit(2 * SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)) if total else np.empty(0, np.uint64)
    tree = distinct.sparkSession.sparkContext.broadcast(plant(sample, total))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            i, s = route(tree.value, fps, r)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(fps[i].view(np.int64))], ["shard", "fp"])

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = np.sort(pdf["fp"].to_numpy(np.int64).view(np.uint64))
        low = components(fps, r)
        other = low != np.arange(len(fps))
        return pd.DataFrame({"fp": fps[other].view(np.int64), "low": fps[low[other]].view(np.int64)})

    sent = distinct.select("fp").mapInArrow(send, "shard long, fp long")
    return sent.groupBy("shard").applyInPandas(link, "fp long, low long")


def connected(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links: root is the smallest node that can be reached.

    Each round every node takes the smallest root among its neighbours', hands it to its own root too, and then
    jumps to its root's root; the number of rounds grows with the logarithm of the longest chain. Joins are plain
    equi-joins, so a node with very many links is split by skew joins, and aggregates combine before the shuffle.
    """
    spark = links.sparkSession
    at_edges, at = shared_folder(spark, "edges"), shared_folder(spark, "labels")
    edges = written(links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct(), "edges", at_edges)
    labels = written(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("root")).withColumnRenamed("x", "node"), "labels", at)
    for _ in range(rounds):
        seen = edges.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("root").alias("seen")).withColumnRenamed("x", "node")
        told = labels.join(seen, "node").select("node", "root", F.least("root", "seen").alias("low"))
        # The smallest root that a node has heard of goes to the node and to its old root.
        offers = told.select("node", "low").unionByName(told.select(F.col("root").alias("node"), "low")).groupBy("node").agg(F.min("low").alias("low"))
        jump = offers.alias("o").join(offers.select(F.col("node").alias("low"), F.col("low").alias("up")).alias("u"), "low", "left")
        at_new = shared_folder(spark, "labels")
        new = written(jump.select("node", F.least("low", F.coalesce("up", "low")).alias("root")), "labels", at_new)
        changed = new.join(labels.withColumnRenamed("root", "before"), "node").where("root <> before").limit(1).count()
        discard(spark, at)
        labels, at = new, at_new
        if not changed:
            discard(spark, at_edges)
            return labels
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, r: int = 2, shingle: int = 3, key: str = "doc_id") -> DataFrame:
    """Per row of docs: key, fingerprint (long), component_id: the smallest key that can be reached over fingerprints
    that differ in at most r bits, its own included.

    Null and empty texts have fingerprint 0 and link as any other. Rows with a null key take part as links; their
    component_id is the component's smallest key, null only if all keys in it are null. Repeated rows have the
    same fingerprint and so the same component. An empty table gives an empty result.
    """
    marked = written(fingerprints(docs.select(F.col(key).alias("key"), "text"), "fp", shingle, drop_text=True), "fingerprints")
    lows = marked.groupBy("fp").agg(F.min("key").alias("low_key"))
    links = written(shard_links(lows.select("fp"), r), "links")
    roots = connected(links, "fp", "low")
    owned = lows.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low_key", F.coalesce("root", "fp").alias("root"))
    smallest = owned.groupBy("root").agg(F.min("low_key").alias("component_id"))
    class_of = owned.join(smallest, "root").select("fp", "component_id")
    return marked.join(class_of, "fp").select(F.col("key").alias(key), F.col("fp").alias("fingerprint"), "component_id")


def hex_fingerprint(fp: Column | str) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, r: int = 2, shingle: int = 3) -> DataFrame:
    """The rows of docs of which one per component of fingerprints stays (see keep_lowest())."""
    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    marked = written(fingerprints(known.select(F.col("doc_id").alias("key"), F.xxhash64("text").alias("t"), "text"), "fp", shingle, drop_text=True), "fingerprints")
    found = marked.select("fp").distinct()
    roots = connected(written(shard_links(found, r), "links"), "fp", "low").withColumnRenamed("node", "fp")
    return keep_lowest(docs, marked.join(found.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("component")), "fp").select("key", "t", "component"))


def keep_lowest(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs of which one per group stays: that with the smallest doc_id, of equal ids the smallest hash of the text.

    found: key, t (hash of the text), component of each row. Rows of one doc_id with unrelated texts are in groups of
    their own, so each of them stays; of rows equal in both, one alone does. Documents with a null doc_id are told apart by nothing, so
    each of them stays. The keys that go are looked up, fewer than those that stay, so that Spark can send them to the
    texts where they are few enough; only rows that are there more than once meet in a window.
    """
    t, n = fresh(docs, "_t"), fresh(docs, "_n")
    rows = written(found.groupBy("component", "key", "t").agg(F.count("*").alias("k")), "members")
    low = rows.groupBy("component").agg(F.min(F.struct("key", "t")).alias("low"))
    judged = written(rows.join(low, "component").select("key", F.col("t").alias("th"), "k", (F.struct("key", "t") == F.col("low")).alias("stays")), "judged")
    gone, repeated = judged.where("not stays").select("key", "th"), judged.where("stays and k > 1").select("key", "th")
    marked = docs.where(F.col("doc_id").isNotNull()).withColumn(t, F.xxhash64("text"))
    on = lambda other: (marked["doc_id"] == other["key"]) & (marked[t] == other["th"])
    apart = gone.unionByName(repeated)
    single = marked.join(apart, on(apart), "left_anti")
    several = marked.join(repeated, on(repeated), "left_semi").withColumn(n, F.row_number().over(W.partitionBy("doc_id", t).orderBy(t))).where(F.col(n) == 1).drop(n)
    return single.unionByName(several).drop(t).unionByName(docs.where(F.col("doc_id").isNull()))
