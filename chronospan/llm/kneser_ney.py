"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

Trusted documents are dealt to two parts by a hash of the id: three quarters are counted for the model, all others, which it has
not seen, give the thresholds (quantiles, one per language). Nothing is bounded, so counts grow with the input.

A probability is the discounted share of the longest known n-gram, or that of a shorter one times the weights of the contexts
that lack it. Its logarithm is therefore a sum of one value for each n-gram that the model knows, and the
log10 probability of a text is the sum of these values over all n-grams in it. Neither model nor texts go to every executor: a pair of words
has a shard (by its hash), where its own value and those of the trigrams that begin with it are, and the pairs of blocks of texts, each with
the word that follows, are sent there, met by a sorted search, and what a shard adds to each text comes back. Values of frequent words (at
most FREQUENT) are broadcast; the others are asked for like pairs.

Everything moves as packed arrays, a row per block and shard. To keep the disk small, each step goes over the shards in classes and the
scores over the texts in passes; what a class or pass has shuffled goes before the next begins. The model is written in buckets by shard, so passes don't move it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import draw
from .text import blocks, chain, discard, fresh, lean, look_up, same_name, shared_folder, split_words, written

#: Keys that stand for the start and the end of a text.
START, END = np.uint64(1), np.uint64(2)
#: A shard meets the n-grams of about so many bytes of text; blocks of texts have at most so many.
SHARD_BYTES, PACK_BYTES = 16 << 20, 4 << 20
#: Classes of shards at most (counting takes COUNTED of them at once, as it splits the trusted texts anew each time); passes over texts at most,
#: and one for so many bytes of text, if that gives fewer.
CLASSES, COUNTED, PASSES, PASS_BYTES = 8, 2, 9, 16 << 20
#: Words whose values are broadcast, at most.
FREQUENT = 1_000_000
#: No context's weight is less, so that logarithms stay finite.
LEAST_WEIGHT = 1e-30
#: Bits of a word's hash by which a context knows what follows it.
NEXT = np.uint64((1 << 48) - 1)


def _pack(x: np.ndarray, ascending: bool = False) -> bytes:
    """Bytes of numbers by place (of the steps between them, if ascending), so that high bytes that are alike compress."""
    x = np.diff(x, prepend=x.dtype.type(0)) if ascending else np.ascontiguousarray(x)
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unpack(data, dtype, ascending: bool = False) -> np.ndarray:
    x = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).reshape(-1).view(dtype)
    return np.cumsum(x, dtype=dtype) if ascending else x


def _column(table: pa.Table, name: str, dtype, ascending: bool = False) -> np.ndarray:
    """The arrays of all rows in a row."""
    return np.concatenate([np.empty(0, dtype), *(_unpack(x.as_buffer(), dtype, ascending) for x in table.column(name) if x.is_valid)])


def _coded(x: np.ndarray) -> tuple[bytes, bytes]:
    """Bytes of the distinct numbers, ascending, and of each number's place among them."""
    known, at = np.unique(x, return_inverse=True)
    return _pack(known, True), _pack(at.astype(np.uint32))


def _decoded(table: pa.Table, known: str, at: str, dtype) -> np.ndarray:
    """The arrays of all rows in a row, of columns made by _coded()."""
    rows = zip(table.column(known), table.column(at), strict=True)
    return np.concatenate([np.empty(0, dtype), *(_unpack(k.as_buffer(), dtype, True)[_unpack(i.as_buffer(), np.uint32)] for k, i in rows if k.is_valid)])


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)


def _summed(keys: np.ndarray, values: np.ndarray, kind: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their values. kind "stable" only merges keys that come as a few ascending runs."""
    order = np.argsort(keys, kind=kind)
    keys, first = keys[order], _firsts(keys[order])
    return keys[first], np.add.reduceat(values[order], first) if len(first) else values[:0]


def _by_home(home: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by home that leaves rows of one home in theirs, the homes that have rows, and where each begins and ends."""
    order = np.argsort(home.astype(np.uint16) if shards < 1 << 16 else home, kind="stable")
    cut = np.searchsorted(home[order], np.arange(shards + 1, dtype=home.dtype))
    some = np.flatnonzero(np.diff(cut))
    return order, some, np.stack([cut[some], cut[some + 1]], axis=1)


def _padded(words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all texts in a row, each with two starts before and an end behind; vocabulary ids (-1 start, -2 end); first places."""
    counts = words.counts
    first = np.concatenate([[0], np.cumsum(counts + 3)[:-1]])
    ids = np.full(int(counts.sum()) + 3 * words.n_docs, -1, np.int64)
    ids[np.arange(len(words.ids)) + 3 * words.doc + 2] = words.ids
    ids[first + counts + 2] = -2
    x = np.concatenate([hashes, [END, START]])[ids]
    return x, ids, first


def _trigrams(shards: int, classes: int, low: int, high: int):
    """Texts to the distinct trigrams of each block (a, m, c, how often) for the shards of classes low to high - 1; the last two words give the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, 0, PACK_BYTES):
                w = split_words(b.column(0))
                x, ids, _ = _padded(w, w.hashes())
                if len(x) < 3:
                    continue
                at = np.flatnonzero(ids[2:] != -1) + 2
                pair = chain(x[at - 1], x[at])
                of = pair % np.uint64(shards) % np.uint64(classes)
                on = (low <= of) & (of < high)
                at, pair = at[on], pair[on]
                _, where, n = np.unique(chain(pair, x[at - 2]), return_index=True, return_counts=True)
                order, some, cuts = _by_home((pair[where] % np.uint64(shards)).astype(np.int64), shards)
                at, n = at[where][order], n[order].astype(np.uint32)
                a, m, c = x[at - 2], x[at - 1], x[at]
                parts = [(*(v[lo:hi].tobytes() for v in (a, m, c)), _pack(n[lo:hi])) for lo, hi in cuts]
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *(pa.array(v, pa.binary()) for v in zip(*parts, strict=True))], ["shard", "a", "m", "c", "n"])

    return run


def _counted(parts: pa.Table, classes: int) -> pa.Table:
    """One shard's pairs (m, c), each with the words before it (a). n2 counts in how many contexts a pair occurs; what begins with a start has
    only one, so its own count stands. of: how many trigrams, and how many pairs, have counts 1 to 4."""
    a, m, c = (np.concatenate([np.frombuffer(y.as_buffer(), np.uint64) for y in parts.column(x)]) for x in "amc")
    n, key = _column(parts, "n", np.uint32), chain(chain(m, c), a)
    order = np.argsort(key)
    first = _firsts(key[order])
    n, where = np.add.reduceat(n[order], first), order[first]
    a, m, c = a[where], m[where], c[where]
    pair = chain(m, c)
    order = np.lexsort((pair, m))
    a, m, c, n, first = a[order], m[order], c[order], n[order], _firsts(pair[order])
    n2 = np.add.reduceat(np.where(m == START, n, 1), first).astype(np.uint32)
    size = np.diff(np.append(first, len(a))).astype(np.uint32)
    of = [int((x == i).sum()) for x in (n, n2) for i in (1, 2, 3, 4)]
    packed = [_pack(m[first], True), _pack(c[first]), _pack(n2), _pack(size), _pack(a), _pack(n.astype(np.uint32))]
    shard = parts.column("shard")[0].as_py()
    return pa.table([[shard], [shard % classes], *([x] for x in packed), [of]], ["shard", "class", "m", "c", "n2", "size", "a", "n", "of"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per shard and word: pairs that end in it; and of those that begin with it the counts in all (t), and how many have counts 1, 2 and more."""
    for b in batches:
        for i in range(b.num_rows):
            m, c, n2 = _unpack(b["m"][i].as_buffer(), np.uint64, True), _unpack(b["c"][i].as_buffer(), np.uint64), _unpack(b["n2"][i].as_buffer(), np.uint32)
            words, at = np.unique(np.concatenate([m, c]), return_inverse=True)
            n = len(words)
            begins = [np.bincount(at[: len(m)], x, n).astype(np.int64) for x in (n2, n2 == 1, n2 == 2, n2 > 2)]
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(np.full(n, b["shard"][i].as_py())), pa.array(np.bincount(at[len(m) :], minlength=n)), *map(pa.array, begins)], ["word", "shard", "n1", "t", "e1", "e2", "e3"])


def _discounts(n: list[float]) -> np.ndarray:
    """What to take from counts of 0 (nothing), 1, 2, and 3 or more, from how many n-grams have counts 1 to 4."""
    n = [0.0, *map(float, n)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    return np.array([0.0, *(min(k, max(0.0, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else 0.5 * k for k in (1, 2, 3))])


def _off(d: np.ndarray, n: np.ndarray) -> np.ndarray:
    return d[np.minimum(n, 3)]


def _shares(shards: int, classes: int, d1: np.ndarray, d2: np.ndarray, total: float, floor: float):
    """One shard's pairs and the counts of their words, to the values of the pairs (in this shard) and the trigrams for the shard of
    their first two words, each with the share of its last two."""

    def run(pairs: pa.Table, words: pa.Table) -> pa.Table:
        m, c, a = _column(pairs, "m", np.uint64, True), _column(pairs, "c", np.uint64), _column(pairs, "a", np.uint64)
        n2, size, n = (_column(pairs, x, np.uint32) for x in ("n2", "size", "n"))
        keys = words.column("word").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        at_m, at_c = (order[look_up(keys[order], x)] for x in (m, c))
        n1, t, e1, e2, e3 = (words.column(x).to_numpy() for x in ("n1", "t", "e1", "e2", "e3"))
        left = np.maximum((d2[1] * e1 + d2[2] * e2 + d2[3] * e3) / np.maximum(t, 1), LEAST_WEIGHT)
        lower = left[at_m] * ((n1 - _off(d1, n1)) / total + floor)[at_c]
        p2 = (n2 - _off(d2, n2)) / t[at_m] + lower
        pair = chain(m, c)
        by_key = np.argsort(pair)
        own = int(pair[0] % np.uint64(shards)) if len(pair) else 0
        rows = [(own, own % classes, _pack(pair[by_key], True), _pack(np.log10(p2 / lower)[by_key].astype(np.float32)), None, None, None, None, None)]
        context = chain(a, np.repeat(m, size))
        last, share = np.repeat(c, size) & NEXT, np.repeat(p2, size).astype(np.float32)
        order = np.argsort(context)
        by_home, some, cuts = _by_home((context[order] % np.uint64(shards)).astype(np.int64), shards)
        order = order[by_home]
        context, last, n, share = context[order], last[order], n[order], share[order]
        rows += [(int(h), int(h) % classes, None, None, _pack(context[lo:hi], True), *_coded(last[lo:hi]), _pack(n[lo:hi]), _pack(share[lo:hi])) for h, (lo, hi) in zip(some, cuts, strict=True)]
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 7]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "class", "pair", "v", "context", "words", "last", "n", "share"])

    return run


def _values(d3: np.ndarray):
    """One shard's parts of the model: all keys (pairs; trigrams behind them), ascending, and their values."""

    def run(parts: pa.Table) -> pa.Table:
        pair, v = _column(parts, "pair", np.uint64, True), _column(parts, "v", np.float32)
        context, last = _column(parts, "context", np.uint64, True), _decoded(parts, "words", "last", np.uint64)
        n, share = _column(parts, "n", np.uint32), _column(parts, "share", np.float32)
        order = np.argsort(context)
        context, last, n, share = context[order], last[order], n[order].astype(np.float64), share[order]
        first = _firsts(context)
        t = np.add.reduceat(n, first) if len(first) else n
        left = np.maximum((np.add.reduceat(_off(d3, n.astype(np.int64)), first) if len(first) else n) / t, LEAST_WEIGHT)
        each = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(context))))
        v3 = np.log10((n - _off(d3, n.astype(np.int64))) / t[each] / (left[each] * share) + 1)
        keys, values = _summed(np.concatenate([pair, context[first], chain(context, last)]), np.concatenate([v.astype(np.float64), np.log10(left), v3]))
        return pa.table([parts.column("shard")[:1], [_pack(keys, True)], [_pack(values.astype(np.float32))]], ["shard", "keys", "values"])

    return run


def _rare(words: pa.Table) -> pa.Table:
    """One shard's words that are not broadcast."""
    keys, values = _summed(words.column("word").to_numpy().view(np.uint64), words.column("u").to_numpy())
    return pa.table([words.column("shard")[:1], [_pack(keys, True)], [_pack(values.astype(np.float32))]], ["shard", "keys", "values"])


class Model:
    """The table of values (shard, keys, values) in buckets by shard, those of frequent words (sorted keys, values; broadcast), whether there are
    others, and the log10 probability of a token of which nothing is known."""

    def __init__(self, spark, table: str | None, path: str, shards: int, words, others: bool, floor: float):
        self.spark, self.table, self.path, self.shards, self.words, self.others, self.floor = spark, table, path, shards, words, others, floor

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per text: its words, and the log10 probability of them and the end."""
        docs = self.spark.createDataFrame([(i, t) for i, t in enumerate(texts.to_pylist())], "i long, text string")
        found = {r["t"]: r for r in scores(docs, self).collect()}
        got = [found[r["t"]] for r in docs.select("i", F.xxhash64("text").alias("t")).orderBy("i").collect()]
        return np.array([r["n"] for r in got], np.int64), np.array([r["p"] for r in got], np.float64)

    def discard(self) -> None:
        """Deletes the table; no text can be scored any more."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        discard(self.spark, self.path)


def _bytes(docs: DataFrame) -> int:
    return int(docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0)


def train(trusted: DataFrame) -> Model:
    """Counts all trusted texts. Where these are a part of the texts that will be scored, a column all_bytes says how large those are together."""
    spark = trusted.sparkSession
    with lean(spark):
        trusted_path, pairs_path = shared_folder(spark, "kn-trusted"), shared_folder(spark, "kn-pairs")
        texts = written(trusted.select("text", *(["all_bytes"] if "all_bytes" in trusted.columns else [F.lit(0).cast("long").alias("all_bytes")])), "kn-trusted", trusted_path, "zstd")
        size = texts.agg(F.greatest(F.sum(F.octet_length("text")), F.max("all_bytes")).alias("n")).first()["n"]
        shards = max(1, int(size or 0) // SHARD_BYTES)
        classes = min(CLASSES, shards)
        pair_schema = "shard long, class long, m binary, c binary, n2 binary, size binary, a binary, n binary, of array<long>"
        for low in range(0, classes, COUNTED):
            parts = texts.select("text").mapInArrow(_trigrams(shards, classes, low, low + COUNTED), "shard long, a binary, m binary, c binary, n binary")
            found = parts.groupBy("shard").applyInArrow(lambda x: _counted(x, classes), pair_schema)
            found.write.mode("append").partitionBy("class").option("compression", "zstd").parquet(pairs_path)
        discard(spark, trusted_path)
        every = spark.read.schema(pair_schema).parquet(pairs_path)
        of = every.agg(*[F.sum(F.col("of")[i]).alias(f"n{i}") for i in range(8)]).first()
        d3, d2 = _discounts([x or 0 for x in of[:4]]), _discounts([x or 0 for x in of[4:]])
        counts = every.select("shard", "m", "c", "n2").mapInArrow(_words, "word long, shard long, n1 long, t long, e1 long, e2 long, e3 long")
        sums = [F.sum(x).alias(x) for x in ("n1", "t", "e1", "e2", "e3")]
        words_path = shared_folder(spark, "kn-words")
        words = written(counts.groupBy("word").agg(*sums, F.collect_list("shard").alias("shards")), "kn-words", words_path, "zstd")
        n1 = words.agg(F.sum("n1").alias("n"), F.count(F.when(F.col("n1") > 0, 1)).alias("v"), *[F.count(F.when(F.col("n1") == i, 1)).alias(f"y{i}") for i in (1, 2, 3, 4)]).first()
        d1, total, v = _discounts([n1[f"y{i}"] for i in (1, 2, 3, 4)]), float(n1["n"] or 1), float(n1["v"])
        taken = d1[1] * n1["y1"] + d1[2] * n1["y2"] + d1[3] * (v - n1["y1"] - n1["y2"])
        floor = float((taken or 1.0) / total / (v + 1))

        shares_path = shared_folder(spark, "kn-shares")
        share_schema = "shard long, class long, pair binary, v binary, context binary, words binary, last binary, n binary, share binary"
        for k in range(classes):
            pairs = spark.read.schema(pair_schema).parquet(pairs_path).where(F.col("class") == k)
            asked = words.select(F.explode("shards").alias("shard"), "word", "n1", "t", "e1", "e2", "e3").where(F.col("shard") % classes == k)
            found = pairs.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(_shares(shards, classes, d1, d2, total, floor), share_schema)
            found.write.mode("append").partitionBy("class").option("compression", "zstd").parquet(shares_path)
            discard(spark, f"{pairs_path}/class={k}")

        # A word counts at the end of a bigram, and what its own bigrams leave as their context.
        lower = F.when(F.col("n1") > 0, F.log10(((F.col("n1") - _taken(d1)) / total + floor) / floor)).otherwise(0.0)
        left = F.when(F.col("t") > 0, F.log10(F.greatest((d2[1].item() * F.col("e1") + d2[2].item() * F.col("e2") + d2[3].item() * F.col("e3")) / F.col("t"), F.lit(LEAST_WEIGHT)))).otherwise(0.0)
        valued = words.select("word", (lower + left).alias("u"), F.floor(F.log2(F.greatest("n1", F.lit(1)))).alias("size"))
        per = {r["size"]: r["k"] for r in valued.groupBy("size").agg(F.count("*").alias("k")).collect()}
        least, held = 1 << 62, 0
        for size in sorted(per, reverse=True):
            if held + per[size] > FREQUENT:
                break
            held, least = held + per[size], size
        top = valued.where(F.col("size") >= least).toArrow()
        keys, u = _summed(top.column("word").to_numpy().view(np.uint64), top.column("u").to_numpy())
        others = held < sum(per.values())

        name, model_path = f"kn_{uuid.uuid4().hex}", shared_folder(spark, "kn-model")

        def keep(rows: DataFrame) -> None:
            rows.write.mode("append").format("parquet").bucketBy(shards, "shard").option("path", model_path).option("compression", "zstd").saveAsTable(name)

        none = spark.createDataFrame([], "shard long, keys binary, values binary")
        keep(none)
        for k in range(classes if v else 0):
            parts = spark.read.schema(share_schema).parquet(shares_path).where(F.col("class") == k)
            keep(parts.groupBy("shard").applyInArrow(_values(d3), none.schema))
            discard(spark, f"{shares_path}/class={k}")
        if others:
            keep(valued.where(F.col("size") < least).select(F.pmod("word", F.lit(shards)).cast("long").alias("shard"), "word", "u").groupBy("shard").applyInArrow(_rare, none.schema))
        for path in (pairs_path, shares_path, words_path):
            discard(spark, path)
    return Model(spark, name, model_path, shards, spark.sparkContext.broadcast((keys, u)), others, float(np.log10(floor)))


def _taken(d: np.ndarray):
    return F.when(F.col("n1") == 1, float(d[1])).when(F.col("n1") == 2, float(d[2])).otherwise(float(d[3]))


def _requests(shards: int, frequent, others: bool):
    """Blocks of (t, text) to rows (shard, block, pairs of words, what follows each, steps to the text of each); a block's first row, of any shard,
    also has t, words, and the values of the frequent words of all its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "block", "t", "n", "sure", "keys", "next", "docs"]
        known, values = frequent.value
        values = np.append(values, 0.0)
        for batch in batches:
            for b in blocks(batch, 1, PACK_BYTES):
                w = split_words(b.column(1))
                if not w.n_docs:
                    continue
                hashes = w.hashes()
                x, ids, first = _padded(w, hashes)
                at = look_up(known, np.concatenate([hashes, [END, START]]))[ids]
                doc = np.repeat(np.arange(w.n_docs), w.counts + 3)
                second = np.ones(len(x), bool)
                second[first] = False
                sure = np.bincount(doc[second], values[at[second]], w.n_docs)
                # All places but a text's first end a pair; where all words are known, pairs with an unknown one need not be asked for.
                to = np.flatnonzero(second & ((at >= 0) & (np.roll(at, 1) >= 0) | others))
                keys, follow = chain(x[to - 1], x[to]), np.append(x, START)[to + 1] & NEXT
                follow[ids[to] == -2] = 0
                docs, home = doc[to], (keys % np.uint64(shards)).astype(np.int64)
                if others:
                    # The other words (the second start stands for both) have a home by their own hash and nothing behind them.
                    more = np.flatnonzero(second & (at < 0))
                    keys, follow, docs = np.concatenate([keys, x[more]]), np.concatenate([follow, np.zeros(len(more), np.uint64)]), np.concatenate([docs, doc[more]])
                    home = np.concatenate([home, x[more].view(np.int64) % shards])
                    by_doc = np.argsort(docs, kind="stable")
                    keys, follow, docs, home = keys[by_doc], follow[by_doc], docs[by_doc], home[by_doc]
                order, some, cuts = _by_home(home, shards)
                keys, follow, docs = keys[order], follow[order], docs[order].astype(np.uint32)
                block = int.from_bytes(uuid.uuid4().bytes[:8], "little", signed=True)
                parts = [(keys[lo:hi].tobytes(), _pack(follow[lo:hi]), _pack(docs[lo:hi], True)) for lo, hi in cuts]
                some = some.tolist()
                if not parts:
                    some, parts = [0], [(b"", b"", b"")]
                head = [[v.tobytes()] + [None] * (len(some) - 1) for v in (np.asarray(b.column(0)).astype(np.int64), w.counts, sure)]
                columns = [pa.array(some, pa.int64()), pa.array([block] * len(some), pa.int64()), *(pa.array(v, pa.binary()) for v in (*head, *zip(*parts, strict=True)))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _met(asked: pa.Table, known: pa.Table) -> pa.Table:
    """One shard: what its values add to the texts of each block (docs, sums)."""
    k, v = _column(known, "keys", np.uint64, True), _column(known, "values", np.float32)
    if known.num_rows > 1:
        k, v = _summed(k, v, "stable")
    v = np.append(v, 0).astype(np.float64)
    keys = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x.as_buffer(), np.uint64) for x in asked.column("keys"))])
    follow, docs = _column(asked, "next", np.uint64), [_unpack(x.as_buffer(), np.uint32, True) for x in asked.column("docs")]
    ends = np.cumsum([0, *map(len, docs)])
    at = look_up(k, keys)
    # Only what begins with a known pair can be a known trigram.
    on = np.flatnonzero(at >= 0)
    value = v[at]
    value[on] += v[look_up(k, chain(keys[on], follow[on]))]
    out_docs, out_sums = [], []
    for of, lo, hi in zip(docs, ends[:-1], ends[1:], strict=True):
        first = _firsts(of)
        sums = np.add.reduceat(value[lo:hi], first) if len(first) else value[:0]
        some = np.flatnonzero(sums)
        out_docs.append(of[first[some]].tobytes())
        out_sums.append(sums[some].tobytes())
    return pa.table([*(asked.column(c) for c in ("block", "t", "n", "sure")), pa.array(out_docs, pa.binary()), pa.array(out_sums, pa.binary())], ["block", "t", "n", "sure", "docs", "sums"])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """t (hash of the text), n (words), p (log10 probability) for the distinct texts of docs."""
    spark, floor = model.spark, model.floor
    texts = docs.select(F.xxhash64("text").alias("t"), "text")
    passes = min(PASSES, 1 + _bytes(docs) // PASS_BYTES)
    path = shared_folder(spark, "kn-scores")

    def total(added: pa.Table) -> pa.Table:
        t, n, sure = (np.frombuffer(added.column(c).drop_null()[0].as_buffer(), k) for c, k in (("t", np.int64), ("n", np.int64), ("sure", np.float64)))
        p = (n + 1) * floor + sure
        for d, s in zip(added.column("docs"), added.column("sums"), strict=True):
            p[np.frombuffer(d.as_buffer(), np.uint32)] += np.frombuffer(s.as_buffer(), np.float64)
        return pa.table([t, n, p], ["t", "n", "p"])

    with lean(spark):
        for k in range(passes):
            mine = texts.where(F.pmod("t", F.lit(passes)) == k) if passes > 1 else texts
            asked = mine.mapInArrow(_requests(model.shards, model.words, model.others), "shard long, block long, t binary, n binary, sure binary, keys binary, next binary, docs binary")
            sums = asked.groupBy("shard").cogroup(spark.table(model.table).groupBy("shard")).applyInArrow(_met, "block long, t binary, n binary, sure binary, docs binary, sums binary")
            # Equal texts are in the same pass.
            sums.groupBy("block").applyInArrow(total, "t long, n long, p double").dropDuplicates(["t"]).write.mode("append").parquet(path)
    return spark.read.schema("t long, n long, p double").parquet(path)


def scored(docs: DataFrame, model: Model, n_words: str, log10_prob: str) -> DataFrame:
    """docs and the number of words and log10 probability of each text."""
    t = fresh(docs, "_t")
    found = scores(docs, model).select(F.col("t").alias(t), F.col("n").alias(n_words), F.col("p").alias(log10_prob))
    return docs.withColumn(t, F.xxhash64("text")).join(found, t).select(*[F.col(f"`{c}`") for c in docs.columns], n_words, log10_prob)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, name: str = "kept", keep_text: bool = True, details: bool = False) -> DataFrame:
    """docs and ``name`` (boolean): whether the text's perplexity is at most its language's threshold.

    Trusted text: documents with label quality 1; the model counts three quarters of them. The threshold of a language is
    the ``quantile`` of the perplexity of all its other trusted documents, which the model has not seen (null is a language of its own); languages without any take the quantile over
    all. Without trusted documents everything is kept. Null and empty texts are a single end and are judged like the others. Repeated rows and
    null ids are judged each for itself; columns of other names stay as they are. details adds n_words,
    log10_prob, perplexity and threshold (for tables without columns of these names).
    """
    counted, others = draw(labels, F.col("quality") == 1, None, 1)
    trusted = docs.select("doc_id", "text").join(counted, F.col("doc_id") == counted["_id"], "left_semi")
    model = train(trusted.select("text", F.lit(_bytes(docs)).cast("long").alias("all_bytes")))
    n, p, cross = (c if details else fresh(docs, c) for c in ("n_words", "log10_prob", "_cross"))
    limit, lang = fresh(docs, "_limit"), fresh(docs, "_lang")
    all_docs = scored(docs, model, n, p).withColumn(cross, -F.col(p) / (F.col(n) + 1))
    model.discard()
    if not keep_text:
        all_docs = all_docs.drop("text")
    ids = all_docs.select("doc_id", "lang", F.col(cross).alias("_x"))
    known = ids.join(others, ids["doc_id"] == others["_id"], "left_semi")
    # Grouping sets give each language's quantile and that over all in one pass of mergeable summaries.
    found = written(known.rollup("lang").agg(F.percentile_approx("_x", quantile, 10_000).alias("_limit"), F.grouping("lang").alias("_all")), "kn-limits")
    over_all = found.where("_all = 1").select("_limit").first()
    default = over_all["_limit"] if over_all else None
    limits = found.where("_all = 0").select(F.col("lang").alias(lang), F.col("_limit").alias(limit))
    out = all_docs.join(limits, all_docs["lang"].eqNullSafe(limits[lang]), "left").withColumn(limit, F.coalesce(limit, F.lit(default).cast("double"), F.lit(float("inf"))))
    new = [(F.col(cross) <= F.col(limit)).alias(name)]
    if details:
        new += [n, p, F.pow(F.lit(10.0), F.col(cross)).alias("perplexity"), F.pow(F.lit(10.0), F.col(limit)).alias("threshold")]
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if not same_name(c, name) and (keep_text or c != "text")], *new)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the classifier keeps."""
    name = fresh(docs, "_kept")
    return classify(docs, labels, name=name, **options).where(F.col(name)).drop(name)
