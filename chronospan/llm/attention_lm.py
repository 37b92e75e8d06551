"""LM scoring: a causal self-attention model, trained in numpy on subword ids, and a smoothed unigram base.

1. Words and subwords of all training texts are counted by grouping.
2. The rounds start from a model that is fitted on a bounded number of windows of training texts (attention_model.fit).
3. ROUNDS rounds follow, each over its own 1 / ROUNDS of all training texts, so every training text is learned from once
   (a whole epoch): every task trains a copy of the model on its texts, and Spark adds up the changes of the parameters (weighted by
   tokens) and the expected counts of the component table. What travels is at most a row per vocabulary entry and task.
4. Texts are scored in overlapping windows, each token once, with the tokens before it in its window as context.

Counts of frequent words (at most FREQUENT of them) are broadcast; every other word of a text meets its count in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attention_model import COMPONENTS, WINDOW, Model, Trainer, fit, start, windows
from .bpe_prefix import parse_ranks, read_ranks
from .text import Words, blocks, look_up, split_words, written

FREQUENT = 1_000_000
#: Windows of the first fit at most; about so many bytes of text make a window.
FIT_WINDOWS, WINDOW_BYTES = 60_000, 80
#: Rounds, which share all training texts between them.
ROUNDS = 2
#: parts_of() is stated for rounds that learn from one text in SHARE.
SHARE = 64
#: A part of a round has at most four times so many bytes of text. Parts of a round, unless it has more text or less than an eighth of that a part.
ROUND_BYTES, PARTS = 2 << 20, 6
ROUND_RATE, BATCH = 0.003, 64
#: Word hash of the end that is counted as a token.
END_HASH = np.uint64(3)


@cache
def _encoding(data: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding("scoring", pat_str=pattern, mergeable_ranks=parse_ranks(data), special_tokens={})


class Subwords:
    """Subword ids of blocks of texts: each word is encoded behind a space; the id after the last is the end's."""

    def __init__(self, data: bytes, pattern: str):
        self.encoding = _encoding(data, pattern)
        self.end = self.encoding.n_vocab
        self.opens = np.zeros(self.end, bool)
        self.opens[[i for x, i in parse_ranks(data).items() if x[:1] == b" "]] = True

    def pieces(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each word has), of all words in one call: a word's first piece is the one that begins with the space."""
        flat = np.array(self.encoding.encode_ordinary((b" " + b" ".join(words)).decode()) if words else [], np.int64)
        first = np.flatnonzero(self.opens[flat]) if len(flat) else np.empty(0, np.int64)
        if len(first) == len(words) and (not len(words) or first[0] == 0):
            return flat, np.diff(np.concatenate([first, [len(flat)]]))
        each = [self.encoding.encode_ordinary(" " + w.decode()) for w in words]  # a word with odd white space of its own
        return np.fromiter((i for e in each for i in e), np.int64), np.fromiter(map(len, each), np.int64, len(each))

    def of(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text's end included, and how many each text has."""
        flat, size = self.pieces(w.entries)
        flat, size = np.append(flat, self.end), np.append(size, 1)
        first = np.cumsum(size) - size
        # The end goes in as one more word behind each text's words.
        words = np.insert(w.ids, np.cumsum(w.counts), len(w.vocab))
        n = size[words]
        ends = np.cumsum(n)
        ids = flat[np.repeat(first[words] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.bincount(w.doc, size[w.ids], w.n_docs).astype(np.int64) + 1


def _first_model(learn: DataFrame, model: Model, vocab, pattern: str, text_bytes: int, most: int) -> None:
    """Fits the model on the ``most`` windows with the lowest hashes, of a share of the rows that has about twice as many."""
    share = min(1.0, 2 * most * WINDOW_BYTES / max(1, text_bytes))
    index, end = model.index, model.end

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = Subwords(vocab.value, pattern)
        for batch in batches:
            for b in blocks(batch, 0):
                w = split_words(b.column(0), lower=True)
                row = b.column(1).to_numpy(zero_copy_only=False)
                ids, length = sub.of(w)
                for low, x, y, _, own in windows(index[ids], length, end, 512):
                    both = np.concatenate([x[:, :1], y], axis=1).astype(np.int32)
                    h = row[own] ^ (both.astype(np.int64) @ (np.arange(1, WINDOW + 2) * 0x1E3779B97F4A7C15).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(x), low)), pa.FixedSizeListArray.from_arrays(pa.array(both.ravel()), WINDOW + 1).cast(pa.list_(pa.int32()))], ["h", "low", "ids"])

    rows = learn.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(9)), F.lit(1 << 30)) <= int((1 << 30) * share))
    found = rows.select("text", F.xxhash64("doc_id", "text", F.lit(10)).alias("h")).mapInArrow(cut, "h long, low long, ids array<int>").orderBy("h", "ids").limit(most).toArrow()
    if not found.num_rows:
        return
    both = found.column(2).combine_chunks().flatten().to_numpy().reshape(-1, WINDOW + 1).astype(np.int64)
    inputs, targets = both[:, :-1], both[:, 1:]
    # Places behind a text's end are padding.
    ended = np.cumsum(targets == end, axis=1) - (targets == end)
    fit(model, inputs, targets, (ended == 0) & (np.arange(WINDOW) >= found.column(1).to_numpy()[:, None]))


def _round(rows: DataFrame, model: Model, vocab, pattern: str) -> None:
    """One round: tasks train copies of the model on their rows, whose changes are averaged into it."""
    names = list(model.params)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub, base = Subwords(vocab.value, pattern), sent.value
        own = base.copy()
        trainer, held = Trainer(own, ROUND_RATE), {}
        times = np.zeros(len(base.corpus))
        touched = {"embed": times, "before": times}
        tokens = 0

        def train(low: int) -> None:
            x, y, on = (np.concatenate(c) for c in zip(*held.pop(low), strict=True))
            trainer.step(x, y, on, 0.0, low)
            times[:] += np.bincount(x.ravel(), minlength=len(times))

        for batch in batches:
            for b in blocks(batch, 0):
                w = split_words(b.column(0), lower=True)
                ids, length = sub.of(w)
                for low, x, y, on, _ in windows(base.index[ids], length, base.end, BATCH):
                    # Windows with the same first learned place share batches, so that context costs no more than in scoring.
                    held.setdefault(low, []).append((x, y, on))
                    tokens += int(on.sum())
                    if sum(len(h[0]) for h in held[low]) >= BATCH:
                        train(low)
        for low in sorted(held):
            train(low)
        if not tokens:
            return
        for k, n in enumerate(names):
            at = np.flatnonzero(touched[n]) if n in touched else np.arange(len(own.params[n]))
            weight = touched[n][at] if n in touched else np.full(len(at), float(tokens))
            change = (own.params[n][at] - base.params[n][at]) * weight[:, None]
            yield _rows(k, at, change, weight)
        at = np.flatnonzero(trainer.gathered.any(axis=1))
        yield _rows(len(names), at, trainer.gathered[at], np.ones(len(at)))

    parts = rows.select("text").mapInArrow(learn, "slot long, v array<float>, w double")
    found = parts.groupBy("slot").agg(Summarizer.sum(array_to_vector("v")).alias("v"), F.sum("w").alias("w")).select("slot", vector_to_array("v", "float32").alias("v"), "w").toArrow()
    if not found.num_rows:
        return
    slot, weight = found.column(0).to_numpy(), found.column(2).to_numpy()
    values, ends = found.column(1).combine_chunks().flatten().to_numpy(), np.cumsum(found.column(1).combine_chunks().value_lengths().to_numpy())
    for k in range(len(names) + 1):
        mine = np.flatnonzero(slot >> 32 == k)
        if not len(mine):
            continue
        width = COMPONENTS if k == len(names) else model.params[names[k]].shape[1]
        sums = values[(ends[mine] - width)[:, None] + np.arange(width)]
        at = slot[mine] & 0xFFFFFFFF
        if k < len(names):
            model.params[names[k]][at] += (sums / weight[mine][:, None]).astype(np.float32)
        else:
            # The expected counts of the round join those so far.
            model.seen[at] += sums
    model.settle()


def _rows(k: int, at: np.ndarray, values: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    cut = (np.arange(len(at) + 1) * values.shape[1]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64) + (k << 32)), pa.ListArray.from_arrays(pa.array(cut), pa.array(values.ravel().astype(np.float32))), pa.array(weight)], ["slot", "v", "w"])


def parts_of(text_bytes: int) -> int:
    """Parts of a round over text_bytes / SHARE, each learned by a copy of the model. It follows from the texts alone, so scores don't depend on the cluster:
    PARTS of them, fewer for little text, more with much, of about equal size."""
    return max(1, min(PARTS, text_bytes // SHARE // (ROUND_BYTES // 8)), text_bytes // SHARE // (4 * ROUND_BYTES))


def train(learn: DataFrame, n_sub: np.ndarray, vocab, pattern: str, most: int = FIT_WINDOWS, rounds: int = ROUNDS) -> Model:
    """The model of the texts of learn (doc_id, text), whose subwords have the counts n_sub."""
    model = start(n_sub)
    text_bytes = int(learn.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"])
    _first_model(learn, model, vocab, pattern, text_bytes, most)
    for k in range(rounds):
        rows = learn.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(rounds)) == k)
        _round(rows.repartition(parts_of(text_bytes * SHARE // rounds)), model, vocab, pattern)
    return model


def score(docs: DataFrame, training: Column, ranks_path: str, pattern: str, most: int = FIT_WINDOWS, rounds: int = ROUNDS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, is_training, n_tokens, n_known, train_tokens, base_score, score.

    training is a boolean expression over docs. Texts are lower-cased (A-Z); tokens are words and one end. Null texts
    are empty: the end alone. Rows are scored one by one, so repeated rows and null ids stay; training rows count as
    often as they stand there. An empty table gives no rows; without training rows all counts are 0 and the model is
    untrained. Very long texts are worked on in chunks of windows. Other columns are not looked at.
    """
    sc = docs.sparkSession.sparkContext
    data = read_ranks(ranks_path)
    vocab = sc.broadcast(data)
    rows = docs.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("is_training"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = Subwords(vocab.value, pattern)
        n_sub, ends = np.zeros(sub.end + 1, np.int64), 0
        for batch in batches:
            for b in blocks(batch, 0, 4 << 20):
                w = split_words(b.column(0), lower=True)
                flat, size = sub.pieces(w.entries)
                n = np.bincount(w.ids, minlength=len(w.vocab))
                n_sub += np.bincount(flat, np.repeat(n, size), sub.end + 1).astype(np.int64)
                ends += w.n_docs
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), bool)), pa.array(w.hashes().view(np.int64)), pa.array(n.astype(np.int64))], ["sub", "key", "n"])
        n_sub[sub.end] = ends
        used = np.flatnonzero(n_sub)
        keys, n = np.concatenate([used, np.full(int(ends > 0), END_HASH).astype(np.int64)]), np.concatenate([n_sub[used], np.full(int(ends > 0), ends)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(keys)) < len(used)), pa.array(keys), pa.array(n)], ["sub", "key", "n"])

    learn = rows.where("is_training").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = written(learn.select("text").mapInArrow(count, "sub boolean, key long, n long").groupBy("sub", "key").agg(F.sum("n").alias("n")), "lm-counts")
    words = counts.where("not sub").select("key", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.max(F.when(F.col("key") == int(END_HASH), F.col("n"))), F.lit(0)).alias("ends")).first()
    n_train, n_types, n_ends = int(total["n"]), int(total["v"]), int(total["ends"])
    # Classes of counts (powers of two), the highest first, as long as all their words together are at most FREQUENT.
    per = {r["c"]: r["k"] for r in words.groupBy(F.floor(F.log2("n")).alias("c")).agg(F.count("*").alias("k")).collect()}
    least, held = 1 << 62, 0
    for c in sorted(per, reverse=True):
        if held + per[c] > FREQUENT:
            break
        held, least = held + per[c], 1 << c
    top = words.where(F.floor(F.log2("n")) >= F.lit(least.bit_length() - 1)).toArrow()
    order = np.argsort(top.column(0).to_numpy().view(np.uint64)) if top.num_rows else np.empty(0, np.int64)
    frequent = sc.broadcast((top.column(0).to_numpy().view(np.uint64)[order], top.column(1).to_numpy()[order]))

    n_sub = np.zeros(Subwords(data, pattern).end + 1)
    for r in counts.where("sub").select("key", "n").collect():  # one row per entry of the vocabulary at most
        n_sub[r["key"]] = r["n"]
    model = sc.broadcast(train(learn, n_sub, vocab, pattern, most, rounds))
    end_log = float(np.log10((n_ends + 1) / (n_train + n_types + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub, lm = Subwords(vocab.value, pattern), model.value
        keys, ns = frequent.value
        for batch in batches:
            for b in blocks(batch, 1, 4 << 20):
                n = b.num_rows
                w = split_words(b.column(1), lower=True)
                h = w.hashes()
                at = look_up(keys, h)
                c = np.where(at >= 0, ns[at] if len(ns) else 0, 0)
                logs = np.log10((c + 1) / (n_train + n_types + 1))
                sure = at[w.ids] >= 0
                base = np.bincount(w.doc[sure], logs[w.ids[sure]], n) + end_log
                known = np.bincount(w.doc[sure], minlength=n) + int(n_ends > 0)
                # w.doc is ascending, and so is the owner of the other words.
                rare, owner = h[w.ids[~sure]], w.doc[~sure]
                cut = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
                value = np.zeros(n)
                ids, length = sub.of(w)
                for low, x, y, on, own in windows(lm.index[ids], length, lm.end):
                    value += np.bincount(own, (lm.log_probs(x, y, low) * on).sum(axis=1, dtype=np.float64), n)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(w.counts + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.ListArray.from_arrays(pa.array(cut), pa.array(rare.view(np.int64))), pa.array(value / np.log(10))], ["doc_id", "is_training", "n_tokens", "known", "base", "rare", "score"])

    id_type = dict(docs.dtypes)["doc_id"]
    scored = written(rows.mapInArrow(run, f"doc_id {id_type}, is_training boolean, n_tokens long, known long, base double, rare array<long>, score double").withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    asked = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("k"))
    met = asked.join(words, "key", "left").groupBy("row").agg(F.sum(F.col("k") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(n_train + n_types + 1)))).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("met"))
    return scored.join(met, "row", "left").select(
        "doc_id", "is_training", "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )
