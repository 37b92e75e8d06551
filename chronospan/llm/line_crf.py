"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

Features of all lines of a block are computed at once from the bytes of the texts. The CRF (two labels, real-valued
features, a transition score per pair) is trained in numpy on a bounded sample of labelled documents. Its lines take
their targets from two sources: lines that recur across unrelated documents (page furniture) are boilerplate wherever
they stand; all other lines take their document's quality label. So labels change within documents, and transitions are
learned. Long documents are labelled whole, by Viterbi decoding over many texts at once. A document stays if
enough of its words stand in content lines and no base rule fails.

Recurring lines are counted over all documents by grouping. A line counts once per document, and only if most of its
documents differ in their other lines: lines of copies and near-copies are no furniture.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .samples import draw, texts_of
from .text import Words, blocks, fresh, look_up, same_name, split_words, written

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Features of a line, in order.
FEATURES = ["bias", "log_words", "symbol_share", "upper_share", "exclamation_per_word", "bar_per_word", "digit_share", "ends_sentence", "same_as_previous_word", "in_repeated_window", "repeats_a_line", "under_four_words", "word_length", "recurs"]
#: Lines of a training sequence at most; longer documents are cut into several sequences.
TRAINING_LINES = 400
#: A line recurs if it stands in so many documents, and in one of so many of all. So at most MOST_RARE times the mean number of a document's lines recur.
LEAST_DOCS, MOST_RARE = 10, 5000
#: And if the documents that have it show so many different sets of other lines, as a share of their number.
LEAST_VARIETY = 0.5


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SPACE = _table(" \t\n\x0b\x0c\r")
_SYMBOL, _UPPER, _DIGIT = _table(SYMBOLS), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")
_LETTER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 0x80)
_STOP = _table(".!?")


@dataclass
class Lines:
    """Base numbers per document and features per line of a block."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    doc: np.ndarray
    words: np.ndarray
    features: np.ndarray


def repeated_words(w: Words) -> np.ndarray:
    """For each word whether it lies in a window of three words that its text has twice or more, the first one included."""
    marks = np.zeros(len(w.ids), bool)
    at = np.flatnonzero(w.doc[2:] == w.doc[:-2]) if len(w.ids) > 2 else np.empty(0, np.int64)
    if not len(at):
        return marks
    ids = w.ids.astype(np.uint64)
    bits, doc_bits = max(1, int(len(w.vocab)).bit_length()), max(1, int(w.n_docs).bit_length())
    if 3 * bits + doc_bits > 64:  # number the pairs that occur, then the pairs of those with the rest: both fit
        pairs = np.unique((ids[:-1] << np.uint64(32)) | ids[1:], return_inverse=True)[1].astype(np.uint64)
        threes = np.unique((pairs[:-1] << np.uint64(32)) | ids[2:], return_inverse=True)[1].astype(np.uint64)
        key = (w.doc[at].astype(np.uint64) << np.uint64(32)) | threes[at]
    else:
        b = np.uint64(bits)
        key = (((w.doc[at].astype(np.uint64) << b | ids[at]) << b | ids[at + 1]) << b) | ids[at + 2]
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        found = at[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]
        for k in range(3):
            marks[found + k] = True
    return marks


def line_hash(line: bytes) -> int:
    """Hash of a line without the white space at its ends."""
    return xxhash.xxh3_64_intdigest(line.strip(), 0)


def recurring_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, most_rare: int = MOST_RARE, least_variety: float = LEAST_VARIETY) -> np.ndarray:
    """Sorted hashes of the lines with words that recur across unrelated documents of docs (text): see LEAST_DOCS, MOST_RARE, LEAST_VARIETY.

    Documents are told apart by the smallest hash among their other lines.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, 0):
                line, other = [], []
                for text in pc.fill_null(b.column(0), "").cast(pa.binary()).to_pylist():
                    own = {line_hash(x) for x in text.split(b"\n") if x.strip()}
                    low = sorted(own)[:2]
                    line += own
                    other += [(low[1] if h == low[0] else low[0]) if len(low) > 1 else 0 for h in own]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (line, other)], ["line", "other"])

    # Lines of one document only, most of them, leave after the first aggregate's partial counts meet.
    pairs = docs.select("text").mapInArrow(count, "line long, other long").groupBy("line", "other").agg(F.count("*").alias("n"))
    lines = written(pairs.groupBy("line").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).where(F.col("n") >= least_docs), "recurring")
    total = docs.count()
    found = lines.where((F.col("n") * most_rare >= total) & (F.col("kinds") >= F.col("n") * least_variety)).select("line").toArrow()
    return np.sort(found.column(0).to_numpy().view(np.uint64)) if found.num_rows else np.empty(0, np.uint64)


def lines_of(texts: pa.Array, recurring: np.ndarray | None = None) -> Lines:
    """Splits texts at \\n; a text has one line more than it has \\n. Null is empty."""
    texts = pc.fill_null(texts, "")
    w = split_words(texts)
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]

    breaks = np.flatnonzero(data == 10)
    doc = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1])
    start = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    last = np.concatenate([doc[1:] != doc[:-1], [True]]) if n else np.empty(0, bool)
    end = np.where(last, offsets[doc + 1], np.concatenate([start[1:] - 1, [0]])) if n else start

    def count(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[end] - sums[start]

    def of_docs(x: np.ndarray) -> np.ndarray:
        return np.bincount(doc, x, n).astype(np.int64)

    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    begins[offsets[:-1][offsets[:-1] < len(data)]] |= ~space[offsets[:-1][offsets[:-1] < len(data)]]
    words = count(begins)
    solid = count(~space)
    chars = count(~space & ((data & 0xC0) != 0x80))
    symbols, letters = count(_SYMBOL[data]), count(_LETTER[data])

    # The line of each word: words come in the order of their first bytes.
    line_of_word = np.repeat(np.arange(len(doc)), words)
    same = np.zeros(len(w.ids), bool)
    same[1:] = (w.ids[1:] == w.ids[:-1]) & (line_of_word[1:] == line_of_word[:-1])
    marks = repeated_words(w)
    per_line = lambda flags: np.bincount(line_of_word, flags, len(doc))

    again, hashes = np.zeros(len(doc), bool), np.zeros(len(doc), np.uint64)
    view, seen, before = data.tobytes(), set(), -1
    for i in np.flatnonzero(words):
        if doc[i] != before:
            seen, before = set(), doc[i]
        line = view[start[i] : end[i]]
        again[i] = line in seen
        seen.add(line)
        hashes[i] = line_hash(line)
    recurs = look_up(recurring, hashes) >= 0 if recurring is not None else np.zeros(len(doc), bool)
    recurs &= words > 0

    # The last byte of a line that is no space tells whether it ends a sentence.
    solid_at = np.flatnonzero(~space)
    k = np.searchsorted(solid_at, end) - 1
    stop = np.zeros(len(doc), bool)
    has = words > 0
    stop[has] = _STOP[data[solid_at[k[has]]]]

    some = np.maximum(words, 1)
    features = np.stack([
        np.ones(len(doc)), np.log1p(words), symbols / np.maximum(solid, 1), count(_UPPER[data]) / np.maximum(letters, 1), count(data == 33) / some, count(data == 124) / some,
        count(_DIGIT[data]) / np.maximum(solid, 1), stop, per_line(same) / some, per_line(marks) / some, again, words < 4, chars / some, recurs,
    ], axis=1).astype(np.float64)
    return Lines(w.counts, of_docs(chars), of_docs(symbols), of_docs(again), np.bincount(w.doc, marks, n).astype(np.int64), doc, words, features)


@dataclass
class Crf:
    """weights[f, y] and transition[y before, y]; y is 1 for content. Features are centred and scaled first (the bias is not)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transition: np.ndarray
    #: Hashes of the lines that recur across documents.
    recurring: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights

    def viterbi(self, features: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The best label of each line; doc is ascending. All documents take a step at once, longest first."""
        e = self.emissions(features)
        if not len(e):
            return np.empty(0, np.int64)
        first = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1])
        length = np.diff(np.concatenate([first, [len(doc)]]))
        by = np.argsort(-length, kind="stable")
        first, length = first[by], length[by]
        best = e[first].copy()
        came = np.zeros((len(e), 2), np.int8)
        for t in range(1, length[0]):
            n = int(np.searchsorted(-length, -t))
            at = first[:n] + t
            options = best[:n, :, None] + self.transition[None]
            came[at] = options.argmax(axis=1)
            best[:n] = options.max(axis=1) + e[at]
        out = np.zeros(len(e), np.int64)
        y = best.argmax(axis=1)
        for t in range(length[0] - 1, -1, -1):
            n = int(np.searchsorted(-length, -t))
            at = first[:n] + t
            out[at] = y[:n]
            y[:n] = came[at, y[:n]]
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(features: np.ndarray, doc: np.ndarray, label: np.ndarray, rounds: int = 150, decay: float = 1e-3) -> Crf:
    """Maximum likelihood with Adam; label holds 0 or 1 per line. doc is ascending."""
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    mean[0], scale[0] = 0.0, 1.0
    crf = Crf(mean, scale, np.zeros((features.shape[1], 2)), np.zeros((2, 2)))
    x = (features - mean) / scale
    first = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1])
    length = np.diff(np.concatenate([first, [len(doc)]]))
    by = np.argsort(-length, kind="stable")
    first, length = first[by], length[by]
    active = [int(np.searchsorted(-length, -t)) for t in range(length[0])]
    truth = np.eye(2)[label]
    follows = np.ones(len(doc), bool)
    follows[first] = False
    seen_pairs = truth[:-1][follows[1:]].T @ truth[1:][follows[1:]]
    theta = np.zeros(crf.weights.size + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, tr = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
        e = x @ w
        alpha, beta = e.copy(), np.zeros_like(e)
        for t in range(1, length[0]):
            at = first[: active[t]] + t
            alpha[at] = _log_sum(alpha[at - 1][:, :, None] + tr[None], 1) + e[at]
        for t in range(length[0] - 2, -1, -1):
            at = first[: active[t + 1]] + t
            beta[at] = _log_sum(tr[None] + (e[at + 1] + beta[at + 1])[:, None, :], 2)
        total = alpha + beta
        p = np.exp(total - _log_sum(total, 1)[:, None])
        i = np.flatnonzero(follows)
        z = _log_sum(total[i], 1)
        pairs = np.exp(alpha[i - 1][:, :, None] + tr[None] + (e[i] + beta[i])[:, None, :] - z[:, None, None]).sum(axis=0)
        grad = np.concatenate([(x.T @ (truth - p)).ravel(), (seen_pairs - pairs).ravel()]) / len(doc) - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf(mean, scale, theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2))


def targets(x: Lines, quality: np.ndarray) -> np.ndarray:
    """1 (content) or 0 (boilerplate) of each line: 0 for one that recurs, else the quality of its document."""
    return np.where(x.features[:, FEATURES.index("recurs")] > 0, 0, quality[x.doc])


def train(docs: DataFrame, labels: DataFrame, most: int = 3000) -> Crf:
    """On about ``most`` labelled documents at most (half of them of either quality, where there are as many); lines that recur come from all documents.

    Lines without words are left out; all others count, in sequences of at most TRAINING_LINES lines. Without labels of both kinds, every line counts as content.
    """
    recurring = recurring_lines(docs)
    shared = docs.sparkSession.sparkContext.broadcast(recurring)
    kinds = []
    for y in (0, 1):
        sample, _ = draw(labels, F.col("quality") == y, most // 2, 2, share=1.0)
        kinds.append(texts_of(docs, sample).select("text", F.lit(y).alias("y")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, 0):
                x = lines_of(b.column(0), shared.value)
                y = targets(x, b.column(1).to_numpy(zero_copy_only=False))
                real = np.flatnonzero(x.words > 0)
                cut = np.searchsorted(x.doc[real], np.arange(b.num_rows + 1))
                for d in range(b.num_rows):
                    for k in range(cut[d], cut[d + 1], TRAINING_LINES):
                        own = real[k : min(k + TRAINING_LINES, cut[d + 1])]
                        yield pa.RecordBatch.from_arrays([pa.array([x.features[own].astype("<f4").tobytes()]), pa.array([y[own].astype(np.int8).tobytes()])], ["features", "y"])

    got = kinds[0].unionByName(kinds[1]).mapInArrow(run, "features binary, y binary").toArrow()
    rows = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
    k = len(FEATURES)
    y = np.frombuffer(b"".join(y for _, y in rows), np.int8)
    if len(set(y.tolist())) < 2:
        return Crf(np.zeros(k), np.ones(k), np.stack([np.zeros(k), np.eye(k)[0]], axis=1), np.zeros((2, 2)), recurring)
    each = [np.frombuffer(f, "<f4").reshape(-1, k) for f, _ in rows]
    crf = fit(np.concatenate(each).astype(np.float64), np.repeat(np.arange(len(rows)), [len(f) for f in each]), y.astype(np.int64))
    crf.recurring = recurring
    return crf


#: Columns that label() adds, in order.
RESULTS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("content_share", "double"), ("line_labels", "string")]


def label(docs: DataFrame, crf: Crf, names: list[str] | None = None, content: float = 0.5, min_words: int = 50, most_repeated: float = 0.5, drop_text: bool = False) -> DataFrame:
    """docs and, per row, the columns of RESULTS (called ``names`` if given).

    line_labels has a C for each content line and a B for each other one, empty lines included. content_share is the
    share of words in content lines, 0 without words. base_failed: under ``min_words`` words, or over ``most_repeated``
    of them in repeated windows; kept: not base_failed, and a content_share of at least ``content``. Null texts are
    empty (one line without words, base_failed). Each row is judged for itself, so repeated rows and null ids stay as
    they are. No row leaves its partition. Columns of docs that have a new one's name (in any case) are replaced.
    """
    names = names or [n for n, _ in RESULTS]
    at = docs.columns.index("text")
    kept = [i for i, c in enumerate(docs.columns) if not (drop_text and i == at) and not any(same_name(c, n) for n in names)]
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    schema = T.StructType([*[docs.schema.fields[i] for i in kept], *[T.StructField(n, T.DataType.fromDDL(t)) for n, (_, t) in zip(names, RESULTS, strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, at):
                crf = shared.value
                x = lines_of(b.column(at), crf.recurring)
                y = crf.viterbi(x.features, x.doc)
                share = np.bincount(x.doc, y * x.words, b.num_rows) / np.maximum(x.n_words, 1)
                failed = (x.n_words < min_words) | (x.n_repeat_words > most_repeated * x.n_words)
                marks = np.where(y == 1, ord("C"), ord("B")).astype(np.uint8)
                ends = np.concatenate([[0], np.cumsum(np.bincount(x.doc, minlength=b.num_rows))]).astype(np.int32)
                labels = pa.Array.from_buffers(pa.string(), b.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(marks.tobytes())])
                new = [pa.array(c) for c in (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, failed, ~failed & (share >= content), share)]
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], *new, labels], schema.names)

    return docs.mapInArrow(run, schema)


def keep_content(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the rules keep."""
    crf = train(docs.select("doc_id", "text"), labels)
    names = [fresh(docs, f"_{n}") for n, _ in RESULTS]
    out = label(docs, crf, names, **options)
    return out.where(F.col(names[6])).select(*[F.col(f"`{c}`") for c in docs.columns])
