"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text.

A window of a text is compressed with either dictionary; what it gains from the toxic one, together with how short
it gets, says how toxic the window is. Windows are single words here: over six words, what a dictionary happens to
have of the ordinary words hides what it has of one toxic word (measured on held-out rows, a gain that catches 92 %
of toxic texts also marks 33 to 44 % of the others; single words and a carrier bring that down to a few per cent).

Two facts about the format matter. The last eight bytes of an input are never searched for matches, and an input
that hardly shrinks is stored as it is; so each window is followed by a carrier, a fixed string that ends both
dictionaries, which costs one match.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .samples import draw, texts_of
from .text import blocks, same_name, split_words

CARRIER = bytes(range(128, 152))
#: What is no part of a word at its ends: the ASCII characters that are neither letters nor digits.
ENDS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Parts of the sample that are scored by dictionaries of the others, to learn the weights.
FOLDS = 4
#: Windows that a class is taken to have had as often as expected.
PRIOR = 1.0
ORDINARY_BYTES, TOXIC_BYTES = 64 << 10, 16 << 10
#: Words whose share among toxic texts differs this significantly (log-likelihood ratio) and is this many times higher make the toxic training windows.
MIN_RATIO, MIN_TIMES = 30.0, 4.0
#: Lengths of the beginnings of words that count as stems, and their least log-likelihood ratio.
STEM, MIN_STEM_RATIO = (3, 8), 15.0
#: If none does, so many of the most significant ones.
AT_LEAST = 32
#: Classes of a window: its gain from GAINS[0] to GAINS[1] and its length beyond the carrier's up to SHORT, all clipped.
GAINS, SHORT = (-2, 9), 12
#: Windows whose classes a worker remembers.
MEMORY = 400_000


def _windows(text: str) -> list[bytes]:
    """Lower-cased words without punctuation and symbols at their ends."""
    return [x for w in text.lower().encode().split() if (x := w.strip(ENDS))]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(6, strategy=zstandard.STRATEGY_BTULTRA, min_match=3, write_content_size=0, write_dict_id=0, write_checksum=0)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)


def _dictionary(size: int, samples: list[bytes], k: int) -> bytes:
    """Trained content; of samples too small for the trainer, their end."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=6, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _ratios(in1: Counter, in0: Counter, n1: int, n0: int) -> dict:
    """Log-likelihood ratio of what is MIN_TIMES as frequent among n1 documents as among n0, or more, by the numbers of documents that have it."""

    def log_likelihood(k: int, n: int, p: float) -> float:
        return (k * np.log(p) if k else 0.0) + ((n - k) * np.log(1 - p) if n > k else 0.0)

    ratio = {}
    for w, a in in1.items():
        b = in0[w]
        if a / n1 > MIN_TIMES * b / max(1, n0):
            p = (a + b) / (n1 + n0)
            ratio[w] = 2 * (log_likelihood(a, n1, a / n1) + (log_likelihood(b, n0, b / n0) if n0 else 0.0) - log_likelihood(a, n1, p) - log_likelihood(b, n0, p))
    return ratio


def contrast(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> set[bytes]:
    """Words that are significantly more frequent in toxic documents."""
    ratio = _ratios(Counter(w for t in toxic for w in set(t)), Counter(w for t in ordinary for w in set(t)), len(toxic), len(ordinary))
    return {w for w, r in ratio.items() if r >= MIN_RATIO} or set(sorted(ratio, key=lambda w: (-ratio[w], w))[:AT_LEAST])


def stems(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> set[str]:
    """Beginnings of words that toxic documents significantly more often show in two different words or more. Of beginnings that
    begin with each other the most significant one stands for all."""

    def documents(texts: list[list[bytes]]) -> Counter:
        found: Counter = Counter()
        for t in texts:
            # Words of a text differ, so a beginning that comes twice has two words.
            own = Counter(x[:k] for w in set(t) if len(x := w.decode()) > STEM[0] for k in range(STEM[0], min(len(x) - 1, STEM[1]) + 1))
            found.update(p for p, n in own.items() if n > 1)
        return found

    ratio = {p: r for p, r in _ratios(documents(toxic), documents(ordinary), len(toxic), len(ordinary)).items() if r >= MIN_STEM_RATIO}
    chosen: set[str] = set()
    for p in sorted(ratio, key=lambda p: (-ratio[p], p)):
        if not any(p.startswith(q) or q.startswith(p) for q in chosen):
            chosen.add(p)
    return chosen


class Windows:
    """Classes of windows under a pair of dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = _compressor(ordinary), _compressor(toxic)
        self.base = len(self.toxic.compress(CARRIER))
        self.memory: dict[bytes, int] = {}

    def classes(self, windows: list[bytes]) -> np.ndarray:
        memory, one, two = self.memory, self.ordinary.compress, self.toxic.compress
        if len(memory) > MEMORY:
            memory.clear()
        out = []
        for w in windows:
            k = memory.get(w)
            if k is None:
                x = b" " + w + b" " + CARRIER
                short = len(two(x))
                gain = min(max(len(one(x)) - short, GAINS[0]), GAINS[1]) - GAINS[0]
                k = memory[w] = gain * (SHORT + 1) + min(max(short - self.base, 0), SHORT)
            out.append(k)
        return np.array(out, np.int64)


N_CLASSES = (GAINS[1] - GAINS[0] + 1) * (SHORT + 1)


@dataclass(frozen=True)
class Model:
    """Dictionaries, a weight per class of window, and the logistic function over a document's sums."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    logistic: tuple[float, ...]


@cache
def _of(ordinary: bytes, toxic: bytes) -> Windows:
    return Windows(ordinary, toxic)


def _features(total: np.ndarray, strong: np.ndarray, n: np.ndarray, kinds: np.ndarray, stronger: np.ndarray) -> np.ndarray:
    """Of sums of weights, numbers of windows with a high one, and numbers of different windows with a high one and with a very high one."""
    return np.stack([np.ones(len(n)), total / np.sqrt(n + 25.0), strong / np.sqrt(n + 25.0), 10 * strong / (n + 25.0), np.log1p(strong), np.log1p(n) / 5, np.log1p(kinds), np.log1p(stronger)], axis=1)


#: A weight from which a window counts as strong.
STRONG = 1.0


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, decay: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton's method."""
    theta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + decay * np.eye(len(theta)), x.T @ (w * (y - p)) - decay * theta)
        theta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return theta


def _dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, bytes]:
    """Content of the ordinary and of the toxic dictionary, from the windows of documents."""
    words, beginnings = (contrast(toxic, ordinary), stems(toxic, ordinary)) if toxic else (set(), set())
    special = words | {w for t in toxic for w in set(t) if beginnings and any(w.decode()[:k] in beginnings for k in range(STEM[0], STEM[1] + 1))}
    samples = [b" " + b" ".join(w for w in t if w in special) + b" " for t in toxic if special.intersection(t)]
    return _dictionary(ORDINARY_BYTES, [b" " + b" ".join(w for w in t if w not in special) + b" " for t in ordinary if t], 64), _dictionary(TOXIC_BYTES, samples, 32)


def fit(toxic: list[str], ordinary: list[str], prior: float) -> Model:
    """Weights and the logistic function come from each of FOLDS parts of the texts under dictionaries of the others, as windows that a
    dictionary was trained on say nothing about others. The dictionaries of the last part stay: lengths depend on how large a
    dictionary is, so it has to be like those that the weights were learned under. prior: share of toxic rows."""
    words = [[_windows(t) for t in texts] for texts in (toxic, ordinary)]
    hist, each = np.zeros((2, N_CLASSES)), ([], [])
    for k in range(FOLDS):
        d0, d1 = _dictionaries(*([t for i, t in enumerate(x) if i % FOLDS != k] for x in words))
        windows = Windows(d0, d1)
        for kind in (0, 1):
            classes = [(windows.classes(t), windows.classes(sorted(set(t)))) for t in words[kind][k::FOLDS]]
            each[kind].extend(classes)
            hist[kind] += np.bincount(np.concatenate([*(c for c, _ in classes), np.empty(0, np.int64)]), minlength=N_CLASSES)
    # How often a class comes against what its common share lets expect; PRIOR keeps rare classes near 0.
    expected = hist.sum(axis=1, keepdims=True) * hist.sum(axis=0) / max(1.0, hist.sum())
    found = np.log((hist + PRIOR) / (expected + PRIOR))
    weights = found[0] - found[1] if each[0] and each[1] else np.zeros(N_CLASSES)
    rows = each[0] + each[1]
    y = np.repeat([1.0, 0.0], [len(each[0]), len(each[1])])
    if not len(rows):
        return Model(d0, d1, tuple(weights), (0.0,) * 8)
    n = np.array([len(r) for r, _ in rows])
    x = _features(np.array([weights[r].sum() for r, _ in rows]), np.array([(weights[r] > STRONG).sum() for r, _ in rows]), n, *(np.array([(weights[r] > s).sum() for _, r in rows]) for s in (STRONG, 2 * STRONG)))
    mean = max(1e-9, y.mean())
    w = np.where(y == 1, prior / mean, (1 - prior) / max(1e-9, 1 - mean))
    return Model(d0, d1, tuple(weights), tuple(_logistic(x, y, w)))


def probabilities(m: Model, texts: pa.Array) -> np.ndarray:
    """The score of each text."""
    windows, weights, theta = _of(m.ordinary, m.toxic), np.array(m.weights), np.array(m.logistic)
    w = split_words(pc.utf8_lower(pc.fill_null(texts, "")))
    vocab = [x.strip(ENDS) for x in w.vocab.cast(pa.binary()).to_pylist()]
    real = np.array([bool(x) for x in vocab], bool)
    weight = np.where(real, weights[windows.classes(vocab)], 0.0) if vocab else np.empty(0)
    each, n = weight[w.ids], len(texts)
    total, strong = np.bincount(w.doc, each, n), np.bincount(w.doc, each > STRONG, n)
    count = np.bincount(w.doc, real[w.ids], n) if vocab else np.zeros(n)
    # Different windows of a text: those that differ by what stands at their ends are one.
    numbers = {x: i for i, x in enumerate(dict.fromkeys(vocab))}
    once = np.unique(np.stack([w.doc, np.array([numbers[x] for x in vocab], np.int64)[w.ids]]), axis=1) if vocab else np.zeros((2, 0), np.int64)
    by_number = np.zeros(max(len(numbers), 1))
    by_number[[numbers[x] for x in vocab]] = weight
    kinds, stronger = (np.bincount(once[0], by_number[once[1]] > s, n) for s in (STRONG, 2 * STRONG))
    return 1 / (1 + np.exp(-np.clip(_features(total, strong, count, kinds, stronger) @ theta, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, usable: Column, most_toxic: int = 2000, most_ordinary: int = 4000) -> Model:
    """On about so many labelled documents of either kind at most, among label rows that fulfil usable.

    The texts of this bounded sample go to the driver, which trains the dictionaries there."""
    texts, counts = [], []
    for y, most in ((1, most_toxic), (0, most_ordinary)):
        fits = (F.col("toxic") == y) & usable
        counts.append(labels.where(fits).count())
        sample, _ = draw(labels, fits, most, 3, share=1.0)
        texts.append([t for _, t in sorted((r["doc_id"], r["text"] or "") for r in texts_of(docs, sample).select("doc_id", "text").collect())])
    return fit(texts[0], texts[1], counts[0] / max(1, sum(counts)))


def scored(docs: DataFrame, model: Model, name: str = "score", drop_text: bool = False) -> DataFrame:
    """docs and the probability (0 to 1) that a text is toxic. Null and empty texts have no windows and get the score of
    that; each row is scored for itself from its text alone. No row leaves its partition."""
    model_ = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    kept = [i for i, c in enumerate(docs.columns) if not (drop_text and i == at) and not same_name(c, name)]
    schema = T.StructType([*[docs.schema.fields[i] for i in kept], T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, at):
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], pa.array(probabilities(model_.value, b.column(at)))], schema.names)

    return docs.mapInArrow(run, schema)
