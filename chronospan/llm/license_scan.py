"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

A template's words are hashed in runs of ``shingle`` words. Templates are grouped in classes of about equal numbers of
runs (at most GROWTH apart), and each class has windows of its own over a text: twice its largest number of runs, overlapping
by half, so each template lies whole within a window. Windows are signed once per class, and an index of the
signatures of the class's templates, one sorted list per band, gives the candidates: the work grows with the number of
classes, some 30 for templates of 1 to 6,000 words, and not with that of templates.

A window of 2 g T runs that holds 80 % of a template of T runs has a similarity of at least 0.8 / (2 g + 0.2) with it, 0.3
for g = GROWTH. With BANDS bands of one row each it shares a band with the template with probability 1 - (1 - s)^BANDS,
more than 0.99998. Candidates are then checked exactly: the share of the template's shingles, as word tuples, that the
text around the window has.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from .text import Words, blocks, chain, mix, split_words

SHINGLE, BANDS, MIN_CONTAINMENT = 5, 32, 0.8
#: The largest template of a class has at most so many times the runs of the smallest.
GROWTH = 1.25

#: Characters that don't count at either end of a word, in templates and texts; words of nothing else are left out.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\u2018\u2019\u201c\u201d"

#: Short license lines that are looked for, by name.
LINES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
}


#: All templates: the lines above and the texts and headers of licenses in the folder beside this file, as NAME_text or NAME_header.
TEMPLATES = LINES | {f.stem: f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}

_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def _words(text: str) -> list[bytes]:
    return [x.encode() for w in text.encode().lower().decode().split() if (x := w.strip(PUNCTUATION))]


class Index:
    """Templates by class: names, largest number of runs, and per band the sorted signature values and whose they are."""

    def __init__(self, runs: dict[str, np.ndarray]):
        self.names = sorted(runs, key=lambda k: (len(runs[k]), k))
        self.classes: list[tuple[int, np.ndarray, np.ndarray]] = []
        group: list[int] = []
        for i, name in enumerate(self.names):
            if group and len(runs[name]) > GROWTH * len(runs[self.names[group[0]]]):
                self._close(group, runs)
                group = []
            group.append(i)
        if group:
            self._close(group, runs)

    def _close(self, group: list[int], runs: dict[str, np.ndarray]) -> None:
        signed = np.array([[mix(runs[self.names[i]] ^ seed).min() for seed in _SEEDS] for i in group], np.uint64)
        order = np.argsort(signed, axis=0)
        self.classes.append((len(runs[self.names[group[-1]]]), np.take_along_axis(signed, order, 0), np.array(group)[order]))

    def candidates(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, start, runs of a half window) of windows of h that share a band with a template. Each band permutes h once, and each minimum serves both windows that it lies in."""
        starts = [np.arange(0, len(h), size) for size, _, _ in self.classes]
        found = [set() for _ in self.classes]
        for band, seed in enumerate(_SEEDS):
            permuted = mix(h ^ seed)
            for hits, at, (_, signed, whose) in zip(found, starts, self.classes, strict=True):
                low = np.minimum.reduceat(permuted, at)
                low[:-1] = np.minimum(low[:-1], low[1:])
                first = np.searchsorted(signed[:, band], low)
                # Templates of equal signatures stand side by side.
                k = np.flatnonzero(signed[np.minimum(first, len(signed) - 1), band] == low)
                while len(k):
                    hits.update(zip(whose[first[k], band].tolist(), at[k].tolist(), strict=True))
                    first[k] += 1
                    k = k[first[k] < len(signed)]
                    k = k[signed[first[k], band] == low[k]]
        return [(i, s, size) for hits, (size, _, _) in zip(found, self.classes, strict=True) for i, s in sorted(hits)]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, shingle: int = SHINGLE, least: float = MIN_CONTAINMENT) -> DataFrame:
    """doc_id, license, containment, word (place of the first word of the first match): one row per row of docs and template found.

    Words are lower-cased (A-Z) and lose PUNCTUATION at their ends; places count all words. Templates (a bounded parameter, part of the task's closure) with fewer words than
    a shingle are one shingle of all their words. Null and empty texts match nothing; repeated rows and null ids give
    rows of their own. No row leaves its partition.
    """
    # Templates of fewer words than a shingle are one run of all of them, so runs come in up to ``shingle`` lengths.
    parts, hashed = {}, {}
    for name, text in (TEMPLATES if templates is None else templates).items():
        w = _words(text)
        n = min(shingle, len(w))
        if n:
            grams = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            h = np.array([[xxhash.xxh3_64_intdigest(x, 0) for x in g] for g in sorted(grams)], np.uint64)
            # Repeated runs count in the length of a template's windows.
            parts[name] = (n, len(w), grams)
            hashed.setdefault(n, {})[name] = np.resize(chain(*(h[:, i] for i in range(n))), len(w) - n + 1)
    indexes = {n: Index(runs) for n, runs in hashed.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, "text"):
                w = split_words(b.column(1), lower=True)
                bare = pc.utf8_trim(w.vocab, characters=PUNCTUATION)
                real = (pc.binary_length(bare).to_numpy(zero_copy_only=False) > 0)[w.ids]
                # The place of each word that counts, in its own text.
                place = (np.arange(len(w.ids)) - np.searchsorted(w.doc, w.doc))[real]
                w = Words(bare, w.ids[real], w.doc[real], w.n_docs)
                hashes = w.hashes()
                x, vocab, found = hashes[w.ids], w.vocab.cast(pa.binary()), {}
                for n, index in indexes.items():
                    runs_n = len(x) - n + 1
                    if runs_n <= 0:
                        continue
                    for k, s, half in index.candidates(chain(*(x[i : i + runs_n] for i in range(n)))):
                        name = index.names[k]
                        grams = parts[name][2]
                        # A quarter more on either side, for copies with words put in.
                        lo, hi = max(0, s - half // 4), min(s + 2 * half - 2 + n + half // 4 + 1, len(x))
                        for d in np.unique(w.doc[lo:hi]):
                            span = np.arange(lo, hi)
                            span = span[w.doc[span] == d]
                            words = vocab.take(pa.array(w.ids[span])).to_pylist()
                            seen = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
                            share = len(grams.intersection(seen)) / len(grams)
                            key = (int(d), name)
                            if share >= least and share > found.get(key, (0.0, 0))[0]:
                                first = int(place[span[0] + next(i for i, g in enumerate(seen) if g in grams)])
                                found[key] = (share, first)
                ids = b.column(0)
                rows = sorted(found.items())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([d for (d, _), _ in rows], pa.int64())), pa.array([n for (_, n), _ in rows], pa.string()), pa.array([v[0] for _, v in rows], pa.float64()), pa.array([v[1] for _, v in rows], pa.int64())], ["doc_id", "license", "containment", "word"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, license string, containment double, word long")
