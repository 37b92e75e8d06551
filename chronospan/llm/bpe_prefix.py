"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string exactly one token can stand last in the prefix's BPE encoding: the token t
for which the pair (last token of the shorter prefix, t) is one that the merges leave apart. Storing that token
for each prefix gives the encoding by walking back from the end; more bytes extend the table without touching
what is there, and after an edit only the positions near it change.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .text import blocks, fresh

#: Entries of each of the two generations of a worker's memories.
MEMORY = 300_000


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Merges:
    """A vocabulary of ranks: which token pairs the merges leave apart, and the prefix tables of byte strings."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, r in ranks.items():
            self.token[r] = b
        self.longest = max(map(len, ranks), default=1)
        ends: dict[bytes, set[int]] = {}
        for b in ranks:
            if len(b) > 2:
                ends.setdefault(b[-3:], set()).add(len(b))
        #: By their last three bytes, the lengths that tokens with this end have, the longest first.
        self.lengths = {e: (*sorted(x, reverse=True), *([2] if e[1:] in ranks else []), 1) for e, x in ends.items()}
        self._shift = len(self.token).bit_length()
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._apart: dict[int, bool] = {}

    def parts(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes t; None for a byte."""
        if t not in self._parts:
            b = self.token[t]
            left = [bytes([x]) for x in b]
            while len(left) > 2:
                best, at = min((self.ranks.get(left[i] + left[i + 1], 1 << 60), i) for i in range(len(left) - 1))
                if best >= t:
                    raise ValueError(f"token {t} can't be made by merges")
                left[at : at + 2] = [left[at] + left[at + 1]]
            self._parts[t] = (self.ranks[left[0]], self.ranks[left[1]]) if len(left) == 2 else None
        return self._parts[t]

    def apart(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of a and b together gives a, b again."""
        key = (a << self._shift) | b
        found = self._apart.get(key)
        if found is None:
            if len(self._apart) > 2 * MEMORY:
                self._apart.clear()
            found = self._apart[key] = self._stay_apart(a, b)
        return found

    def _stay_apart(self, a: int, b: int) -> bool:
        # Undo the merges on both sides from the latest to the first. Whenever the two tokens that meet at the
        # border could merge before the next one to be undone was made, the merges would have crossed the border.
        # On equal ranks the left side comes first, as leftmost pairs merge first.
        before = len(self.token)
        while True:
            joined = self.ranks.get(self.token[a] + self.token[b])
            if joined is not None and joined < before:
                return False
            pa_, pb = self.parts(a), self.parts(b)
            if pa_ is None and pb is None:
                return True
            if pb is None or (pa_ is not None and a > b):
                before, a = a, pa_[1]
            else:
                before, b = b + 1, pb[0]

    def extend(self, data: bytes, last: list[int], upto: int | None = None) -> None:
        """Adds to ``last`` (of which last[i] is the last token of data[:i]) the entries up to len(data)."""
        get, lengths, apart, memo, shift = self.ranks.get, self.lengths.get, self.apart, self._apart.get, self._shift
        for i in range(len(last), (len(data) if upto is None else upto) + 1):
            for n in lengths(data[i - 3 : i], (2, 1)) if i > 2 else (2, 1)[2 - i :]:
                if n > i or (t := get(data[i - n : i])) is None:
                    continue
                if n == i:
                    last.append(t)
                    break
                p = last[i - n]
                ok = memo((p << shift) | t)
                if ok or (ok is None and apart(p, t)):
                    last.append(t)
                    break
            else:
                raise ValueError(f"no token for byte {data[i - 1]}")

    def back(self, last: list[int], n: int) -> list[int]:
        out, token = [], self.token
        while n:
            t = last[n]
            out.append(t)
            n -= len(token[t])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        t = self.ranks.get(data)
        if t is not None:
            return [t]
        last = [-1]
        self.extend(data, last)
        return self.back(last, len(data))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class PrefixTable:
    """The encoding of one piece that can be appended to and edited."""

    def __init__(self, merges: Merges, data: bytes = b""):
        self.merges, self.data, self.last = merges, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.merges.extend(self.data, self.last)

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replaces data[start:stop]; returns how many positions were computed anew. Positions are taken over from the old
        table once as many in a row agree as the longest token has bytes, as later ones depend on those alone."""
        if not 0 <= start <= stop <= len(self.data):
            raise ValueError("the edit lies outside the data")
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[: start + 1]
        alike = 0
        for i in range(start + 1, len(self.data) + 1):
            self.merges.extend(self.data, self.last, i)
            alike = alike + 1 if i > start + len(new) and self.last[i] == old[i - shift] else 0
            if alike >= self.merges.longest:
                self.last += old[i + 1 - shift :]
                return i - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        return self.merges.back(self.last, len(self.data))


class Memory:
    """Remembers at least the last MEMORY entries that were used, in two generations."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, asked: set[str]) -> set[str]:
        """What is not known of asked; the rest is in ``new`` afterwards."""
        rest = asked.difference(self.new)
        moved = {k: self.old[k] for k in rest.intersection(self.old)}
        self.new.update(moved)
        return rest.difference(moved)

    def age(self) -> None:
        if len(self.new) > MEMORY:
            self.old, self.new = self.new, {}


class Encoder:
    """Whole texts: pieces are the matches of a pattern. Texts repeat their pieces, so a worker keeps a bounded memory of them.

    With a pattern of GPT-2's kind a piece starts at every single space between characters that are no spaces. A
    text without double or final spaces is cut there at once, and the pattern is matched only on parts not seen before.
    """

    def __init__(self, data: bytes, pattern: str):
        self.merges = Merges(parse_ranks(data))
        self.find = regex.compile(pattern).findall
        self._pieces, self._after_space = Memory(), Memory()

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Encodes pieces in the order of their bytes: each takes over the table of the prefix it shares with the one before."""
        new, last, before, m = {}, [-1], b"", self.merges
        for b, piece in sorted((p.encode(), p) for p in pieces):
            n = next((i for i, (x, y) in enumerate(zip(before, b, strict=False)) if x != y), min(len(before), len(b)))
            del last[n + 1 :]
            m.extend(b, last)
            before = b
            new[piece] = array("I", m.back(last, len(b))).tobytes()
        return new

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        firsts, rests = [], []
        for text in texts:
            if "  " in text or text[-1:] == " ":
                firsts.append(text)
                rests.append(())
            else:
                first, *rest = text.split(" ")
                firsts.append(first)
                rests.append(rest)
        pieces, after_space = self._pieces, self._after_space
        chunks = {c: self.find(" " + c) for c in after_space.missing(set(chain.from_iterable(rests)))}
        heads = [self.find(x) for x in firsts]
        pieces.new.update(self._learn(pieces.missing({p for x in chain(chunks.values(), heads) for p in x})))
        ids, after = pieces.new.__getitem__, after_space.new
        after.update((c, b"".join(map(ids, x))) for c, x in chunks.items())
        out = [b"".join(map(ids, head)) + b"".join(map(after.__getitem__, rest)) for head, rest in zip(heads, rests, strict=True)]
        pieces.age()
        after_space.age()
        return out


@cache
def _encoder(data: bytes, pattern: str) -> Encoder:
    return Encoder(data, pattern)


@cache
def _merges(data: bytes) -> Merges:
    return Merges(parse_ranks(data))


def read_ranks(path: str) -> bytes:
    """The vocabulary file, read by the driver; it goes to the executors as a broadcast (its size is that of the file, under 1 MB here)."""
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """docs and, for each row, its token ids (little-endian unsigned 32-bit integers) and their number.

    Null and empty texts have no ids (empty binary, 0). Rows are kept one for one, repeated ones too; an empty
    table gives an empty one. A name in ids or n_tokens that docs already has replaces that column. No row leaves
    its partition, so the work is one pass without a shuffle.
    """
    data = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    docs = docs.select(*[c for c in docs.columns if c.lower() not in {ids.lower(), n_tokens.lower()}])
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(n_tokens, T.LongType()), T.StructField(ids, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(data.value, pattern).encode
        for batch in batches:
            for b in blocks(batch, at):
                out = encode([t or "" for t in b.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())], [*b.schema.names, n_tokens, ids])

    return docs.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encoded and the bytes that each row's ids stand for; null ids give null."""
    data = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    encoded = encoded.select(*[c for c in encoded.columns if c.lower() != decoded.lower()])
    at = encoded.columns.index(ids)
    schema = T.StructType([*encoded.schema.fields, T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _merges(data.value).decode
        for batch in batches:
            for b in blocks(batch, at):
                out = [None if x is None else decode(np.frombuffer(x, "<u4").tolist()) for x in b.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, decoded])

    return encoded.mapInArrow(run, schema)


def encode_stage(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """docs with columns n_tokens and ids (other names where docs has these)."""
    return encode_documents(docs, ranks_path, pattern, ids=fresh(docs, "ids"), n_tokens=fresh(docs, "n_tokens"))
