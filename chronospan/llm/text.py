"""Helpers shared by the text operators: tables, word splitting in Arrow, 64-bit hashes.

A word is a match of ``[^\\x20\\x09-\\x0D]+`` everywhere in this subpackage.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Texts are worked on in blocks of about so many bytes, so that memory in a task does not depend on the batch.
BLOCK_BYTES = 1 << 20


#: Bytes of an Arrow batch between Spark and its Python workers, about.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Rows hold whole texts, so from here on the session sends them to Python in batches bounded by bytes, not by their
    number alone (10,000 texts of some kB make several hundred MB on both sides)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors reach. Where it is unset, only a local session may go on, with a
    temporary folder; on a cluster every executor would write to its own disk, so it raises."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"{tempfile.gettempdir()}/spark-shared"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Within it, what a query has shuffled is deleted when the query ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def written(df: DataFrame, name: str, path: str | None = None, compression: str = "snappy") -> DataFrame:
    """The rows of df, written once to the shared folder (or to path) and read back: lineage ends here and lost executors cost nothing."""
    path = path or shared_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of written() that nothing will read again."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def same_name(a: str, b: str) -> bool:
    """Whether Spark takes two column names for one."""
    return a.lower() == b.lower()


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have yet (Spark compares names without case)."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def blocks(batch: pa.RecordBatch, column: str | int = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows so that each part has at most about ``limit`` bytes in the column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
    release()


@cache
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def release() -> None:
    """Gives memory that nothing holds back to the system: a worker lives through many tasks, and its peaks would add up."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


@dataclass
class Words:
    """Words of a block: ``vocab[ids[k]]`` is word k, which stands in row ``doc[k]`` of the block's ``n_docs``."""

    vocab: pa.Array
    ids: np.ndarray
    doc: np.ndarray
    n_docs: int

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs).astype(np.int64)

    @cached_property
    def entries(self) -> list[bytes]:
        """The vocabulary as bytes."""
        return self.vocab.cast(pa.binary()).to_pylist()

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of each entry of the vocabulary."""
        return np.frombuffer(b"".join([xxhash.xxh3_64_digest(w, seed) for w in self.entries]), ">u8").astype(np.uint64)


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Words of each text; nulls are empty. lower: A-Z only."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(real).dictionary_encode()
    return Words(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), doc[real.to_numpy(zero_copy_only=False)], len(texts))


_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: spreads every bit of x over all 64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def chain(first: np.ndarray, *rest: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hashes of its members, in order."""
    h = mix(first + _GOLD)
    for x in rest:
        h = mix((h ^ x) + _GOLD)
    return h


def shingles(words: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words, and the row of each. A text of 1 to n-1 words has one run: all its words."""
    h, doc = hashes[words.ids], words.doc
    m = len(h) - n + 1
    if m > 0:
        full = doc[:m] == doc[n - 1 :]
        runs, rows = chain(*(h[i : i + m] for i in range(n)))[full], doc[:m][full]
    else:
        runs, rows = np.empty(0, np.uint64), np.empty(0, np.int64)
    counts = words.counts
    few = np.flatnonzero((counts > 0) & (counts < n))
    if len(few):
        ends = np.cumsum(counts)
        short = np.array([chain(*(h[k : k + 1] for k in range(ends[d] - counts[d], ends[d])))[0] for d in few], np.uint64)
        rows = np.concatenate([rows, few])
        order = np.argsort(rows, kind="stable")
        runs, rows = np.concatenate([runs, short])[order], rows[order]
    return runs, rows


def look_up(keys: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Position of each query in the sorted keys, -1 where absent. Queries are sorted first, which keeps the search in cache."""
    if not len(keys) or not len(queries):
        return np.full(len(queries), -1, np.int64)
    order = np.argsort(queries)
    asked = queries[order]
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    out = np.empty(len(queries), np.int64)
    out[order] = np.where(keys[at] == asked, at, -1)
    return out
