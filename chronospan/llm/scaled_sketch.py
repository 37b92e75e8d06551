"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed share of the hash range, whatever the document's length. Sketches
therefore merge by union, and the share of one sketch found in another estimates how much of one document the other
contains, even where one is a thousand times longer. All comparisons rest on the sketches alone, so whoever has two
fingerprints can repeat them. The estimate from a sketch of n hashes has a standard error of sqrt(p (1 - p) / n); a text of m
different shingles has about m * SHARE of them, and a very short one may have none (its fingerprint is empty, as that of an empty text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import blocks, shingles, split_words

SHINGLE = 5
#: Share of the hash range that is kept: half, as most texts have some tens of shingles.
SHARE = 1 / 2
#: Bytes of text of a range of ids.
RANGE_BYTES = 64 << 20


def all_hashes(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Words as they are; a text of fewer words than a shingle is one shingle."""
    w = split_words(texts)
    runs, rows = shingles(w, w.hashes(), shingle)
    order = np.lexsort((runs, rows))
    runs, rows = runs[order], rows[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (rows[1:] != rows[:-1])
    runs, rows = runs[new], rows[new]
    return np.split(runs, np.searchsorted(rows, np.arange(1, w.n_docs))) if w.n_docs else []


def sketches(texts: pa.Array, shingle: int = SHINGLE, share: float = SHARE) -> list[np.ndarray]:
    """The sketch of each text: its hashes below the threshold."""
    limit = np.uint64(int(share * 2.0**64) - 1)
    return [h[: np.searchsorted(h, limit, "right")] for h in all_hashes(texts, shingle)]


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two documents' shingles together."""
    return np.union1d(a, b)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Containment of the smaller of two sketches in the larger; of an empty one 1 in an empty one and 0 in others."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def to_hex(sketch: np.ndarray) -> str:
    """16 hex digits for each hash."""
    return sketch.astype(">u8").tobytes().hex()


def from_hex(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def fingerprint(docs: DataFrame, name: str = "fingerprint") -> DataFrame:
    """docs and the sketch of each text in hex; empty for null and empty texts. One pass without a shuffle."""
    docs = docs.select(*[c for c in docs.columns if c.lower() != name.lower()])
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, at):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(to_hex, sketches(b.column(at))), pa.string())], schema.names)

    return docs.mapInArrow(run, schema)


def _ranges(docs: DataFrame, n: int, n_ids: int, n_rows: int) -> tuple[DataFrame, int]:
    """docs (doc_id, h, ...) with ``range``, 0, 1, ... in the order of falling ids, null last, and the number of ranges.

    Ids are cut at quantiles. An id that makes up several quantiles gets as many ranges, split by h; so do null ids.
    """
    for_null = max(1, round(n * (n_rows - n_ids) / n_rows)) if n_ids < n_rows else 0
    for_ids = max(1, n - for_null)
    found = docs.where("doc_id is not null").agg(F.percentile_approx("doc_id", [i / for_ids for i in range(1, for_ids)], 10_000)).first()[0] if for_ids > 1 else None
    bounds, counts = np.unique(np.array(found or [], np.int64), return_counts=True)
    # Range k (of falling ids) ends with the rows of bound k, which have ranges of their own where it is hot.
    parts = np.where(counts > 1, counts, 0)[::-1]
    offset = np.concatenate([[0], np.cumsum(1 + parts)])
    shared = docs.sparkSession.sparkContext.broadcast((bounds, parts, offset))

    @F.pandas_udf("long")
    def of(ids: pd.Series, h: pd.Series) -> pd.Series:
        asc, parts, offset = shared.value
        ids_, unit = ids.fillna(0).to_numpy(np.int64), h.to_numpy(np.int64) / 2.0**64 + 0.5
        k = len(asc) - np.searchsorted(asc, ids_, "right")
        out = offset[k]
        if len(asc):
            at = np.minimum(k, len(asc) - 1)
            hot = (k < len(asc)) & (asc[::-1][at] == ids_) & (parts[at] > 0)
            out = out + np.where(hot, 1 + np.minimum(parts[at] - 1, (unit * parts[at]).astype(np.int64)), 0)
        null = ids.isna().to_numpy()
        return pd.Series(np.where(null, offset[-1] + 1 + np.minimum(for_null - 1, (unit * for_null).astype(np.int64)), out))

    return docs.withColumn("range", of("doc_id", "h")), int(offset[-1]) + 1 + for_null


def _partition_keys(spark: SparkSession, n: int) -> DataFrame:
    """(range, key): for each of n ranges a number that hash partitioning into n parts sends to the part of the range's number."""
    hashed = spark.range(n * (20 + 2 * n.bit_length())).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("part"))
    return hashed.groupBy(F.col("part").cast("long").alias("range")).agg(F.min("id").alias("key"))


def with_next(docs: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """doc_id, text and next_text: the text of the document that follows in descending order of doc_id; of the last one, the first.

    Rows are cut into ranges of about RANGE_BYTES of text, one to a partition. Every text goes once through the shuffle, to
    its range; the first document of each range also goes to the range before, as a guest at its end. Within a range,
    rows stream in order past the task. Null ids come last; rows with equal ids, and those with null ids, follow by a
    hash of their texts and then the texts, so that many of them are split, too. Null texts are empty.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count("*").alias("rows"), F.count("doc_id").alias("ids")).first()
    if not size["rows"]:
        return spark.createDataFrame([], "doc_id long, text string, next_text string")
    n = n_ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["bytes"] // RANGE_BYTES))
    ranged, n = _ranges(docs, n, size["ids"], size["rows"])
    # The first row of each range: one row per range comes to the driver, without texts.
    place = F.struct(F.col("doc_id").isNull().alias("null"), (-F.col("doc_id")).alias("id"), "h")
    heads = sorted((r["range"], -r["p"]["id"] if r["p"]["id"] is not None else None, r["p"]["h"]) for r in ranged.groupBy("range").agg(F.min(place).alias("p")).collect())
    hosts = spark.createDataFrame([(here, head, h, heads[k - 1][0]) for k, (here, head, h) in enumerate(heads)], "at long, head long, head_h long, host long")
    guests = ranged.join(F.broadcast(hosts), (F.col("range") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("h") == F.col("head_h")))
    rows = ranged.withColumn("guest", F.lit(0)).unionByName(guests.select("doc_id", "text", "h", F.col("host").alias("range"), F.lit(1).alias("guest")))
    placed = rows.join(F.broadcast(_partition_keys(spark, n)), "range").repartition(n, "key")
    ordered = placed.sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), "h", "text").select("doc_id", "text", "range", "guest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for b in blocks(batch, "text"):
                both = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
                here, following = both.slice(0, both.num_rows - 1), both.slice(1)
                # The first guest alone follows the range's last document.
                keep = pc.and_(pc.equal(here["range"], following["range"]), pc.equal(here["guest"], 0))
                out = pa.table([here["doc_id"], here["text"], following["text"]], ["doc_id", "text", "next_text"]).filter(keep)
                yield from out.combine_chunks().to_batches()
                held = both.slice(both.num_rows - 1).combine_chunks().to_batches()[0]

    return ordered.mapInArrow(run, "doc_id long, text string, next_text string")


def compare_edited(pairs: DataFrame) -> DataFrame:
    """From (doc_id, text, next_text): doc_id, n_chars, edited (the edited text), fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all)
    of the next one. near_edited and near_next are the likeness of its sketch to theirs (see likeness()).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, "text"):
                text, following = b.column(1).to_pylist(), b.column(2).to_pylist()
                half = [len(t) // 2 for t in text]
                edited = [t[: len(t) - h] + f[:h] for t, f, h in zip(text, following, half, strict=True)]
                own, other, after = (sketches(pa.array(x, pa.string())) for x in (text, edited, following))
                columns = [
                    b.column(0), pa.array([len(t) for t in text], pa.int64()), pa.array(edited, pa.string()), pa.array(map(to_hex, own), pa.string()), pa.array(map(to_hex, other), pa.string()),
                    pa.array(map(likeness, own, other), pa.float64()), pa.array(map(likeness, own, after), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return pairs.mapInArrow(run, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def merged(sketched: DataFrame, group: str, name: str = "fingerprint") -> DataFrame:
    """(group, hash): the hashes of the merged sketches of each group, as rows, so that a group of any size stays distributed."""
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.length(name) / 16).cast("int") - 1), lambda i: F.substring(F.col(name), (i * 16 + 1).cast("int"), F.lit(16)))
    return sketched.where(F.length(name) > 0).select(group, F.explode(parts).alias("hash")).distinct()
