"""Bounded samples of labelled documents, for fitting; the rest is for calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARTS = 1 << 30


def draw(labels: DataFrame, condition: Column, most: int | None, seed: int, share: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Ids (column ``_id``) of label rows that fulfil condition, in two parts chosen by a hash of the id: a sample of at most
    about ``most`` ids (None: as many as there are) and at most ``share`` of them, and the others."""
    fit = labels.where(F.col("doc_id").isNotNull()).where(condition).select(F.col("doc_id").alias("_id")).distinct()
    cut = int(_PARTS * (share if most is None else min(share, most / max(1, fit.count()))))
    at = F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(_PARTS))
    return fit.where(at < cut), fit.where(at >= cut)


def texts_of(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The rows of docs with sampled ids. The ids, bounded by draw(), are broadcast, so texts stay in place."""
    return docs.join(F.broadcast(sample), docs["doc_id"] == sample["_id"], "left_semi")
