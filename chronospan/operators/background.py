"""Quiet background: selection of quiet frames, low-rank PCA per group, residuals and their scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.maths import finite_or_null
from . import metrics


def n_quiet_of(n: Column, fraction: float, n_quiet: int | None = None) -> Column:
    """How many of n scored frames are quiet: max(1, floor(fraction * n)), or n_quiet clamped to [1, n]."""
    if not 0 < fraction <= 1:
        raise ValueError("the quiet fraction lies outside (0, 1]")
    return F.greatest(F.lit(1), F.floor(n * fraction)) if n_quiet is None else F.greatest(F.lit(1), F.least(F.lit(n_quiet).cast("long"), n))


def select_quiet(scores: DataFrame, by: list[str], fraction: float, order: str = "frame_idx", value: str = "score", n_quiet: int | None = None, on_none: str = "raise") -> DataFrame:
    """The quietest scores of each group (see n_quiet_of). Only finite scores count, ties go by ``order``.

    A group without a finite score raises when the rows are computed, or is left out with on_none="skip".
    """
    if on_none not in ("raise", "skip"):
        raise ValueError("on_none is raise or skip")
    x, w = finite_or_null(F.col(value)), W.partitionBy(*by)
    rows = scores.withColumn("_n", F.count(x).over(w)).withColumn("_r", F.row_number().over(w.orderBy(x.asc_nulls_last(), order)))
    keep = x.isNotNull() & (F.col("_r") <= n_quiet_of(F.col("_n"), fraction, n_quiet))
    if on_none == "raise":
        keep = F.when(F.col("_n") == 0, F.raise_error(F.lit("no finite quiet score in a group")).cast("boolean")).otherwise(keep)
    return rows.where(keep).drop("_n", "_r")


def pca_basis(training: np.ndarray, k: int, center: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, basis of at most k rows, singular values) of complete rows, by the eigenvectors of the smaller of their two Gram matrices. Without centring the mean is 0."""
    if not len(training):
        raise ValueError("no complete row to fit")
    mean = training.mean(axis=0, dtype=np.float64) if center else np.zeros(training.shape[1])
    x = training.astype(np.float64) - mean
    wide = x.shape[1] > x.shape[0]
    values, vectors = np.linalg.eigh(x @ x.T if wide else x.T @ x)
    order = np.argsort(values)[::-1][: min(k, *x.shape)]
    values, vectors = values[order], vectors[:, order]
    real = values > max(1e-12 * max(values[:1], default=0.0), 0)
    values, vectors = values[real], vectors[:, real]
    return mean, (vectors / np.sqrt(values)).T @ x if wide else vectors.T, np.sqrt(values)


def residuals(rows: np.ndarray, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Rows less their projection; a missing entry counts as the mean in the projection and stays missing."""
    x = rows - mean
    filled = np.where(np.isfinite(x), x, 0.0)
    return x - (filled @ basis.T) @ basis


def _complete(frames: DataFrame, by: list[str], features: str, quiet: str | None) -> DataFrame:
    """by and x (array of doubles) of the quiet rows without a gap."""
    x = F.col(features)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return frames.where(whole & (F.col(quiet) if quiet else F.lit(True))).select(*by, x.cast("array<double>").alias("x"))


def _means(rows: DataFrame, by: list[str], center: bool) -> DataFrame:
    """by, n and mean (zeros without centring) of the rows of _complete()."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    found = rows.groupBy(*by).agg(F.count("*").alias("n"), vector_to_array(Summarizer.mean(array_to_vector(F.col("x")))).alias("mean"))
    return found if center else found.withColumn("mean", F.transform("mean", lambda v: F.lit(0.0)))


def _moments(frames: DataFrame, by: list[str], features: str, quiet: str | None, center: bool = True) -> DataFrame:
    """by, n, mean, sums and products (upper triangle of the cross products) of the quiet, complete rows less their mean, by partial aggregates.

    No group is held by a task: a row contributes D + D (D + 1) / 2 numbers to sums that combine before the shuffle. The mean goes off
    first, as sums of squares less squares of sums would lose what is small beside it.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = _complete(frames, by, features, quiet)
    means = _means(rows, by, center)
    rows = rows.join(means.drop("n"), by).withColumn("x", F.zip_with("x", "mean", lambda v, m: v - m))
    upper = F.flatten(F.transform("x", lambda v, i: F.transform(F.slice("x", i + 1, F.size("x") - i), lambda u: v * u)))
    rows = rows.select(*by, array_to_vector("x").alias("_v"), array_to_vector(upper).alias("_p"))
    found = rows.groupBy(*by).agg(Summarizer.sum(F.col("_v")).alias("sums"), Summarizer.sum(F.col("_p")).alias("products"))
    return found.select(*by, vector_to_array("sums").alias("sums"), vector_to_array("products").alias("products")).join(means, by)


def fit_groups(frames: DataFrame, by: list[str], k: int, features: str = "features", quiet: str | None = "quiet", center: bool = True) -> DataFrame:
    """by, n, mean, basis (array of at most k arrays), singular (all singular values): the PCA of each group's quiet, complete rows.

    For groups of any number of rows and up to some hundred features: per group, one D x D matrix is decomposed. Components whose
    eigenvalue is below 1e-12 of the largest are none. Without centring the mean is 0.
    """
    types = dict(frames.dtypes)

    def run(batches):
        for pdf in batches:
            out = []
            for n, sums, products in zip(pdf["n"], pdf["sums"], pdf["products"], strict=True):
                rest = np.asarray(sums) / n if center else np.zeros(len(sums))
                d = len(rest)
                m = np.zeros((d, d))
                m[np.triu_indices(d)] = products
                m = m + np.triu(m, 1).T - n * np.outer(rest, rest)
                values, vectors = np.linalg.eigh(m)
                values, vectors = values[::-1], vectors[:, ::-1]
                rank = int(min((values > max(1e-12 * values[0], 0)).sum(), n - center))
                out.append((vectors[:, : min(k, rank)].T, np.sqrt(values[:rank])))
            yield pd.DataFrame({c: pdf[c] for c in (*by, "n", "mean")} | {"basis": [o[0].tolist() for o in out], "singular": [o[1].tolist() for o in out]})

    schema = ", ".join(f"`{c}` {types[c]}" for c in by) + ", n long, mean array<double>, basis array<array<double>>, singular array<double>"
    return _moments(frames, by, features, quiet, center).select(*by, "n", "mean", "sums", "products").mapInPandas(run, schema)


def residual_arrays(frames: DataFrame, fitted: DataFrame, by: list[str], features: str = "features", out: str = "residual") -> DataFrame:
    """frames and ``out``: features less their projection, NaN where they are missing. Fits are met by an equi-join; no row is exploded."""
    joined = frames.join(fitted.select(*by, "mean", "basis"), by)
    gap = F.zip_with(F.col(features).cast("array<double>"), "mean", lambda v, m: F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v - m))
    joined = joined.withColumn("_x", gap)
    weight = lambda b: F.aggregate(F.zip_with("_x", b, lambda v, w: F.coalesce(v, F.lit(0.0)) * w), F.lit(0.0), lambda s, v: s + v)
    joined = joined.withColumn("_w", F.transform("basis", weight))
    scaled = F.zip_with("_w", "basis", lambda w, b: F.transform(b, lambda v: v * w))
    shift = F.aggregate(scaled, F.transform("mean", lambda v: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda p, q: p + q))
    result = F.zip_with("_x", shift, lambda v, s: F.when(v.isNotNull(), v - s).otherwise(F.lit(float("nan"))))
    return joined.withColumn(out, result).drop("_x", "_w", "mean", "basis")


def pca_residuals(frames: DataFrame, by: list[str], k: int, features: str = "features", quiet: str = "quiet") -> DataFrame:
    """by, frame_idx, pix, residual of all frames against the PCA of the quiet, complete ones of their group. Missing entries have a NULL residual."""
    res = residual_arrays(frames.select(*by, "frame_idx", features), fit_groups(frames, by, k, features, quiet), by, features)
    return res.select(*by, "frame_idx", F.posexplode("residual").alias("pix", "residual")).withColumn("pix", F.col("pix").cast("long")).withColumn("residual", finite_or_null(F.col("residual")))


def positive(x: Column | str) -> Column:
    """max(x, 0), but missing where x is: greatest() alone would turn a missing residual into 0."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(x, F.lit(0.0)))


def outlier_scores(residual: DataFrame, keys: list[str], size: int, value: str = "residual", positive_only: bool = True, method: str = "topk_sum", min_finite_frac: float = 0.7, normalize_missing: bool = True, **options) -> DataFrame:
    """keys, n_finite, score of residuals in rows: cut off at 0 below (positive_only), then a metric. Missing residuals stay missing."""
    rows = residual.withColumn(value, positive(value)) if positive_only else residual
    return metrics.score(rows, keys, value, size, method, min_finite_frac=min_finite_frac, normalize_missing=normalize_missing, **options)


def array_outlier_scores(residual: DataFrame, keys: list[str], value: str = "residual", positive_only: bool = True, method: str = "topk_sum", min_finite_frac: float = 0.7, normalize_missing: bool = True, **options) -> DataFrame:
    """keys, n_finite, score as outlier_scores() gives them, of residuals in arrays (one per row, as residual_arrays() makes them): scored where they are."""
    options |= {"min_finite_frac": min_finite_frac, "normalize_missing": normalize_missing}
    metrics.check(method, **options)
    types = dict(residual.dtypes)

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 64):  # few rows at a time, as they may be wide
                part = b.slice(k, 64)
                x = part.column(len(keys)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                x = x.reshape(part.num_rows, -1)
                x = np.maximum(x, 0.0) if positive_only else x
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.array(np.isfinite(x).sum(axis=1)), pa.array(metrics.array_scores(x, method, **options), from_pandas=True)], [*keys, "n_finite", "score"])

    return residual.select(*keys, value).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keys) + ", n_finite long, score double")


def singular_values(frames: DataFrame, by: list[str], k: int, features: str = "features") -> DataFrame:
    """by, i, value: the largest k singular values of each group's centred complete rows."""
    found = fit_groups(frames, by, 0, features, None).select(*by, F.posexplode(F.slice("singular", 1, k)).alias("i", "value"))
    return found.withColumn("i", F.col("i").cast("long"))
