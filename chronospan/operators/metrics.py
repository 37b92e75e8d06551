"""One score per frame (or other key) from its values, with the rules for missing ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.maths import finite_or_null, nan_to_null
from .order_stats import order_statistics

PERCENTILES = {"p99": 99.0, "p995": 99.5, "p999": 99.9}
#: Groups of more values than that don't pass through a task as a whole where order matters.
WIDE = 1 << 16
METHODS = [*PERCENTILES, "percentile", "topk_sum", "excess_mass", "l1", "l2", "lp"]


def check(method: str, q: float = 99.9, topk: int = 2048, thr: float = 3.0, p: float = 4.0, min_finite_frac: float = 1.0, normalize_missing: bool = False) -> None:
    """Raises ValueError for options that no score has."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if not 0 < min_finite_frac <= 1:
        raise ValueError("min_finite_frac lies outside (0, 1]")
    if method == "lp" and p < 1:
        raise ValueError("p must be 1 or more")
    if method == "percentile" and not 0 <= q <= 100:
        raise ValueError("q lies outside [0, 100]")


def _at(ordered: np.ndarray, n: np.ndarray, q: float) -> np.ndarray:
    """The quantile q of the first n values of each ordered row, NaN where n is 0; as score(), it weighs the two nearest values."""
    place = q * np.maximum(n - 1, 0)
    lo = np.floor(place).astype(int)
    a, b = (np.take_along_axis(ordered, i[:, None], axis=1)[:, 0] for i in (lo, np.minimum(lo + 1, np.maximum(n - 1, 0))))
    part = place - lo
    return np.where(n > 0, np.where((part == 0) | (a == b), a, (1 - part) * a + np.where(part == 0, 0, part) * b), np.nan)


def _largest(ordered: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """The sum of the k largest of the first n values of each ordered row, NaN where n is below k."""
    place = np.arange(ordered.shape[1])
    return np.where(n >= k, np.where((place >= (n - k)[:, None]) & (place < n[:, None]), ordered, 0.0).sum(axis=1), np.nan)


def array_scores(rows: np.ndarray, method: str, q: float = 99.9, topk: int = 2048, thr: float = 3.0, p: float = 4.0, min_finite_frac: float = 1.0, normalize_missing: bool = False) -> np.ndarray:
    """score() of the rows of a matrix, for use inside a task: the same rules, NaN where score() gives NULL. Order statistics come
    from rows in order, missing values last."""
    check(method, q, topk, thr, p, min_finite_frac, normalize_missing)
    size, rows = rows.shape[1], rows.astype(np.float64)
    known, real = ~np.isnan(rows), np.isfinite(rows)
    n = real.sum(axis=1)
    up = size / np.maximum(n, 1) if normalize_missing else 1.0
    percentile = lambda: _at(np.sort(rows, axis=1), known.sum(axis=1), PERCENTILES.get(method, q) / 100)
    ways = {
        "topk_sum": lambda: _largest(np.sort(np.where(real, rows, np.nan), axis=1), n, max(1, min(topk, size))) * up,
        "excess_mass": lambda: np.where(known, np.maximum(rows, thr) - thr, 0.0).sum(axis=1) * up,
        "l1": lambda: np.where(known, np.abs(rows), 0.0).sum(axis=1) * up,
        "l2": lambda: np.sqrt((np.where(real, rows, 0.0) ** 2).sum(axis=1) * up),
        "lp": lambda: ((np.abs(np.where(real, rows, 0.0)) ** p).sum(axis=1) * up) ** (1 / p),
    }
    with np.errstate(invalid="ignore", divide="ignore"):
        found = ways.get(method, percentile)()
    return np.where((n > 0) & (n / size >= min_finite_frac), found, np.nan)


def score(values: DataFrame, keys: list[str], value: str, size: int, method: str, q: float = 99.9, topk: int = 2048, thr: float = 3.0, p: float = 4.0, min_finite_frac: float = 1.0, normalize_missing: bool = False) -> DataFrame:
    """keys, n_finite and score of each group of ``size`` values, of which absent rows are missing.

    A score is NULL unless there is a finite value and their share is at least min_finite_frac. Percentiles
    interpolate linearly and let infinities take part; topk_sum is NULL with fewer finite values than k; excess_mass
    and l1 let infinities through, l2 and lp leave them out. normalize_missing scales all but percentiles up to size.
    """
    check(method, q=q, topk=topk, thr=thr, p=p, min_finite_frac=min_finite_frac, normalize_missing=normalize_missing)
    x, finite = nan_to_null(F.col(value).cast("double")), finite_or_null(F.col(value))
    n = F.count(finite)
    up = F.lit(float(size)) / n if normalize_missing else F.lit(1.0)
    source = values
    if size > WIDE and (method == "topk_sum" or method in PERCENTILES or method == "percentile"):
        return _wide_score(values, keys, value, size, method, q, topk, min_finite_frac, normalize_missing)
    if method in PERCENTILES or method == "percentile":
        out = F.percentile(x, PERCENTILES.get(method, q) / 100)
    elif method == "topk_sum":
        k = max(1, min(topk, size))
        rank = F.row_number().over(W.partitionBy(*keys).orderBy(finite.desc_nulls_last()))
        source = values.withColumn("_rank", rank)
        out = F.when(n >= k, F.sum(F.when(F.col("_rank") <= k, finite)) * up)
    elif method == "excess_mass":
        out = F.sum(F.when(x.isNotNull(), F.greatest(x - thr, F.lit(0.0)))) * up
    elif method == "l1":
        out = F.sum(F.abs(x)) * up
    elif method == "l2":
        out = F.sqrt(F.sum(finite * finite) * up)
    else:
        out = F.pow(F.sum(F.pow(F.abs(finite), p)) * up, 1 / p)
    valid = (n > 0) & (n / size >= min_finite_frac)
    return source.groupBy(*keys).agg(n.alias("n_finite"), F.when(valid, out).alias("score"))


def _wide_score(values: DataFrame, keys: list[str], value: str, size: int, method: str, q: float, topk: int, min_finite_frac: float, normalize_missing: bool) -> DataFrame:
    """score() of percentiles and topk_sum without a task that holds or sorts all values of a group (see order_stats)."""
    if method == "topk_sum":
        k = max(1, min(topk, size))
        found = order_statistics(values, keys, value, {}, {"s": k})
        out = F.col("s") * (F.lit(float(size)) / F.col("n_finite")) if normalize_missing else F.col("s")
    else:
        found = order_statistics(values, keys, value, {"s": PERCENTILES.get(method, q) / 100}, {})
        out = F.col("s")
    n = F.col("n_finite")
    return found.select(*keys, "n_finite", F.when((n > 0) & (n / size >= min_finite_frac), out).alias("score"))


def robust_threshold(scores: DataFrame, nsig: float = 3.0, by: list[str] | None = None, value: str = "score") -> DataFrame:
    """by, median, sigma (1.4826 MAD), threshold: median + nsig sigma, or the 99.9th percentile where sigma is 0; NULL without finite scores."""
    by = by or []
    x = scores.select(*by, finite_or_null(F.col(value)).alias("x"))
    centre = x.groupBy(*by).agg(F.median("x").alias("median"), F.percentile("x", 0.999).alias("high"))
    joined = x.join(centre, by) if by else x.crossJoin(F.broadcast(centre))
    spread = joined.groupBy(*by).agg(F.first("median").alias("median"), F.first("high").alias("high"), (1.4826 * F.median(F.abs(F.col("x") - F.col("median")))).alias("sigma"))
    return spread.select(*by, "median", "sigma", F.when(F.col("sigma") > 0, F.col("median") + nsig * F.col("sigma")).otherwise(F.col("high")).alias("threshold"))
