"""PCA of groups with thousands of features by a randomised range finder.

A few random directions (k and some more) are sent through X^T X; the range of what comes out is close to that of the
largest components, and closer with each further pass. Rows of a group are dealt to blocks of bounded size; a block gives X^T (X W),
features by directions, and these sums combine over the blocks. So a pass moves the rows once, and no task holds a group
or a matrix of features by features.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from . import background

BLOCK = 2048


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fit_groups(frames: DataFrame, by: list[str], k: int, features: str = "features", quiet: str | None = "quiet", center: bool = True, oversample: int = 10, n_iter: int = 2, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """by, n, mean, basis, singular of each group's quiet, complete rows, as background.fit_groups() gives them; singular holds k values at most.

    Of singular values that fall off, the first k are found to about (s[k+oversample] / s[k]) ** (2 n_iter + 1); the same seed gives the same
    directions. A block holds about ``block`` rows.
    """
    if k < 1 or oversample < 0 or n_iter < 0 or block < 1:
        raise ValueError("k and the block must be 1 or more, oversample and n_iter not negative")
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    types, width = dict(frames.dtypes), k + oversample
    keys = ", ".join(f"`{c}` {types[c]}" for c in by)
    rows = written(background._complete(frames, by, features, quiet).withColumn("_row", F.monotonically_increasing_id()), "pca-rows")
    means = written(background._means(rows, by, center), "pca-means")
    parts = F.ceil(F.col("n") / block)
    blocked = rows.join(means.select(*by, "mean", parts.alias("_parts")), by).select(*by, F.pmod(F.col("_row"), F.col("_parts")).alias("_block"), F.zip_with("x", "mean", lambda v, m: v - m).alias("x"))
    numbers = means.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_block"))

    def first(g: pa.Table) -> pa.Table:
        x = _matrix(g.column("x"))
        directions = np.random.default_rng(seed).normal(size=(x.shape[1], min(width, x.shape[1])))
        return out(g, x.T @ (x @ directions))

    def again(g: pa.Table, q: pa.Table) -> pa.Table:
        if not g.num_rows:
            return out(q, None)
        x = _matrix(g.column("x"))
        return out(g, x.T @ (x @ q.column("q")[0].values.to_numpy().reshape(x.shape[1], -1)))

    def small(g: pa.Table, q: pa.Table) -> pa.Table:
        if not g.num_rows:
            return out(q, None)
        x = _matrix(g.column("x"))
        y = x @ q.column("q")[0].values.to_numpy().reshape(x.shape[1], -1)
        return out(g, y.T @ y)

    def out(g: pa.Table, m: np.ndarray | None) -> pa.Table:
        values = [] if m is None else [m.ravel()]
        return pa.Table.from_arrays([*(pa.array([g.column(c)[0].as_py()] * len(values), g.schema.field(c).type) for c in by), pa.array(values, pa.list_(pa.float64()))], names=[*by, "part"])

    def summed(found: DataFrame) -> DataFrame:
        return found.groupBy(*by).agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("sum"))

    def orthogonal(sums: DataFrame, name: str) -> DataFrame:
        """by and q: an orthonormal basis of the summed columns."""

        def run(batches):
            for b in batches:
                q = [np.linalg.qr(np.reshape(s, (len(m), -1)))[0].ravel() for s, m in zip(b.column("sum").to_pylist(), b.column("mean").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in by], pa.array(q, pa.list_(pa.float64()))], [*by, "q"])

        return written(sums.join(means, by).select(*by, "sum", "mean").mapInArrow(run, f"{keys}, q array<double>"), name)

    def through(q: DataFrame, f) -> DataFrame:
        own = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  both sides come from the same tables
        return summed(own(blocked).groupBy(*by, "_block").cogroup(own(numbers.join(q, by)).groupBy(*by, "_block")).applyInArrow(f, f"{keys}, part array<double>"))

    q = orthogonal(summed(blocked.groupBy(*by, "_block").applyInArrow(first, f"{keys}, part array<double>")), "range-0")
    for i in range(n_iter):
        q = orthogonal(through(q, again), f"range-{i + 1}")

    def decompose(batches):
        for b in batches:
            found = []
            for s, q_, mean, n in zip(*(b.column(c).to_pylist() for c in ("sum", "q", "mean", "n")), strict=True):
                directions = np.reshape(q_, (len(mean), -1))
                values, vectors = np.linalg.eigh(np.reshape(s, (directions.shape[1], -1)))
                values, vectors = values[::-1], vectors[:, ::-1]
                rank = int(min((values > max(1e-12 * values[0], 0)).sum(), max(n - center, 0), k))
                found.append(((directions @ vectors[:, :rank]).T.tolist(), np.sqrt(values[:rank]).tolist()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*by, "n", "mean")], pa.array([f[0] for f in found], pa.list_(pa.list_(pa.float64()))), pa.array([f[1] for f in found], pa.list_(pa.float64()))], [*by, "n", "mean", "basis", "singular"])

    ready = through(q, small).join(q, by).join(means, by).select(*by, "sum", "q", "mean", "n")
    return ready.mapInArrow(decompose, f"{keys}, n long, mean array<double>, basis array<array<double>>, singular array<double>")
