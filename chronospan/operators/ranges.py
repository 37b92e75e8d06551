"""Running values over the rows of a group in order, by ranges of the order: no task holds a group.

Each range is worked on by itself; its summary (a count, a sum, a largest value, a first and last row) is one row, and summaries are
carried along over the ranges of a group, which are few. The rows go through one exchange, by group and range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PART = "_part"


def dealt(df: DataFrame, by: list[str], order: str, width: float) -> DataFrame:
    """df with PART (the range of ``order`` that a row lies in), dealt by group and range."""
    if not width > 0:
        raise ValueError("ranges need a width above 0")
    return df.withColumn(PART, F.floor(F.col(order) / width)).repartition(*by, PART)


def width_of(df: DataFrame, order: str, ranges: int | None = None) -> float:
    """A width that cuts the order's extent into so many ranges (by default as many as there are shuffle partitions)."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = df.agg(F.min(order).cast("double").alias("lo"), F.max(order).cast("double").alias("hi")).first()
    return max((ends["hi"] - ends["lo"]) / max(n, 1), 1e-9) if ends["lo"] is not None and ends["hi"] > ends["lo"] else 1.0


def within(by: list[str], order: str | list[str]):
    """The window of a range's rows in order."""
    return W.partitionBy(*by, PART).orderBy(*([order] if isinstance(order, str) else order))


def along(by: list[str]):
    """The window of a group's ranges in order."""
    return W.partitionBy(*by).orderBy(PART)


def meet(df: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df and the other columns of right where the keys agree; NULL keys agree with each other."""
    named = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)), F.lit(True))
    return df.join(named if keys else F.broadcast(named), same, how).drop(*[f"_r{i}" for i in range(len(keys))])


def running(df: DataFrame, by: list[str], order: str | list[str], value: Column, how: str, out: str, inclusive: bool = True) -> DataFrame:
    """dealt rows with ``out``: the sum or the maximum of value over the rows of the group so far (without the row itself, unless inclusive)."""
    f = {"sum": F.sum, "max": F.max}[how]
    df = df.withColumn("_v", value)
    here = f("_v").over(within(by, order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1))
    parts = df.groupBy(*by, PART).agg(f("_v").alias("_t"))
    parts = parts.select(*by, PART, f("_t").over(along(by).rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    met = meet(df.withColumn("_here", here), parts, [*by, PART])
    both = F.coalesce("_here", F.lit(0)) + F.coalesce("_before", F.lit(0)) if how == "sum" else F.greatest("_here", "_before")
    return met.withColumn(out, both).drop("_v", "_here", "_before")


def numbered(df: DataFrame, by: list[str], order: str, out: str, width: float | None = None) -> DataFrame:
    """df with its rows' numbers (0, 1, ...) in each group, in order."""
    rows = dealt(df, by, order, width or width_of(df, order))
    return running(rows, by, order, F.lit(1), "sum", out).withColumn(out, F.col(out) - 1).drop(PART)
