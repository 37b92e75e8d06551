"""Exact quantiles and sums of the largest values of groups of any size, by selection over histograms.

A histogram counts the values of a group by buckets that keep their order, and has each bucket's sum, smallest and largest value.
Histograms of parts add up, so they combine before the shuffle. A rank lies in one bucket, known from the counts; a bucket of many
different values is divided again, between its own smallest and largest value, until at most LIMIT values are left, which are
put in order. So a task holds the buckets of a group and LIMIT values, never a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.maths import nan_to_null
from ..sources.tables import written

LIMIT = 4096
#: Buckets of each factor e, and of each further division.
FINE, PARTS = 64, 4096


def _first_bucket(x: Column) -> Column:
    """A number that rises with x: by its sign, then by the logarithm of its amount; infinities have buckets of their own."""
    size = F.floor(F.log(F.abs(x)) * FINE) + 1000 * FINE
    return F.when(x == 0, 0).when(F.abs(x) == float("inf"), F.signum(x) * 1_000_000).otherwise(F.signum(x) * size).cast("long")


def _counted(values: DataFrame, by: list[str]) -> DataFrame:
    finite = F.when(F.abs(F.col("x")) != float("inf"), F.col("x")).otherwise(0.0)
    return values.groupBy(*by).agg(F.count("*").alias("n"), F.sum(finite).alias("total"), F.min("x").alias("lo"), F.max("x").alias("hi"))


def _placed(histogram: DataFrame, by: list[str]) -> DataFrame:
    """Buckets with the number of values below and the sum of those above."""
    order = W.partitionBy(*by).orderBy("bucket")
    below = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    above = F.coalesce(F.sum("total").over(order.rowsBetween(1, W.unboundedFollowing)), F.lit(0.0))
    return histogram.withColumn("below", below).withColumn("over", above)


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with numbered names for its keys, which _same() compares."""
    return df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in df.columns if c not in keys])


def _same(keys: list[str]) -> Column:
    """NULL keys are groups as well."""
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))


def _joined(values: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Values within the buckets of targets; the targets are few beside the values, and Spark sends them to these where they are small."""
    there = _renamed(targets, keys).withColumnsRenamed({"lo": "_lo", "hi": "_hi"}).drop("n")
    return values.join(there, _same(keys) & F.col("x").between(F.col("_lo"), F.col("_hi")))


def order_statistics(values: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], largest: dict[str, int], limit: int = LIMIT) -> DataFrame:
    """keys, n (values that are no NaN), n_finite, and a column for each of ``quantiles`` (name: share) and ``largest`` (name: k).

    Quantiles interpolate between neighbours, as percentile() does, infinities included; of the k largest finite values it gives the
    sum, NULL where there are fewer. Groups without a value have no statistics, but a row.
    """
    if not keys:
        return order_statistics(values.withColumn("_all", F.lit(0)), ["_all"], value, quantiles, largest, limit).drop("_all")
    x = values.select(*keys, nan_to_null(F.col(value).cast("double")).alias("x"))
    real = x.where("x is not null")
    histogram = written(_counted(real.withColumn("bucket", _first_bucket(F.col("x"))), [*keys, "bucket"]), "histogram")
    is_inf = F.abs(F.col("lo")) == float("inf")
    sizes = histogram.groupBy(*keys).agg(F.sum("n").alias("_n"), F.sum(F.when(is_inf, 0).otherwise(F.col("n"))).alias("_finite"), F.sum(F.when(F.col("lo") == float("-inf"), F.col("n")).otherwise(0)).alias("_least"))
    n, wanted = F.col("_n"), []
    for name, share in quantiles.items():
        place = F.lit(float(share)) * (n - 1)
        wanted += [F.struct(F.lit(f"{name}/a").alias("target"), F.floor(place).alias("rank")), F.struct(F.lit(f"{name}/b").alias("target"), F.ceil(place).alias("rank"))]
    for name, k in largest.items():
        wanted.append(F.when(F.col("_finite") >= k, F.struct(F.lit(name).alias("target"), (F.col("_least") + F.col("_finite") - k).alias("rank"))))
    targets = sizes.select(*keys, F.inline(F.filter(F.array(*wanted), lambda t: t.isNotNull())))

    def within(placed: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
        """Each target with the bucket that its rank lies in."""
        joined = asked.join(_renamed(placed, by), _same(by)).where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("n")))
        return joined.select(*keys, "target", (F.col("rank") - F.col("below")).alias("rank"), (F.col("above") + F.col("over")).alias("above"), "n", "lo", "hi")

    found = written(within(_placed(histogram, keys), targets.withColumn("above", F.lit(0.0)), keys), "targets")
    done = []
    while True:
        wide = (F.col("n") > limit) & (F.col("lo") < F.col("hi"))
        done.append(found.where(~wide))
        found = found.where(wide)
        if found.isEmpty():
            break
        share = (F.col("x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        parts = _joined(real, found, keys).withColumn("bucket", F.floor(share * PARTS).cast("long"))
        by = [*keys, "target"]
        found = written(within(_placed(_counted(parts, [*by, "bucket"]), by), found.select(*by, "rank", "above"), by), "targets")
    closed = reduce(DataFrame.unionByName, done)
    few = _joined(real, closed.where("lo < hi"), keys).groupBy(*keys, "target").agg(F.first("rank").alias("rank"), F.first("above").alias("above"), F.sort_array(F.collect_list("x")).alias("xs"))
    few = few.select(*keys, "target", F.element_at("xs", (F.col("rank") + 1).cast("int")).alias("v"), (F.col("above") + F.aggregate(F.slice("xs", (F.col("rank") + 1).cast("int"), F.size("xs")), F.lit(0.0), lambda s, v: s + v)).alias("top"))
    equal = closed.where("lo = hi").select(*keys, "target", F.col("lo").alias("v"), (F.col("above") + (F.col("n") - F.col("rank")) * F.col("lo")).alias("top"))
    got = few.unionByName(equal)
    of = lambda target, c: F.max(F.when(F.col("target") == target, F.col(c)))
    per = got.groupBy(*keys).agg(*[of(f"{q}/{s}", "v").alias(f"{q}/{s}") for q in quantiles for s in "ab"], *[of(name, "top").alias(name) for name in largest])
    every = x.groupBy(*keys).agg(F.count("x").alias("n"), F.count(F.when(F.abs(F.col("x")) != float("inf"), 1)).alias("n_finite"))
    joined = every.join(_renamed(per, keys), _same(keys), "left")
    place = lambda share: F.lit(float(share)) * (F.col("n") - 1)
    between = lambda q, share: F.when(F.col(f"{q}/a") == F.col(f"{q}/b"), F.col(f"{q}/a")).otherwise((F.ceil(place(share)) - place(share)) * F.col(f"{q}/a") + (place(share) - F.floor(place(share))) * F.col(f"{q}/b"))
    return joined.select(*keys, "n", "n_finite", *[between(f"{q}", share).alias(q) for q, share in quantiles.items()], *largest)
