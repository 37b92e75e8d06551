"""Quantiles and sums of the largest values against numpy; groups that need several divisions; infinities and gaps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronospan.operators import metrics
from chronospan.operators.order_stats import order_statistics

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(4)
    return {
        "near": 90 + rng.normal(size=3000) * 1e-3,  # one first bucket, divided again and again
        "wide": np.concatenate([rng.normal(size=900) * 10.0 ** rng.integers(-300, 300, 900), [0.0, -0.0]]),
        "ties": np.repeat([1.0, 2.0, 3.0], 700),
        "gaps": np.concatenate([rng.normal(size=500), [NAN] * 50, [INF] * 3, [-INF] * 4]),
        "few": np.array([5.0, -1.0]),
        "none": np.array([NAN, NAN]),
        None: np.arange(100.0),
    }


def same(a, b):
    return (a is None and (b is None or math.isnan(b))) or (a is not None and (a == b or math.isclose(a, b, rel_tol=1e-12)))


def test_against_numpy(spark, groups):
    df = spark.createDataFrame([(g, float(v)) for g, xs in groups.items() for v in xs], "g string, v double").repartition(5)
    got = {r["g"]: r for r in order_statistics(df, ["g"], "v", {"p99": 0.99, "mid": 0.5, "top": 1.0}, {"k3": 3, "k600": 600}, limit=16).collect()}
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        real, finite = np.sort(xs[~np.isnan(xs)]), np.sort(xs[np.isfinite(xs)])
        assert (got[g]["n"], got[g]["n_finite"]) == (len(real), len(finite))
        for name, q in (("p99", 0.99), ("mid", 0.5), ("top", 1.0)):
            place = q * (len(real) - 1)
            lo, hi = math.floor(place), math.ceil(place)
            want = None if not len(real) else real[lo] if real[lo] == real[hi] else (hi - place) * real[lo] + (place - lo) * real[hi]
            assert same(got[g][name], want), (g, name)
        for name, k in (("k3", 3), ("k600", 600)):
            assert got[g][name] is None if len(finite) < k else math.isclose(got[g][name], finite[-k:].sum(), rel_tol=1e-9), (g, name)


def test_without_keys_and_empty(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    assert order_statistics(df, [], "v", {"q": 0.25}, {"s": 2}, limit=10).collect() == [(1000, 1000, 249.75, 1997.0)]
    assert order_statistics(df.where("false"), [], "v", {"q": 0.25}, {}).count() == 0


@pytest.mark.parametrize("method,options", [("p999", {}), ("percentile", {"q": 12.5}), ("topk_sum", {"topk": 40})])
def test_wide_scores_equal_narrow_ones(spark, groups, monkeypatch, method, options):
    df = spark.createDataFrame([(g, float(v)) for g in ("near", "gaps", "ties", "none") for v in groups[g]], "g string, v double")
    of = lambda: {r["g"]: (r["n_finite"], r["score"]) for r in metrics.score(df, ["g"], "v", 600, method, min_finite_frac=0.5, normalize_missing=True, **options).collect()}
    want = of()
    monkeypatch.setattr(metrics, "WIDE", 100)
    got = of()
    assert got.keys() == want.keys() and all(got[g][0] == want[g][0] and same(got[g][1], want[g][1]) for g in want)


def test_a_whole_frame(spark):
    """331,080 values in one group: no task sorts them."""
    df = spark.range(331_080, numPartitions=4).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 331_080 / 1000 + 70).alias("v"))
    r = metrics.score(df, ["g"], "v", 331_080, "topk_sum", topk=2048).first()
    assert math.isclose(r["score"], sum(k / 1000 + 70 for k in range(331_080 - 2048, 331_080)), rel_tol=1e-12)


def test_array_scores_follow_score(spark, groups):
    x = np.array([groups["gaps"][:500].tolist(), (groups["gaps"][57:557]).tolist(), [NAN] * 500, [1.0, INF] + [3.0] * 498, [-2.5] * 499 + [NAN]])
    df = spark.createDataFrame([(i, float(v)) for i, r in enumerate(x) for v in r], "i int, v double")
    for method, options in [("p99", {}), ("percentile", {"q": 40.0}), ("topk_sum", {"topk": 7}), ("excess_mass", {"thr": 0.5}), ("l1", {}), ("l2", {}), ("lp", {"p": 3.0})]:
        more = {"min_finite_frac": 0.6, "normalize_missing": True} | options
        want = {r["i"]: r["score"] for r in metrics.score(df, ["i"], "v", 500, method, **more).collect()}
        for i, v in enumerate(metrics.array_scores(x, method, **more)):
            assert same(want[i], float(v)) or math.isclose(want[i], v, rel_tol=1e-9), (method, i)
