"""The measurement engine against hand-checked values and numpy."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronospan.functions import grid, maths
from chronospan.operators import background, frames, metrics, rois, series
from chronospan.plans.pipeline import Pipeline, db_step, stokes_i_step

INF, NAN = float("inf"), float("nan")
ROWS = [[1, 2, 3, 4, 5], [0, 0, 0, 0, 10], [1, NAN, 3, NAN, 5], [-1, -2, 0, 2, 8], [NAN] * 5]
EXPECTED = {
    ("p99",): [4.96, 9.6, 4.96, 7.76, None],
    ("topk_sum", "topk", 2): [9, 10, 8, 10, None],
    ("topk_sum", "topk", 4): [14, 10, None, 9, None],
    ("excess_mass", "thr", 3.0): [3, 7, 2, 5, None],
    ("l1",): [15, 10, 9, 13, None],
    ("l2",): [7.416198, 10, 5.91608, 8.544004, None],
    ("lp", "p", 4.0): [5.593655, 10, 5.156498, 8.016065, None],
}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, float(v)) for i, r in enumerate(ROWS) for v in r], "frame_idx long, x double")


@pytest.mark.parametrize("how", list(EXPECTED), ids=str)
def test_metrics(rows, how):
    method, *option = how
    got = {r["frame_idx"]: r["score"] for r in metrics.score(rows, ["frame_idx"], "x", 5, method, min_finite_frac=0.6, **dict([option] if option else [])).collect()}
    for i, want in enumerate(EXPECTED[how]):
        assert got[i] is None if want is None else math.isclose(got[i], want, abs_tol=1e-5)


def test_metrics_refuse(rows):
    for bad in ({"method": "nope"}, {"method": "l1", "min_finite_frac": 0.0}, {"method": "lp", "p": 0.5}):
        with pytest.raises(ValueError):
            metrics.score(rows, ["frame_idx"], "x", 5, **bad)


def test_rois(spark):
    s = [1, 2, 1, 2, 50, 60, 2, 1, None, 55, 1, 2, 1, 2, 1, 2, 1, 2, 1, 70, 2, 1]
    minute = 60_000_000
    df = spark.createDataFrame([("A", i * 5 * minute, None if v is None else float(v)) for i, v in enumerate(s)], "station string, time_us long, score double")
    assert math.isclose(metrics.robust_threshold(df, 3.0, ["station"]).first()["threshold"], 6.4478, abs_tol=1e-4)
    got = sorted((r["start_us"] // minute, r["stop_us"] // minute, r["peak_score"], r["sum_score"], r["n_frames"]) for r in rois.find_rois(df, ["station"], 3.0, 5 * minute, 20 * minute).collect())
    assert got == [(15, 50, 60.0, 165.0, 3), (90, 100, 70.0, 70.0, 1)]
    assert rois.find_rois(df.where("false"), ["station"]).columns[1:] == ["start_us", "stop_us", "peak_score", "sum_score", "n_frames"]
    with pytest.raises(ValueError):
        rois.find_rois(df, ["station"], value="none")


def test_frame_plan(spark):
    p = grid.plan_frames(100, 0.0, 10.0, 35.0, 905.0, 200.0, 45.0)
    assert (p.window_n, p.step_n, p.i_start, p.i_stop, p.n_frames) == (20, 5, 4, 91, 14)
    assert grid.plan_frames(100, 0.0, 10.0, -500.0, 5000.0, 200.0, 45.0).n_frames == 17
    for bad in ((35.0, 20.0, 200.0), (0.0, 100.0, 200.0), (0.0, 900.0, -1.0)):
        with pytest.raises(ValueError):
            grid.plan_frames(100, 0.0, 10.0, bad[0], bad[1], bad[2], 45.0)
    got = {(r["frame_idx"], r["t_idx"]) for r in frames.assign(spark.range(100).withColumnRenamed("id", "t_idx"), p).collect()}
    assert got == {(k, t) for k in range(14) for t in range(4 + 5 * k, 24 + 5 * k)}
    assert grid.hour_starts(datetime(2024, 1, 1, 0, 30), datetime(2024, 1, 1, 3), 1.0) == [datetime(2024, 1, 1, 1), datetime(2024, 1, 1, 2)]


def test_interpolation_and_correlation(spark):
    knots = spark.createDataFrame([("s", 0.0, 10.0), ("s", 1.0, 20.0), ("s", 2.0, 40.0)], "k string, x double, y double")
    points = spark.createDataFrame([("s", x) for x in (-1.0, 0.5, 1.5, 9.0)], "k string, x double")
    assert [r["y"] for r in series.interpolate(knots, points, ["k"]).orderBy("x").collect()] == [10, 15, 30, 40]
    a, b = [0, 0, 1, 0, 0, 0], [1, 0, 0, 0, 0, 0]
    pairs = spark.createDataFrame([("s", i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "k string, t long, a double, b double")
    best = series.best_lag(series.cross_correlation(pairs, ["k"], "t", "a", "b", 3), ["k"]).first()
    assert best["lag"] == 2 and math.isclose(best["corr"], 0.933333, abs_tol=1e-6) and best["relation"] == "lags"


def test_leap_seconds(spark):
    got = spark.range(1).select(F.timestamp_micros(maths.decode_leap_seconds(F.lit(775_872_000.0))).cast("string").alias("t")).first()["t"]
    assert got == "2024-08-02 12:00:05"


def test_pca():
    x = np.random.default_rng(0).normal(size=(20, 30))
    mean, basis, s = background.pca_basis(x, 5)
    r = background.residuals(x, mean, basis)
    u, sv, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(s, sv[:5]) and np.allclose(r, (x - x.mean(0)) - (x - x.mean(0)) @ vt[:5].T @ vt[:5]) and np.allclose(r @ basis.T, 0)
    mean, basis, _ = background.pca_basis(x, 0)
    assert np.allclose(background.residuals(x, mean, basis), x - x.mean(0))
    mean, basis, _ = background.pca_basis(x, 99)
    assert np.allclose(background.residuals(x, mean, basis), 0)


def test_pipeline(spark):
    p = Pipeline(("pol00", "pol11")).add(stokes_i_step()).add(db_step())
    assert p.output() == (("stokes_i",), "db")
    row = p.apply(spark.createDataFrame([(1, 10.0, 30.0)], "i int, pol00 double, pol11 double")).first()
    assert math.isclose(row["stokes_i"], 10 * math.log10(20))
    with pytest.raises(ValueError):
        p.add(db_step())
    with pytest.raises(ValueError):
        Pipeline(("pol11", "pol00")).add(stokes_i_step())
    with pytest.warns(UserWarning):
        Pipeline(("stokes_q",)).add(db_step())
    with pytest.raises(ValueError):
        maths.safe_db(F.lit(1.0), 0.0)
