"""The rolling PCA by pixel blocks against the one that holds a context in a task; offsets; gaps."""

import math

import numpy as np
import pytest

from chronospan.functions.selection import FreqMask
from chronospan.operators import background, pixel_pca, rolling

from .test_rolling_scores import make

H = rolling.HOUR
CASES = [dict(k=3, gap_us=2 * H, block=2), dict(k=0), dict(k=2, center=False, positive_only=False), dict(k=20, n_quiet=9, runner_mask=FreqMask.without(12, 2, 5))]


@pytest.mark.parametrize("case", CASES, ids=str)
def test_equals_the_runner_over_whole_frames(spark, case):
    _, _, frames = make(spark)
    c = rolling.RollingConfig(context_us=12 * H, method="l2", **case)
    of = lambda df: {(r["station"], r["window_us"]): r for r in df.collect()}
    want = of(rolling.run(frames, 6 * H - 1, 40 * H, c, ["station"]))
    got = of(pixel_pca.run(frames, 6 * H - 1, 40 * H, c, ["station"], pixels=5))
    assert got.keys() == want.keys()
    seen = 0
    for key, w in want.items():
        g = got[key]
        assert (g["status"], g["n_context"], g["n_quiet"], g["frame_idx"]) == (w["status"], w["n_context"], w["n_quiet"], w["frame_idx"] if w["frame_idx"] else g["frame_idx"])
        for a, b in zip(g["score"] or [], w["score"] or [], strict=True):
            assert math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-9 if c.k < 9 else 1e-7, abs_tol=1e-9), (key, a, b)
            seen += 1
    assert seen > 80


@pytest.mark.parametrize("offset", [0.0, 1e4, 1e6])
def test_group_pca_with_an_offset(spark, offset):
    x = np.random.default_rng(1).normal(size=(200, 8)) * 0.001 + offset
    x[5, 2] = np.nan
    frames = spark.createDataFrame([(0, i, [float(v) for v in r], True) for i, r in enumerate(x)], "g int, frame_idx long, features array<double>, quiet boolean")
    whole = np.delete(x, 5, axis=0)
    mean, basis, singular = background.pca_basis(whole, 8)
    fit = background.fit_groups(frames, ["g"], 3).first()
    assert len(fit["singular"]) == 8 and np.allclose(fit["singular"], singular, rtol=1e-6)
    res = background.residual_arrays(frames.select("g", "frame_idx", "features"), background.fit_groups(frames, ["g"], 3), ["g"]).collect()
    want = background.residuals(x, mean, basis[:3])
    assert all(np.allclose(r["residual"], want[r["frame_idx"]], atol=1e-8, equal_nan=True) for r in res)


def test_arrays_score_as_rows_do(spark):
    x = np.random.default_rng(2).normal(size=(40, 30))
    x[x > 1.5] = np.nan
    frames = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "frame_idx long, residual array<double>")
    rows = frames.selectExpr("frame_idx", "posexplode(residual) as (p, residual)")
    for method, options in (("topk_sum", {"topk": 4}), ("p99", {}), ("l2", {})):
        got = {r["frame_idx"]: (r["n_finite"], r["score"]) for r in background.array_outlier_scores(frames, ["frame_idx"], method=method, **options).collect()}
        want = {r["frame_idx"]: (r["n_finite"], r["score"]) for r in background.outlier_scores(rows, ["frame_idx"], 30, method=method, **options).collect()}
        assert got.keys() == want.keys() and all(g[0] == want[i][0] and g[1] == pytest.approx(want[i][1]) for i, g in got.items())
