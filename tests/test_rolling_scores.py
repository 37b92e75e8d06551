"""Rolling PCA scores and the whole search against a plain numpy version."""

import math

import numpy as np
import pytest

from chronospan.functions.selection import FreqMask
from chronospan.operators import background, metrics, rolling, search
from chronospan.plans import queries

H, NAN = rolling.HOUR, float("nan")


def make(spark, n=160, d=12, step=H // 4, seed=3):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, 3)) @ rng.normal(size=(3, d)) + rng.normal(size=(n, d)) * 0.1 + 5).astype(np.float32)
    x[rng.random(x.shape) < 0.01] = NAN
    x[70:74, 3:6] += 9
    t = np.delete(np.arange(n) * step, np.arange(100, 112))  # a gap of three hours
    x = np.delete(x, np.arange(100, 112), axis=0)
    rows = [("A", int(i), int(a), [float(v) for v in r]) for i, (a, r) in enumerate(zip(t, x))]
    rows += [("B", i, int(i * step), [1.0] * d) for i in range(5)]
    return x, t, spark.createDataFrame(rows, "station string, frame_idx long, start_us long, features array<double>")


def slow(x, t, start, stop, c, keep=None):
    out, x = {}, x if keep is None else x[:, keep]
    quiet = [np.nanpercentile(r, 99) if np.isfinite(r).all() else NAN for r in x]
    for h in range(-(-start // H) * H, stop, c.stride_us):
        half = c.context_us // 2
        if t[-1] < h + half:
            continue
        held = [i for i in range(len(t)) if h - half <= t[i] < h + half]
        if c.ring_capacity is not None:
            fire = next(i for i in range(len(t)) if t[i] >= h + half)
            held = [i for i in held if i > fire - c.ring_capacity]
        fit = [i for i in held if not (c.gap_us and h - c.gap_us // 2 <= t[i] < h + c.score_us + c.gap_us // 2)]
        order = sorted((i for i in fit if math.isfinite(quiet[i])), key=lambda i: (quiet[i], i))
        chosen = order[: max(1, math.floor(len(order) * c.quiet_fraction))] if c.n_quiet is None else order[: max(1, min(c.n_quiet, len(order)))]
        scored = [i for i in held if h <= t[i] < h + c.score_us]
        if not chosen or not scored:
            continue
        train = x[chosen].astype(float)
        mu = train.mean(axis=0)
        vt = np.linalg.svd(train - mu, full_matrices=False)[2][: c.k]
        for i in scored:
            z = x[i] - mu
            res = np.maximum(z - (np.nan_to_num(z) @ vt.T) @ vt, 0)
            n = np.isfinite(res).sum()
            out[h, i] = math.sqrt(np.nansum(res**2) * len(res) / n) if n / len(res) >= 0.7 else NAN
    return out


CASES = [dict(k=2), dict(k=0, gap_us=2 * H), dict(k=3, n_quiet=7, ring_capacity=30), dict(k=1, runner_mask=FreqMask.without(12, 2, 5), block=1)]


@pytest.mark.parametrize("case", CASES, ids=str)
def test_run(spark, case):
    x, t, frames = make(spark)
    c = rolling.RollingConfig(context_us=12 * H, method="l2", **case)
    got = rolling.run(frames, 6 * H - 1, 40 * H, c, ["station"])
    keep = np.array([i for i in range(12) if not 2 <= i < 5]) if "runner_mask" in case else None
    want = slow(x, t, 6 * H - 1, 40 * H, c, keep)
    scores = {(r["window_us"], r["frame_idx"]): r["score"] for r in rolling.frame_scores(got, ["station"]).collect()}
    assert scores.keys() == want.keys() and len(scores) > 80
    for key, v in want.items():
        assert scores[key] is None if math.isnan(v) else math.isclose(scores[key], v, rel_tol=1e-6)
    counts = {(r["station"], r["status"]): r["n"] for r in rolling.status_counts(got, ["station"]).collect()}
    assert sum(n for (s, _), n in counts.items() if s == "A") == rolling.n_steps(6 * H - 1, 40 * H, H) == 34
    assert set(s for b, s in counts if b == "B") == {"not_fired"} and ("A", "nothing_to_score") in counts
    for r in got.where("status = 'scored'").collect():
        ranked = [r["score"][i] for i in r["rank_idx"]]
        real = [v for v in ranked if not math.isnan(v)]
        assert all(math.isnan(v) for v in ranked[: len(ranked) - len(real)]) and real == sorted(real, reverse=True)


def test_ring_capacity():
    assert rolling.ring_capacity(24, 300.0) == 288 and rolling.ring_capacity(24, 302.795194368) == 288
    t = np.arange(700) * 300_000_000
    x = np.random.default_rng(0).normal(size=(700, 2)).astype(np.float32)
    of = lambda **k: rolling._window(t, np.arange(700), x, x.max(axis=1), 24 * H, int(t[-1]), rolling.RollingConfig(k=0, method="l2", **k))[1]
    assert of() == 288 and of(ring_capacity=288) == 287


def test_reasons():
    t, x = np.arange(4) * H, np.ones((4, 2), np.float32)
    c = rolling.RollingConfig(context_us=4 * H, k=0, method="l2", gap_us=8 * H)
    of = lambda h, c=c, x=x: rolling._window(t, np.arange(4), x, x.max(axis=1), h, 3 * H, c)[0]
    assert of(2 * H) == rolling.NOT_FIRED and of(-9 * H) == rolling.EMPTY_CONTEXT and of(H) == rolling.ALL_IN_GAP
    c = rolling.RollingConfig(context_us=4 * H, k=0, method="l2")
    assert of(H, c, x * NAN) == rolling.NO_QUIET and of(-H, c) == rolling.NOTHING_TO_SCORE and of(H, c) == rolling.SCORED


def test_config():
    for bad in (dict(score_us=2 * H), dict(quiet_fraction=0.0), dict(k=-1), dict(method="none"), dict(selector_mask=FreqMask(4, ((0, 1),)), background_mask=FreqMask(4), runner_mask=FreqMask(4))):
        with pytest.raises(ValueError):
            rolling.RollingConfig(**bad)
    assert rolling.RollingConfig(selector_mask=FreqMask(4, ((0, 1),)), runner_mask=FreqMask(4)).mask == FreqMask(4)


def test_search_writes(spark, tmp_path):
    _, t, frames = make(spark)
    c = rolling.RollingConfig(context_us=12 * H, k=2, method="l2")
    found = search.search(frames, 6 * H, 40 * H, c, ["station"], nsig=3.0, pad_us=H, merge_gap_us=H)
    search.write_results(found, str(tmp_path / "out"))
    regions = spark.read.parquet(str(tmp_path / "out/rois")).collect()
    assert any(r["start_us"] <= t[70] and r["stop_us"] >= t[73] for r in regions)
    assert spark.read.text(str(tmp_path / "out/config")).first()[0].startswith("{") and found.config["label"] == "l2"


@pytest.mark.parametrize("method,options", [("p99", {}), ("percentile", {"q": 50.0}), ("topk_sum", {"topk": 2}), ("topk_sum", {"topk": 4}), ("excess_mass", {"thr": 3.0}), ("l1", {}), ("l2", {}), ("lp", {"p": 4.0})], ids=str)
@pytest.mark.parametrize("more", [{}, {"normalize_missing": True}], ids=str)
def test_array_scores(spark, method, options, more):
    rows = [[1, 2, 3, 4, 5], [0, 0, 0, 0, 10], [1, NAN, 3, NAN, 5], [-1, -2, 0, 2, 8], [NAN] * 5, [1, math.inf, 3, 4, NAN]]
    if method == "p99":
        rows.pop()  # between a number and infinity
    df = spark.createDataFrame([(i, float(v)) for i, r in enumerate(rows) for v in r], "frame_idx long, x double")
    want = {r["frame_idx"]: r["score"] for r in metrics.score(df, ["frame_idx"], "x", 5, method, min_finite_frac=0.6, **options, **more).collect()}
    got = metrics.array_scores(np.array(rows, float), method, min_finite_frac=0.6, **options, **more)
    for i, v in enumerate(got):
        assert want[i] is None if math.isnan(v) else math.isclose(want[i], v, rel_tol=1e-9)


def test_group_pca(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 8)) + 2
    x[5, 2] = NAN
    x[6, 1] = math.inf
    df = spark.createDataFrame([("g", i, [float(v) for v in r], i % 4 < 3) for i, r in enumerate(x)], "g string, frame_idx long, features array<double>, quiet boolean")
    train = x[[i for i in range(60) if i % 4 < 3 and np.isfinite(x[i]).all()]]
    mu = train.mean(axis=0)
    for k in (0, 2, 3, 8):
        vt = np.linalg.svd(train - mu, full_matrices=False)[2][: min(k, 3)]
        z = np.where(np.isfinite(x), x - mu, NAN)
        want = z - (np.nan_to_num(z) @ vt.T) @ vt
        got = {(r["frame_idx"], r["pix"]): r["residual"] for r in background.pca_residuals(df, ["g"], k).collect()}
        assert len(got) == x.size
        for (i, j), v in got.items():
            assert v is None if math.isnan(want[i, j]) else abs(v - want[i, j]) < 1e-6
    scores = background.outlier_scores(background.pca_residuals(df, ["g"], 2), ["frame_idx"], 8, topk=3, min_finite_frac=1.0).collect()
    assert {r["frame_idx"] for r in scores if r["score"] is None} == {5, 6}
    want = np.linalg.svd((y := x[np.isfinite(x).all(axis=1)]) - y.mean(axis=0), compute_uv=False)[:3]
    assert np.allclose([r["value"] for r in background.singular_values(df, ["g"], 5).orderBy("i").collect()], want)


def test_basis():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 500))
    mean, basis, s = background.pca_basis(x, 8)
    _, want, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(s, want[:8]) and np.allclose(np.abs((basis * vt[:8]).sum(axis=1)), 1)
    res = background.residuals(x, mean, basis)
    assert np.abs(res @ basis.T).max() < 1e-9 and np.allclose(background.residuals(x, *background.pca_basis(x, 40)[:2]), 0)
    assert (background.pca_basis(x, 2, center=False)[0] == 0).all()
    with pytest.raises(ValueError):
        background.pca_basis(x[:0], 2)


def test_query(spark):
    got = queries.rolling_scores(spark, "/root/testdata/sf0.001")
    assert got.columns == ["station", "time_us", "frame_idx", "score"]
