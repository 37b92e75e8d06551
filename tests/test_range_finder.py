"""The randomised PCA against the exact one."""

import numpy as np
import pytest

from chronospan.operators import background, range_finder


@pytest.fixture(scope="module")
def wide(spark):
    """Two groups of 240 features: components that fall off over some noise; rows with gaps; rows that are not quiet."""
    rng = np.random.default_rng(11)
    x = {}
    for g, n in (("a", 300), ("b", 90)):
        scale = 40.0 * 0.6 ** np.arange(12)
        x[g] = (rng.normal(size=(n, 12)) * scale) @ np.linalg.qr(rng.normal(size=(240, 12)))[0].T + rng.normal(size=(n, 240)) * 0.01 + 80
    rows = [(g, i, [float(v) for v in r], i % 7 != 3) for g, m in x.items() for i, r in enumerate(m)]
    rows[4] = (*rows[4][:2], [float("nan"), *rows[4][2][1:]], True)
    return x, spark.createDataFrame(rows, "g string, frame_idx long, features array<double>, quiet boolean").repartition(4)


def quiet(x, g):
    keep = [i for i in range(len(x[g])) if i % 7 != 3 and (g, i) != ("a", 4)]
    return x[g][keep]


@pytest.mark.parametrize("center", [True, False])
def test_agrees_with_the_exact_pca(wide, center):
    """Residuals of 6 components: within 1e-4 of their size of the exact ones; singular values to 1e-6."""
    x, frames = wide
    for r in range_finder.fit_groups(frames, ["g"], 6, center=center, block=50).collect():
        mean, basis, singular = background.pca_basis(quiet(x, r["g"]), 6, center)
        assert r["n"] == len(quiet(x, r["g"])) and np.allclose(r["singular"], singular, rtol=1e-6) and np.allclose(r["mean"], mean)
        want = background.residuals(x[r["g"]], mean, basis)
        got = background.residuals(x[r["g"]], np.array(r["mean"]), np.array(r["basis"]))
        assert np.linalg.norm(got - want) < 1e-4 * np.linalg.norm(want)
        assert np.allclose(np.array(r["basis"]) @ np.array(r["basis"]).T, np.eye(6), atol=1e-9)


def test_seeds_and_few_rows(spark, wide):
    _, frames = wide
    of = lambda **k: {r["g"]: (r["singular"], r["basis"]) for r in range_finder.fit_groups(frames, ["g"], 4, n_iter=0, oversample=2, **k).collect()}
    a, b, c = of(seed=1), of(seed=1, block=20), of(seed=2)
    assert all(np.allclose(a[g][0], b[g][0]) and np.allclose(np.abs(np.array(a[g][1]) @ np.array(b[g][1]).T), np.eye(4), atol=1e-6) for g in a)
    assert not all(np.allclose(a[g][0], c[g][0], rtol=1e-12) for g in a)
    few = spark.createDataFrame([("z", i, [float(i), 2.0, 1.0 - i, 5.0], True) for i in range(3)], "g string, frame_idx long, features array<double>, quiet boolean")
    r = range_finder.fit_groups(few, ["g"], 6).first()
    assert len(r["singular"]) == 1 and np.isclose(r["singular"][0], 2.0)
    with pytest.raises(ValueError):
        range_finder.fit_groups(few, ["g"], 0)
