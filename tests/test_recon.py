import numpy as np
import pytest

from fathomgrid.operators import recon
from fathomgrid.tensor import from_numpy

rng = np.random.default_rng(1)


def test_preconditioner_weights(spark):
    p = spark.createDataFrame([(0, -4.0, 0.0), (1, 0.0, 0.0), (2, 0.0, 0.0), (3, 4.0, 0.0)], "sample int, kx double, ky double")
    w = recon.preconditioner(p, {"kx": "x", "ky": "y"}, 16, {"sample": 4}, width=6).to_numpy().real
    assert np.allclose(w, [1, 0.5, 0.5, 1], atol=2e-2)


def test_lsq_recovers_an_image(spark):
    k = np.arange(-8, 8)
    p = spark.createDataFrame([(i, float(v)) for i, v in enumerate(k)], "sample int, kx double")
    a = recon.encoding(p, {"kx": "x"}, 16, {"sample": 16}, osamp=2.0)
    x = from_numpy(spark, rng.standard_normal(16), ["x"])
    got = recon.recon_lsq(a, a.forward(x).cut(), iterations=3).to_numpy()
    assert np.linalg.norm(got - x.to_numpy()) < 0.05 * np.linalg.norm(x.to_numpy())


def test_resample_and_maps(spark):
    x = from_numpy(spark, np.cos(2 * np.pi * np.arange(8) / 8), ["x"])
    y = recon.resample(x, {"x": 16}).to_numpy()
    assert np.allclose(y[::2], x.to_numpy(), atol=1e-9)
    k = from_numpy(spark, rng.standard_normal((4, 4, 2)), ["x", "y", "channel"])
    m = recon.kernels_to_maps(k, ["x", "y"], 8, 1.5)
    assert m.shape == {"x": 8, "y": 8, "channel": 2}
    whole = recon.kernels_to_maps(k, ["x", "y"], 8, 1.0)
    assert np.allclose(recon.maps_to_kernels(whole, ["x", "y"], 4, 1.0).to_numpy(), k.to_numpy())


def test_small_helpers(spark):
    w = recon.time_windows(spark, 3, 20).groupBy("sample").sum("v").collect()
    assert all(abs(r[1] - 1) < 1e-9 for r in w) and len(w) == 20
    pts = spark.createDataFrame([(1, float(i), float(i**2)) for i in range(6)], "k int, x double, y double")
    got = [r.v for r in recon.spline(pts, "k", "x", "y", [0.0, 2.0, 2.5, 9.0], clamp=True).orderBy("at").collect()]
    assert got[:2] == pytest.approx([0, 4], abs=1e-9) and abs(got[2] - 6.25) < 0.1 and got[3] == pytest.approx(25)
    v = np.linalg.qr(rng.standard_normal((6, 3)))[0].T
    s = np.array([3.0, 2.0, 1.0])
    e = recon.equalised(v, s, 3)
    assert np.allclose(e @ e.T, np.eye(3)) and np.allclose(np.diag(e @ v.T @ np.diag(s**2) @ v @ e.T), (s**2).mean())
    t = from_numpy(spark, np.array([[1 + 3j, 1 - 1j], [2 + 0j, 5j]]), ["x", "f"])
    assert {r.x: r.f for r in recon.autofocus(t, "f").collect()} == {0: 1, 1: 0}
    one = recon.denoise(t, recon.regularisers(spark, t.shape, ["x"], l1=1.0)).to_numpy()
    assert np.allclose(np.abs(one), np.maximum(np.abs(t.to_numpy()) - 1, 0))
