"""The further queries against their SQL twins, and what has no query: preconditioners, calibration, low rank patches, TGV, storage errors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomgrid.functions import generators as G
from fathomgrid.operators import differences, fourier, prox, recon
from fathomgrid.plans import catalogue, further
from fathomgrid.sources import store
from fathomgrid.tensor import Tensor, from_numpy

from .test_queries import duck  # noqa: F401

R = np.random.default_rng(4)
NAMES = [k for k, f in catalogue.QUERIES.items() if f.__module__ == further.__name__] + ["wavelet_d6_multi", "traj_spiral", "traj_phyllotaxis", "resample_lines", "noisify_lines", "spline_lines"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, sf_dir, name):  # noqa: F811
    got = catalogue.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalogue.ORACLES[name])
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def points(spark, n, axis="kx"):
    return spark.createDataFrame([(i, float(k)) for i, k in enumerate(n)], f"sample int, {axis} double")


def test_wavelets_are_orthogonal():
    for n, width in ((64, 6), (32, 4), (48, 4), (20, 8)):
        m = differences.wavelet_matrix(n, width)
        assert np.allclose(m @ m.T, np.eye(n), atol=1e-5)


def test_low_rank_windows(spark):
    a = R.standard_normal((8, 8, 3)) + 1j * R.standard_normal((8, 8, 3))
    x = from_numpy(spark, a, ["i", "j", "b"])
    got = prox.LocallyLowRank(0.05, ["i", "j"], "b", 4, 2, {"i": 1}).apply(1.0, x).to_numpy()
    want = np.zeros_like(a)
    cut = 0.05 * (4 + np.sqrt(3) + np.sqrt(np.log(36 * 3)))
    for i0 in range(-1, 9, 2):
        for j0 in range(0, 8, 2):
            i, j = min(max(i0 - 1, 0), 4), min(max(j0 - 1, 0), 4)
            u, s, v = np.linalg.svd(a[i : i + 4, j : j + 4].reshape(16, 3), full_matrices=False)
            p = ((u * np.maximum(s - cut, 0)) @ v).reshape(4, 4, 3)
            lo, hi = max(i0, 0), min(i0 + 2, 8)
            want[lo:hi, j0 : j0 + 2] = p[lo - i : hi - i, j0 - j : j0 - j + 2]
    assert np.allclose(got, want)


def test_patches_negate_a_volume(spark):
    a = np.stack([np.full((6, 6), 1.0), np.full((6, 6), 2.0)], 2)
    y = prox.patches(from_numpy(spark, a, ["i", "j", "b"]), ["i", "j"], 3, 3, np.negative)
    assert np.allclose(y.to_numpy(), -a)


def test_tgv_and_tv2_regularisers(spark):
    s = {"i": 6, "j": 6}
    a = R.standard_normal((6, 6))
    x = from_numpy(spark, a, ["i", "j"])
    regs, extract = recon.tgv(spark, s, ["i", "j"], 0.3)
    assert regs[0].t.ishape == regs[1].t.ishape == extract.ishape
    g = differences.gradient(spark, s, ["i", "j"]).forward(x)
    both = extract.adjoint(x).df.unionByName(g.df.withColumn("block", F.lit(1)))
    stacked = Tensor(both, extract.ishape)
    assert regs[0].forward(stacked).norm() < 1e-12
    assert np.allclose(extract.forward(stacked).df.select("i", "j", "re").toPandas().set_index(["i", "j"]).re.sort_index().to_numpy(), a.ravel())
    (tv2,) = recon.regularisers(spark, s, ["i", "j"], tv2=1.0)
    assert [p.lam for p in tv2.prox.parts] == [pytest.approx(0.77), pytest.approx(0.23)]
    (tv,) = recon.regularisers(spark, s, ["i", "j"], iso="g", tv=1.0)
    assert isinstance(tv.prox, prox.L2)
    with pytest.raises(ValueError):
        recon.regularisers(spark, s, ["i", "j"], iso="q", tv=1.0)


def test_preconditioners(spark):
    p = points(spark, [-4.0, 0.0, 0.0, 4.0])
    one = recon.make_preconditioner("single", p, {"kx": "x"}, 16, {"sample": 4})
    w = one.to_numpy().real
    assert np.allclose(w[1], w[2]) and np.allclose(w[0], w[3]) and 1.7 < w[0] / w[1] < 2.3
    maps = from_numpy(spark, np.ones((16, 2)), ["x", "channel"])
    many = recon.make_preconditioner("multi", p, {"kx": "x"}, 16, {"sample": 4}, maps).to_numpy().real
    # two channels of ones see the field of view twice
    ratio = many / w[:, None]
    assert many.shape == (4, 2) and np.allclose(ratio, ratio[0, 0])
    assert recon.make_preconditioner("none", p, {"kx": "x"}, 16, {"sample": 4}) is None
    with pytest.raises(ValueError):
        recon.make_preconditioner("multi", p, {"kx": "x"}, 16, {"sample": 4})


def test_decanted_transform_is_the_one_with_maps(spark):
    """Kernels of one cell are constant maps: both ways give the same samples, and adjoints agree."""
    p = points(spark, np.linspace(-7.5, 7.5, 16))
    k = from_numpy(spark, np.array([[1.0, 0.5j]]), ["x", "channel"])
    a = fourier.nufft_decant(p, {"kx": "x"}, 16, {"sample": 16}, k)
    x = from_numpy(spark, R.standard_normal(16) + 1j * R.standard_normal(16), ["x"])
    plain = fourier.nufft(p, {"kx": "x"}, 16, {"sample": 16}).forward(x).to_numpy()
    y = a.forward(x)
    assert list(y.shape) == ["sample", "channel"]
    got = y.to_numpy()
    ratio = got[:, 0] / plain
    assert np.allclose(ratio, ratio[0]) and np.allclose(got[:, 1], 0.5j * got[:, 0])
    z = from_numpy(spark, R.standard_normal((16, 2)) + 1j * R.standard_normal((16, 2)), ["sample", "channel"])
    assert np.isclose(y.dot(z), x.dot(a.adjoint(z)))


def test_low_memory_transform(spark):
    p = points(spark, np.linspace(-7.5, 7.5, 16))
    k = from_numpy(spark, R.standard_normal((4, 2)), ["x", "channel"])
    a = recon.nufft_lowmem(p, {"kx": "x"}, 16, {"sample": 16}, k)
    maps = recon.kernels_to_maps(k, ["x"], 16)
    x = from_numpy(spark, R.standard_normal(16), ["x"])
    want = recon.encoding(p, {"kx": "x"}, 16, {"sample": 16}, maps, 2.0).forward(x).to_numpy()
    assert np.allclose(a.forward(x).to_numpy(), want)


def test_self_calibration(spark, tmp_path):
    m = 16
    p = points(spark, np.arange(-8, 8))
    axes, samples = {"kx": "x"}, {"sample": 16}
    true = np.stack([np.exp(1j * np.pi * np.arange(m) / m), 0.5 + np.arange(m) / m], 1)
    image = np.exp(-(((np.arange(m) - 8) / 4) ** 2))
    data = fourier.nufft(p, axes, m, samples, 1.3, 4, {"channel": 2}).forward(from_numpy(spark, image[:, None] * true, ["x", "channel"])).cut()
    c = recon.low_resolution_channels(p, axes, m, samples, data, 8.0, 1)
    assert c.shape == {"x": m, "channel": 2}
    a = np.abs(c.to_numpy())
    assert np.corrcoef(a[4:12, 1], np.abs(image * true[:, 1])[4:12])[0, 1] > 0.95
    kernels = recon.choose_kernels("auto", p, axes, m, samples, data, 8.0, 4, iterations=1).cut()
    assert kernels.shape == {"x": 4, "channel": 2}
    at = str(tmp_path / "kernels")
    store.write_tensor(kernels, at)
    again = recon.choose_kernels(at, p, axes, m, samples, data, 8.0)
    assert np.allclose(again.to_numpy(), kernels.to_numpy())
    with pytest.raises(ValueError):
        recon.choose_kernels(at, p, axes, m, samples, Tensor(data.df, {**data.shape, "channel": 3}), 8.0)


def test_point_spread_without_weights(spark):
    p = points(spark, np.arange(-8, 8))
    a = fourier.nufft(p, {"kx": "x"}, 16, {"sample": 16})
    y = np.abs(recon.point_spread(spark, a, {"x": 8}, iterations=4).to_numpy())
    assert y.argmax() == 8 and y[8] > 0.9


def test_oversampled_image_keeps_its_values(spark):
    x = np.cos(2 * np.pi * np.arange(16) / 16)
    y = recon.oversampled(from_numpy(spark, x, ["x"]), ["x"]).to_numpy()
    assert y.shape == (32,) and np.allclose(y[::2], x, atol=1e-9)


def test_checked_dot(spark):
    t = from_numpy(spark, np.array([1.0, 2j]), ["x"])
    assert t.checked_dot(t) == 5
    with pytest.raises(ArithmeticError):
        t.checked_dot(from_numpy(spark, np.array([1.0, 2.0]), ["x"]))


def test_store_errors(spark, tmp_path):
    at = str(tmp_path / "s")
    assert store.names(spark, at) == [] and not store.exists(spark, at)
    t = from_numpy(spark, R.standard_normal((2, 3, 2)), ["a", "b", "c"])
    store.write_tensor(t, at)
    assert store.exists(spark, at) and store.read_into(t, at).shape == t.shape
    with pytest.raises(ValueError):
        store.read_into(Tensor(t.df, {**t.shape, "a": 5}), at)
    with pytest.raises(ValueError):
        store.read_matrix(spark, at)
    with pytest.raises(ValueError):
        store.read_weights(spark, at, {"a": 2}, "data")
    with pytest.raises(ValueError):
        store.read_trajectory(spark, at, "data")
    sink = store.DebugSink(str(tmp_path / "debug"))
    assert [sink.write("x", t) for _ in range(3)] == ["x", "x-1", "x-2"]
    store.write_log(spark, [("Op", "begins"), ("Io", "reads")], str(tmp_path / "log"))
    log = spark.read.text(str(tmp_path / "log")).withColumnRenamed("value", "line")
    assert [r.line for r in store.log_lines(log, "Io").collect()] == ["[Io] reads"]


def test_basis_of_masked_courses(spark):
    from fathomgrid.operators import sense, stats

    a = np.outer(np.r_[np.ones(20), np.full(12, 0.01)], np.exp(-np.arange(6) / 3)).astype(complex) * 1j
    t = from_numpy(spark, a, ["cell", "t"])
    c = sense.time_courses(t, otsu=True)
    assert {r.cell for r in c.select("cell").distinct().collect()} == set(range(20))
    b = stats.basis_from_courses(spark, c, ["cell"], "t", 1, 6)
    e = np.exp(-np.arange(6) / 3)
    assert np.isclose(abs(b[0] @ e), np.linalg.norm(e))


def test_steady_state_is_where_long_runs_settle():
    seq = {"alpha": 0.1, "TR": 0.01, "Tramp": 0.01, "Tssi": 0.02, "spoil": 1, "spokes": 4, "segments": 2}
    got = G.steady_state("zte", seq | {"T1": 1.2, "B1": 0.9})
    m = 1.0
    relax = lambda m, t: 1 + (m - 1) * np.exp(-t / 1.2)
    for _ in range(400):
        out = []
        for _ in range(2):
            m = relax(relax(m, 0.01), 0.01)
            for _ in range(4):
                out.append(m * np.sin(0.09))
                m = relax(m * np.cos(0.09), 0.01)
            m = relax(relax(m, 0.01), 0.02)
    assert np.allclose(got, out, rtol=1e-3)
