"""Adjoint dot tests, round trips and exact small cases for the operators; numpy is the measure."""

import math

import numpy as np
import pytest

from fathomgrid.functions import generators as G
from fathomgrid.operators import differences, fourier, prox, sense, shape, solvers, stats
from fathomgrid.operators.linop import Adjoint, Compose, Diagonal, DStack, Extract, HStack, Identity, Loop, Normal, Scale, Subtract, VStack, adjoint, compose, matmul
from fathomgrid.sources import store
from fathomgrid.tensor import combine, from_numpy

rng = np.random.default_rng(0)


def rand(*n):
    return rng.standard_normal(n) + 1j * rng.standard_normal(n)


def dot_test(spark, op):
    x = from_numpy(spark, rand(*op.ishape.values()), op.ishape)
    y = from_numpy(spark, rand(*op.oshape.values()), op.oshape)
    a, b = op.forward(x).dot(y), x.dot(op.adjoint(y))
    assert abs(a - b) <= 1e-9 * max(abs(a), 1)
    return x, y


@pytest.mark.parametrize(
    "make",
    [
        lambda s: fourier.dft(s, {"x": 8, "c": 2}, "x"),
        lambda s: fourier.FFT({"x": 4, "y": 6, "c": 2}, ["x", "y"]),
        lambda s: shape.Pad({"x": 3, "y": 3}, {"x": 6, "y": 7}),
        lambda s: shape.Crop({"x": 7}, {"x": 4}),
        lambda s: differences.gradient(s, {"x": 4, "y": 5, "c": 2}, ["x", "y"]),
        lambda s: differences.divergence(s, {"x": 4, "y": 5, "c": 2}, ["x", "y"]),
        lambda s: differences.gradient_of_vector(s, {"x": 4, "y": 4}, ["x", "y"]),
        lambda s: differences.laplacian(s, {"x": 5, "y": 4}, ["x", "y"]),
        lambda s: differences.isotropic_laplacian(s, {"x": 4, "y": 4, "z": 4}, ["x", "y", "z"]),
        lambda s: differences.wavelets(s, {"x": 16, "c": 2}, ["x"], 6),
        lambda s: sense.Sense(from_numpy(s, rand(4, 3), ["x", "channel"]), along={"t": 2}),
        lambda s: sense.Segments(s.createDataFrame([(i, 0.1 * i) for i in range(4)], "x int, f double"), {"x": 4}, [0.0, 0.5]),
        lambda s: Diagonal({"x": 4, "c": 2}, from_numpy(s, rand(4), ["x"])),
    ],
)
def test_adjoints(spark, make):
    dot_test(spark, make(spark))


def test_gridding_adjoint_and_nufft(spark):
    pts = [(i, float(k)) for i, k in enumerate(rng.uniform(-7.5, 7.4, 12))]
    p = spark.createDataFrame([*pts, (12, float("nan"))], "sample int, k double")
    g = fourier.gridding(p, {"k": "x"}, 16, {"sample": 13}, 2.0, 4)
    dot_test(spark, g)
    exact, fast = fourier.ndft(p, {"k": "x"}, 16, {"sample": 13}), fourier.nufft(p, {"k": "x"}, 16, {"sample": 13}, 2.0, 6)
    x = from_numpy(spark, rand(16), ["x"])
    a, b = exact.forward(x).to_numpy(), fast.forward(x).to_numpy()
    k = np.array([v for _, v in pts])
    m = np.exp(-2j * np.pi * k[:, None] * (np.arange(16) - 8) / 16) / 4
    assert np.allclose(a[:12], m @ x.to_numpy())
    assert np.linalg.norm(a - b) < 1e-3 * np.linalg.norm(a)
    dot_test(spark, fast)


def test_fft_tiers_and_impulses(spark):
    a = rand(3, 8)
    x = from_numpy(spark, a, ["c", "x"])
    want = np.fft.fftshift(np.fft.fft(np.fft.ifftshift(a, 1), axis=1, norm="ortho"), 1)
    assert np.allclose(fourier.dft(spark, {"x": 8, "c": 3}, "x").forward(type(x)(x.df, {"x": 8, "c": 3})).to_numpy().T, want)
    assert np.allclose(fourier.FFT(x.shape, ["x"]).forward(x).to_numpy(), want)
    with pytest.raises(ValueError):
        fourier.FFT({"x": 7}, ["x"])


def test_wavelets_invert(spark):
    x = from_numpy(spark, rand(32), ["x"])
    for width in (4, 6, 8):
        w = differences.wavelets(spark, {"x": 32}, ["x"], width)
        assert np.allclose(w.adjoint(w.forward(x)).to_numpy(), x.to_numpy(), atol=1e-6)


def test_gradient_norm(spark):
    start = from_numpy(spark, (-1.0) ** np.arange(8), ["x"])
    value, _ = solvers.power_method(differences.gradient(spark, {"x": 8}, ["x"]), start, 2)
    assert value == pytest.approx(1.0)


def test_slices(spark):
    x = from_numpy(spark, np.arange(12.0), ["x"])
    assert shape.slice_dim(x, "x", 1, 9, 4).to_numpy().real.tolist() == [1, 5, 9]
    assert shape.slice_dim(x, "x", -3).to_numpy().real.tolist() == [9, 10, 11]
    assert shape.slice_dim(x, "x", 2, -4).to_numpy().real.tolist() == [2, 3, 4, 5, 6, 7]
    with pytest.raises(ValueError):
        shape.slice_dim(x, "x", 8, 5)
    two = shape.split_dim(x, "x", 4, "s")
    assert two.shape == {"x": 4, "s": 3} and np.allclose(shape.merge_dims(two, "s", "x").to_numpy(), x.to_numpy())
    assert shape.append(x, x, "x").shape == {"x": 24}
    assert np.allclose(shape.difference(x, x.scaled(2)).to_numpy(), x.to_numpy())
    assert np.allclose(x.chip("x", 3).df.first().re, 3)


def test_algebra(spark):
    s = {"x": 4}
    x = from_numpy(spark, rand(4), ["x"])
    d = Diagonal(s, from_numpy(spark, np.arange(1.0, 5), ["x"]))
    assert compose(Identity(s), d) is d and compose(d, Identity(s)) is d
    both = compose(Scale(s, 2), compose(Scale(s, 3), d))
    assert isinstance(both, Compose) and both.left.factor == 6 and both.right is d
    assert isinstance(d.H, Adjoint) and d.H.H is d
    assert isinstance(compose(shape.Crop({"x": 8}, s), shape.Pad(s, {"x": 8})), Identity)
    for op in (VStack([d, Scale(s, 2)]), HStack([d, Scale(s, 2)]), DStack([d, Scale(s, 2)]), Subtract(d, Scale(s, 1j)), Normal(d), adjoint(both), Extract({"block": 2, "x": 4}, 1, s), Loop(d, "t", 2), Loop(both, "t", 2)):
        dot_test(spark, op)
    assert np.allclose(d.inverse(x, 2.0, 1.0).to_numpy(), x.to_numpy() / (2 * np.arange(1.0, 5) + 1))
    with pytest.raises(ValueError):
        d.forward(from_numpy(spark, rand(5), ["x"]))


def test_prox_moreau(spark):
    x = from_numpy(spark, rand(3, 4), ["x", "b"])
    b = from_numpy(spark, rand(3, 4), ["x", "b"])
    for p in (prox.L1(0.25), prox.L1I(0.25), prox.L2(0.25, ["b"]), prox.SumOfSquares(b), prox.L1(0.25, b), prox.Null()):
        a = 0.5
        left = combine([(1, p.apply(a, x)), (a, p.conj(1 / a, x.scaled(1 / a)))])
        want = x.to_numpy()
        if isinstance(p, prox.L1I):
            want = want.real + 1j * want.imag
        if not isinstance(p, prox.Null):
            assert np.allclose(left.to_numpy(), want, atol=1e-9), type(p)
    shrunk = prox.L1(1.0).apply(1.0, from_numpy(spark, [-3.0, -2, -1, 0, 1, 2], ["x"])).to_numpy().real
    assert shrunk.tolist() == [-2, -1, 0, 0, 0, 1]


def test_low_rank(spark):
    u, v = rand(16, 1), rand(1, 4)
    x = from_numpy(spark, (u @ v).reshape(4, 4, 4), ["i", "j", "b"])
    y = prox.LocallyLowRank(1e-3, ["i", "j"], "b", 4).apply(1.0, x).to_numpy()
    ratio = y / x.to_numpy()
    assert np.allclose(ratio, ratio.flat[0]) and 0.9 < ratio.flat[0].real < 1


def _ones(spark):
    m = np.eye(6) + 1
    rows = [(int(o), int(i), float(w), 0.0) for (o, i), w in np.ndenumerate(m)]
    return m, matmul(spark.createDataFrame(rows, "o int, i int, wr double, wi double"), 6, 6, "x")


def test_solvers(spark):
    m, op = _ones(spark)
    want = np.arange(6.0)
    b = from_numpy(spark, m @ want, ["x"])
    for got in (solvers.LSMR(op, iterations=6).run(b), solvers.LSQR(op, iterations=6).run(b), solvers.conjugate_gradients(op, b, 6)):
        assert np.allclose(got.to_numpy(), want, atol=1e-3)
    value, _ = solvers.power_method(op, from_numpy(spark, np.ones(6), ["x"]), 3)
    assert value == pytest.approx(np.linalg.eigvalsh(m.T @ m)[-1])


def test_regularised(spark):
    s = {"x": 4}
    b = from_numpy(spark, [3.0, 0.2, -2.0, 0.1], ["x"])
    want = [2.5, 0, -1.5, 0]
    reg = [solvers.Regulariser(prox.L1(0.5))]
    a = solvers.ADMM(Identity(s), reg, outer=4, inner=1, rho=1.0, epsilon=1e-4).run(b).to_numpy().real
    p = solvers.PDHG(Identity(s), reg, iterations=8, tol=1e-6).run(b).to_numpy().real
    assert np.allclose(a, want, atol=0.2) and np.allclose(p, want, atol=0.2)


def test_statistics(spark):
    v = rng.gamma(2.0, 1.0, 500)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    s = np.sort(v)
    got = {r.p: r.v for r in stats.nearest_rank(df, [0.0, 0.5, 0.9, 1.0]).collect()}
    assert got == {p: s[int(p * 499)] for p in (0.0, 0.5, 0.9, 1.0)}
    best = min((((v < t).mean() * v[v < t].var(ddof=1) + (v >= t).mean() * v[v >= t].var(ddof=1), k) for k, t in enumerate(np.linspace(0, v.max(), 128)) if 1 < (v >= t).sum() < 499))
    r = stats.otsu(df).first()
    assert r.threshold == pytest.approx(np.linspace(0, v.max(), 128)[best[1]]) and r.above == (v >= r.threshold - 1e-12).sum()
    x = rand(3, 20)
    t = from_numpy(spark, x, ["c", "s"])
    m = stats.small_matrix(stats.gram(t, "c"), 3)
    assert np.allclose(m, x.conj() @ x.T / 2)
    k = stats.compression(t, "c", 3)
    y = stats.apply_matrix(t, "c", k).to_numpy()
    assert np.allclose(np.linalg.norm(y), np.linalg.norm(x))
    g = stats.gram_schmidt(rand(3, 5))
    assert np.allclose(g @ g.conj().T, np.eye(3))


def test_generators(spark):
    assert G.frames(spark, 2, 3, 1).count() == 6
    b = G.bernstein(spark, 3, 9).groupBy("trace").sum("v").collect()
    assert all(abs(r[1] - 1) < 1e-12 for r in b)
    for p in (G.archimedean(spark, 8, 2.0, 16), G.phyllotaxis(spark, 8, 2.0, 16, 3, 4)):
        far = p.selectExpr("max(sqrt(kx*kx+ky*ky+kz*kz)) m", "count(distinct trace) n").first()
        assert far.n == 16 and far.m < 4
    f = G.fourier_basis(4, 16)
    assert f.shape == (4, 16) and np.allclose(f @ f.conj().T, np.eye(4))
    assert G.basis_scale(10, 10, 3) == math.sqrt(33)
    seq = {"alpha": 0.05, "TR": 0.005, "Tramp": 0.01, "Tssi": 0.01, "spoil": 1, "spokes": 8, "segments": 2, "Trec": 1.0, "TE": 0.05}
    for kind in ("zte", "ir", "t2prep", "dir", "t2flair"):
        s = G.steady_state(kind, seq | {"T1": 1.0, "T2": 0.1})
        assert len(s) == 16 and np.isfinite(s).all()
    t = from_numpy(spark, np.zeros(50), ["x"])
    a, b2 = (G.noisify(type(t)(t.df.repartition(n), t.shape), 2.0, 1).to_numpy() for n in (1, 3))
    assert np.array_equal(a, b2) and 1 < a.std() < 5


def test_trajectories(spark):
    p = spark.createDataFrame([(0, 0, 0.0, 1.0), (1, 0, 9.0, 1.0), (2, 1, 3.0, float("nan")), (3, 1, 2.0, 2.0)], "sample int, trace int, kx double, ky double")
    v = sense.valid_points(p, ["kx", "ky"], 16)
    assert v.filter("isnan(kx)").count() == 2
    r = sense.bounds(v, ["kx", "ky"]).first()
    assert (r.first_sample, r.last_sample, r.last_trace) == (0, 3, 1)
    assert sense.guess_matrix(v, ["kx"]).first()[0] == 4
    n = spark.range(40).selectExpr("cast(id as int) trace")
    got = {(r.trace, r.nav) for r in sense.nav_windows(n, 4, 10, 24, 40).collect()}
    assert got == {(t, k) for k in range(4) for t in range(max(10 * k - 12, 0), min(10 * k + 12, 40))}


def test_storage(spark, tmp_path):
    x = from_numpy(spark, rand(3, 4), ["x", "t"])
    at = str(tmp_path / "a")
    store.write_tensor(x, at, header={"tr": 2.0}, meta={"te": 0.5})
    assert store.describe(spark, at)["info"]["tr"] == 2.0
    back = store.read_tensor(spark, at, rank=2)
    assert np.allclose(back.to_numpy(), x.to_numpy())
    slab = store.read_tensor(spark, at, slab={"t": 2})
    assert np.allclose(slab.to_numpy(), x.to_numpy()[:, 2])
    assert "PushedFilters: [IsNotNull(t), EqualTo(t,2)]" in slab.df._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        store.read_tensor(spark, at, rank=3)
    with pytest.raises(IndexError):
        store.read_tensor(spark, at, slab={"t": 4})
    n = store.nifti_bytes(np.arange(24.0).reshape(2, 3, 4))
    assert len(n) == 352 + 96 and n[344:347] == b"n+1" and np.frombuffer(n[352:], "<f4")[1] == 12
