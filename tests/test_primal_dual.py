"""Primal-dual steps, dictionaries, separable transforms, ranks and Gram matrices, against numpy."""

import numpy as np
import pytest

from fathomgrid.operators import fourier, prox, sense, solvers, stats
from fathomgrid.operators.linop import Diagonal, Identity
from fathomgrid.tensor import Tensor, from_numpy


@pytest.mark.parametrize("lad", [False, True])
def test_weighted_data_term(spark, lad):
    rng = np.random.default_rng(1)
    b, w = rng.normal(size=6), rng.uniform(0.5, 2, 6)
    s = {"x": 6}
    reg = solvers.Regulariser(prox.L1(0.3))
    got = solvers.PDHG(Identity(s), [reg], iterations=3, tol=0.0, m=Diagonal(s, from_numpy(spark, w, ["x"])), lad=lad, restart=3).run(from_numpy(spark, b, ["x"])).to_numpy().real
    t = 1 / np.sqrt(2)
    x = bar = mean = np.zeros(6)
    y, z = np.zeros(6), np.zeros(6)
    for n in range(3):
        y = y + t * w * (bar - b)
        y = y / np.maximum(abs(y), 1) if lad else y / (1 + t * w)
        z = z + t * bar
        z = 0.3 * z / np.maximum(abs(z), 0.3)
        new = x - t * (y + z)
        bar, x = 2 * new - x, new
        mean = mean + (x - mean) / (n + 2)
    assert np.allclose(got, mean)


def test_hook_stops(spark):
    seen = []
    s = {"x": 2}
    b = from_numpy(spark, [1.0, 2.0], ["x"])
    solvers.PDHG(Identity(s), [solvers.Regulariser(prox.L1(0.1))], iterations=6, tol=0.0, restart=2, hook=lambda k, x: seen.append(k) or k == 2).run(b)
    assert seen == [0, 1, 2]


def test_steps():
    s = solvers.Steps(1.0, 1.0)
    s.balance(1.0, 1.4)
    assert (s.sigma, s.tau, s.change) == (1.0, 1.0, 0.5)
    s.balance(2.0, 1.0)
    assert (s.sigma, s.tau, s.change) == (0.5, 2.0, 0.475)
    s.balance(1.0, 2.0)
    assert np.allclose((s.sigma * s.tau, s.sigma), (1.0, 0.5 / 0.525))


def descend(unit, members, p):
    """The tree, built on the way down."""
    while len(members) > 1:
        if len(members) == 2:
            sides = [members[:1], members[1:]]
        else:
            centre = unit[members].mean(axis=0)
            seed = min(members, key=lambda i: unit[i] @ centre)
            other = min(members, key=lambda i: unit[i] @ unit[seed])
            far = [i for i in members if unit[i] @ unit[seed] < unit[i] @ unit[other]]
            sides = [[i for i in members if i not in far], far]
        if not all(sides):
            break
        score = [abs(unit[m].mean(axis=0) @ p) for m in sides]
        members = sides[int(score[0] < score[1])]
    return members[0], unit[members].mean(axis=0) @ p


def rows(spark, m, key):
    return spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(m) for j, v in enumerate(r)], f"{key} int, x int, v double")


def test_dictionaries(spark, monkeypatch):
    rng = np.random.default_rng(2)
    atoms, points = rng.normal(size=(13, 5)), rng.normal(size=(40, 5))
    atoms[7] = atoms[3]
    unit = atoms / np.linalg.norm(atoms, axis=1, keepdims=True)
    d, p = rows(spark, atoms, "atom"), rows(spark, points, "k").unionByName(spark.createDataFrame([(99, 7, 1.0), (98, None, 1.0), (97, 1, None)], "k int, x int, v double"))
    got = {r.k: (r.atom, r.rho) for r in sense.dictionary_tree_match(p, d, "k", "atom", "x").collect()}
    assert sorted(got) == list(range(40))
    for k, q in enumerate(points):
        a, rho = descend(unit, list(range(13)), q)
        assert got[k][0] == a and np.isclose(got[k][1], rho)
    dots = points @ atoms.T
    want = {k: (int(np.argmax(np.round(abs(r), 9))), r[np.argmax(np.round(abs(r), 9))]) for k, r in enumerate(dots)}
    for most in (sense.DICTIONARY_VALUES, 1):
        monkeypatch.setattr(sense, "DICTIONARY_VALUES", most)
        best = {r.k: (r.atom, r.rho) for r in sense.dictionary_match(p, d, "k", "atom", "x").filter("rho is not null").collect()}
        assert {k: a for k, (a, _) in best.items()} == {k: a for k, (a, _) in want.items()}
        assert np.allclose([best[k][1] for k in want], [r for _, r in want.values()])
    with pytest.raises(ValueError):
        sense.dictionary_tree_match(p, d, "k", "atom", "x")
    none = d.limit(0)
    assert sense.dictionary_match(p, none, "k", "atom", "x").count() == sense.dictionary_tree_match(p, none, "k", "atom", "x").count() == 0


def test_transform_by_axes(spark):
    a = np.random.default_rng(3).normal(size=(4, 6, 2, 3))
    x = from_numpy(spark, a, ["i", "j", "k", "c"])
    assert fourier.FFT(x.shape, ["i", "j", "k"]).passes() == [["i", "j", "k"]]
    whole = fourier.FFT(x.shape, ["i", "j", "k"]).forward(x).to_numpy()
    for most in (1, 12, 24):
        f = fourier.FFT(x.shape, ["i", "j", "k"], most=most)
        assert len(f.passes()) == {1: 3, 12: 2, 24: 2}[most]
        assert np.allclose(f.forward(x).to_numpy(), whole) and np.allclose(f.adjoint(f.forward(x)).to_numpy(), a)


def test_ranks(spark):
    v = [3.0, 1.0, 1.0, 7.0, 2.0, 2.0, 2.0, 9.0, -4.0, float("nan")]
    t = spark.createDataFrame([(x,) for x in [*v, None]], "v double")
    order = sorted(v, key=lambda x: (x != x, x))
    for rule, at in (("image", lambda p: int(p * 9)), ("data", lambda p: min(9, int(p * 10)))):
        got = {r.p: r.v for r in stats.nearest_rank(t, [0.0, 0.3, 0.31, 0.5, 0.9, 1.0], rule=rule).collect()}
        assert {p: repr(x) for p, x in got.items()} == {p: repr(order[at(p)]) for p in (0.0, 0.3, 0.31, 0.5, 0.9, 1.0)}
    assert stats.nearest_rank(t.limit(0), [0.5]).count() == 0


def test_gram_of_gaps_and_repeats(spark):
    a = np.random.default_rng(4).normal(size=(3, 5)) + 1j * np.random.default_rng(5).normal(size=(3, 5))
    a[1, 2] = 0
    df = from_numpy(spark, a, ["c", "k"]).df.filter("re <> 0 or im <> 0")
    got = np.zeros((3, 3), complex)
    for r in stats.gram(Tensor(df, {"c": 3, "k": 5}), "c").collect():
        got[r.a, r.b] = complex(r.re, r.im)
    assert np.allclose(got, a.conj() @ a.T / 2)
    twice = spark.createDataFrame([(0, 0, 1.0, 2.0), (0, 0, 3.0, -1.0)], "c int, k int, re double, im double")
    row = stats.gram(Tensor(twice, {"c": 2, "k": 1}), "c").first()
    both = (1 + 2j) + (3 - 1j)
    assert (row.a, row.b) == (0, 0) and np.isclose(row.re, abs(both) ** 2) and np.isclose(row.im, 0)
