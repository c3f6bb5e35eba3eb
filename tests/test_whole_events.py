"""Registered queries over a fixture of 2300 events, held against numpy over all of them."""

import numpy as np
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

from fathomgrid.plans import catalogue

N = 2300


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    d = tmp_path_factory.mktemp("events")
    t = pq.read_table("/root/testdata/sf0.01/events.parquet")
    t = t.filter(pc.less(t["event_id"], N))
    pq.write_table(t, d / "events.parquet")
    us = t["ts"].cast("timestamp[us]").cast("int64").to_numpy() - 1704067200000000
    kx = us / 2592000000000.0 * 32 - 16
    by = np.argsort(t["event_id"].to_numpy())
    return str(d), kx[by], t["value"].to_numpy()[by], (t["user_id"].to_numpy() % 8)[by]


def run(spark, name, d):
    return catalogue.QUERIES[name](spark, d).collect()


def image(rows):
    x = np.zeros(8, complex)
    for r in rows:
        x[r.x] = complex(r.re, r.im)
    return x


def ndft(kx, n=8):
    return np.exp(-2j * np.pi / n * np.outer(kx, np.arange(n) - n // 2)) / np.sqrt(n)


def differences(spark):
    g = catalogue.differences.gradient(spark, {"x": 8}, ["x"])
    columns = []
    for e in np.eye(8):
        rows = g.forward(catalogue.Tensor(spark.createDataFrame([(i, float(v), 0.0) for i, v in enumerate(e)], "x int, re double, im double"), {"x": 8})).df.collect()
        columns.append({r.x: r.re for r in rows})
    return np.array([[c.get(i, 0.0) for c in columns] for i in range(8)])


def krylov(a, b, steps):
    """The least residual of the normal equations over the Krylov space of so many steps: what LSMR gives."""
    h, g = a.conj().T @ a, a.conj().T @ b
    k = [g]
    for _ in range(steps - 1):
        k.append(h @ k[-1] / np.linalg.norm(h @ k[-1]))
    q = np.linalg.qr(np.stack(k, 1))[0]
    return q @ np.linalg.lstsq(h @ q, g, rcond=None)[0]


def test_nav_window_all(spark, events):
    d, _, v, _ = events
    got = {r.nav: (r.n, r["mean"]) for r in run(spark, "nav_window_all", d)}
    assert sorted(got) == list(range(46))
    for n, (count, mean) in got.items():
        own = v[max(n * 50 - 40, 0) : n * 50 + 40]
        assert count == len(own) and abs(mean - own.mean()) < 1e-5


def test_lsmr_recon(spark, events):
    d, kx, v, _ = events
    assert np.allclose(image(run(spark, "lsmr_recon", d)), krylov(ndft(kx), v, 4), atol=1e-5, rtol=1e-5)


def test_pdhg_tv(spark, events):
    d, kx, v, _ = events
    a, g = ndft(kx), differences(spark)
    step = 1 / np.sqrt(np.linalg.norm(a, 2) ** 2 + 4)
    x = bar = np.zeros(8, complex)
    y, w = np.zeros(N, complex), np.zeros(8, complex)
    for _ in range(3):
        y = (y + step * (a @ bar - v)) / (1 + step)
        w = w + step * g @ bar
        w = w / np.maximum(1, np.abs(w) / 5)
        new = x - step * (a.conj().T @ y + g.T @ w)
        x, bar = new, 2 * new - x
    assert np.allclose(image(run(spark, "pdhg_tv", d)), x, atol=1e-4, rtol=1e-4)


def test_admm_tv(spark, events):
    d, kx, v, _ = events
    a = np.vstack([ndft(kx), differences(spark)])
    assert np.allclose(image(run(spark, "admm_tv", d)), krylov(a, np.concatenate([v, np.zeros(8)]), 2), atol=1e-5, rtol=1e-5)


def test_recon_rss_events(spark, events):
    d, kx, v, channel = events
    a = np.kron(np.eye(8), ndft(kx))
    b = np.concatenate([np.where(channel == c, v, 0) for c in range(8)])
    x = krylov(a, b, 2).reshape(8, 8)
    got = {r.x: r.rss for r in run(spark, "recon_rss_events", d)}
    assert np.allclose([got[i] for i in range(8)], np.sqrt((np.abs(x) ** 2).sum(0)), atol=1e-5, rtol=1e-5)


def test_precon_events(spark, events):
    d, kx, _, _ = events
    a = ndft(2 * kx, 64)
    box = np.zeros(64)
    box[16:48] = 1
    f = np.fft.fft(np.fft.ifftshift(box), norm="ortho")
    auto = np.fft.fftshift(np.fft.ifft(np.abs(f) ** 2, norm="ortho"))
    w = a @ (auto * (a.conj().T @ np.ones(N)))
    want = 1 / (np.abs(w) * 64**1.5 / 32 / 32)
    got = {r.sample: r.w for r in run(spark, "precon_events", d)}
    # samples beyond the last cell of the oversampled grid have no weight
    inside = [i for i in range(N) if np.rint(4 * kx[i]) + 64 < 128]
    assert sorted(got) == inside
    assert np.allclose([got[i] for i in inside], want[inside], rtol=2e-2)
