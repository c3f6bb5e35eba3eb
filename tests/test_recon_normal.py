"""recon_rss_events from sums over all events: nothing of the events' size is written, and the steps are those of the plain solver."""

import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fathomgrid.operators import fourier
from fathomgrid.operators.solvers import LSMR
from fathomgrid.plans import catalogue
from fathomgrid.tensor import Tensor


def written(spark) -> int:
    at = spark.sparkContext.getCheckpointDir()
    return 0 if at is None else sum(os.path.getsize(os.path.join(p, f)) for p, _, names in os.walk(at.removeprefix("file:")) for f in names)


def test_nothing_of_the_events_size_is_written(spark, tmp_path):
    t = pq.read_table("/root/testdata/sf0.01/events.parquet").slice(0, 5000)
    pq.write_table(t, tmp_path / "events.parquet")
    before = written(spark)
    assert catalogue.QUERIES["recon_rss_events"](spark, str(tmp_path)).count() == 8
    # a residual of 5000 events in 8 channels has 16 bytes of values a row
    assert written(spark) - before < 5000 * 8 * 16


@pytest.mark.parametrize("steps", [2, 9])
def test_steps_are_those_of_the_plain_solver(spark, steps):
    rng = np.random.default_rng(steps)
    n = 60
    rows = [(i, i % 2, float(k), float(v)) for i, (k, v) in enumerate(zip(rng.uniform(-4, 4, n), rng.normal(size=n)))]
    p = spark.createDataFrame([*rows, (n, 1, float("nan"), 0.0)], "sample long, channel int, kx double, v double")
    values = p.select("sample", "channel", "kx", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    kx, v, channel = np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), np.array([r[1] for r in rows])
    a = np.exp(-2j * np.pi / 8 * np.outer(kx, np.arange(8) - 4)) / np.sqrt(8)
    normal = fourier.ndft_normal(p.select("kx"), {"kx": "x"}, 8, {"channel": 2})
    image = fourier.ndft_adjoint(values, {"kx": "x"}, 8, {"channel": 2}).cut()
    b = np.stack([np.where(channel == c, v, 0) for c in range(2)], 1)
    assert np.allclose(image.to_numpy(), a.conj().T @ b, atol=1e-12)
    w = normal.weights.toPandas()
    gram = np.zeros((8, 8), complex)
    gram[w.x, w.in_x] = w.wr + 1j * w.wi
    assert np.allclose(gram, a.conj().T @ a, atol=1e-12)
    got = LSMR(normal, iterations=steps).run_normal(image, float(np.linalg.norm(v))).to_numpy()
    if steps > 8:
        want = np.linalg.lstsq(a, b, rcond=None)[0]
        assert np.allclose(got, want, atol=1e-4)
    else:
        op = fourier.ndft(p.select("sample", "kx"), {"kx": "x"}, 8, {"sample": 0}, {"channel": 2})
        data = Tensor(values.select("sample", "channel", "re", "im"), {"sample": 0, "channel": 2})
        assert np.allclose(got, LSMR(op, iterations=steps).run(data).to_numpy(), atol=1e-9)
