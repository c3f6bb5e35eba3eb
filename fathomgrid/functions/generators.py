"""Phantoms, trajectories, bases, coil maps and signal simulators as relations made from ranges."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tensor import Tensor, grid


def _positions(spark: SparkSession, m: int, voxel: float) -> DataFrame:
    g = grid(spark, {"i": m, "j": m, "k": m})
    return g.withColumns({p: (F.col(d) - m // 2) * F.lit(float(voxel)) for p, d in (("px", "i"), ("py", "j"), ("pz", "k"))})


def sphere(spark: SparkSession, m: int, voxel: float, radius: float, intensity: float = 1.0, hemi: bool = False) -> DataFrame:
    p = _positions(spark, m, voxel)
    inside = F.col("px") * F.col("px") + F.col("py") * F.col("py") + F.col("pz") * F.col("pz") < radius * radius
    if hemi:
        inside = inside & (F.col("k") < m // 2)
    return p.select("i", "j", "k", F.when(inside, float(intensity)).otherwise(0.0).alias("v"))


def gradient_cubes(spark: SparkSession, m: int, voxel: float, half: float) -> DataFrame:
    """Three nested cubes with ramps along x, y and z, innermost first."""
    p = _positions(spark, m, voxel)
    r = [F.col(c) / half for c in ("px", "py", "pz")]
    within = lambda n: (F.greatest(*(F.abs(x) for x in r)) * 3 <= n + 1e-9)
    v = F.when(within(1), r[0] * 3 + 2).when(within(2), r[1] * 1.5 + 2).when(within(3), r[2] + 2).otherwise(0.0)
    return p.select("i", "j", "k", v.alias("v"))


# Centre, half-axes, angle over pi, and intensity of each ellipsoid of the Shepp-Logan phantom.
ELLIPSOIDS = (
    (0, 0, 0, 0.69, 0.92, 0.9, 0, 100),
    (0, 0, 0, 0.6624, 0.874, 0.88, 0, -40),
    (-0.22, 0, -0.25, 0.41, 0.16, 0.21, 0.6, -10),
    (0.22, 0, -0.25, 0.31, 0.11, 0.22, 0.4, -10),
    (0, 0.35, -0.25, 0.21, 0.25, 0.5, 0, 10),
    (0, 0.1, -0.25, 0.046, 0.046, 0.046, 0, 10),
    (-0.08, -0.65, -0.25, 0.046, 0.023, 0.02, 0, 5),
    (0.06, -0.65, -0.25, 0.046, 0.023, 0.02, 0.5, 5),
    (0.06, -0.105, 0.625, 0.056, 0.04, 0.1, 0.5, 10),
    (0, 0.1, 0.625, 0.056, 0.056, 0.1, 0, -10),
)


def shepp_logan(spark: SparkSession, m: int, voxel: float, radius: float) -> DataFrame:
    p = _positions(spark, m, voxel)
    r = [F.col(c) / radius for c in ("px", "py", "pz")]
    total = F.lit(0.0)
    for cx, cy, cz, a, b, c, angle, value in ELLIPSOIDS:
        x, y, z = r[0] - cx, r[1] - cy, r[2] - cz
        co, si = math.cos(angle * math.pi), math.sin(angle * math.pi)
        u, v, w = (x * co + y * si) / a, (y * co - x * si) / b, z / c
        total = total + F.when(u * u + v * v + w * w < 1, float(value)).otherwise(0.0)
    return p.select("i", "j", "k", total.alias("v"))


def cartesian(spark: SparkSession, m: int) -> DataFrame:
    """M * M traces of M samples."""
    g = grid(spark, {"sample": m, "trace": m * m})
    return g.select("sample", "trace", (F.col("sample") - m // 2).cast("double").alias("kx"), (F.col("trace") % m - m // 2).cast("double").alias("ky"), (F.floor(F.col("trace") / m) - m // 2).cast("double").alias("kz"))


def _spokes(ends: DataFrame, matrix: int, osamp: float) -> DataFrame:
    """Samples along the direction (phi, theta) of each trace, from 0 to the nominal edge."""
    n = int(osamp * matrix / 2)
    s = ends.sparkSession.range(n).select(F.col("id").cast("int").alias("sample"))
    r = F.col("sample") / n * (matrix / 2)
    return ends.crossJoin(F.broadcast(s)).select("sample", "trace", (r * F.cos("theta") * F.cos("phi")).alias("kx"), (r * F.cos("theta") * F.sin("phi")).alias("ky"), (r * F.sin("theta")).alias("kz"))


def archimedean(spark: SparkSession, matrix: int, osamp: float, spokes: int) -> DataFrame:
    """Spiral spokes over the sphere: the angle is a running sum over the latitude steps."""
    half = spokes // 2
    z = F.col("is") / half
    s2 = 1 - z * z
    step = F.lit(0.5 / half) * F.sqrt((1 / s2) * (spokes * 4 * math.pi - 1 / s2))
    w = Window.orderBy("is").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = spark.range(1, half).select(F.col("id").alias("is")).withColumn("phi", F.sum(step).over(w)).withColumn("theta", F.asin(z))
    north = e.select((half - F.col("is")).cast("int").alias("trace"), "phi", "theta")
    south = e.select((half + F.col("is")).cast("int").alias("trace"), (-F.col("phi")).alias("phi"), (-F.col("theta")).alias("theta"))
    poles = spark.createDataFrame([(0, 0.0, math.pi / 2), (half, 0.0, 0.0)], "trace int, phi double, theta double")
    return _spokes(north.unionByName(south).unionByName(poles), matrix, osamp)


def phyllotaxis(spark: SparkSession, matrix: int, osamp: float, traces: int, smoothness: int, per_interleave: int) -> DataFrame:
    if traces % per_interleave:
        raise ValueError("interleaves do not divide the traces")
    n, gold = traces // per_interleave, math.pi * (3 - math.sqrt(5))
    a, b = 0, 1
    for _ in range(smoothness):
        a, b = b, a + b
    t = spark.range(traces).select(F.col("id").cast("int").alias("trace"), F.floor(F.col("id") / per_interleave).alias("ii"), (F.col("id") % per_interleave).alias("is"))
    z = 1 - 2.0 * n * F.col("is") / (traces - 1) - F.col("ii") * 2.0 / (traces - 1)
    e = t.select("trace", (F.col("is") * gold * a + F.col("ii") * gold).alias("phi"), F.asin(F.greatest(F.least(z, F.lit(1.0)), F.lit(-1.0))).alias("theta"))
    return _spokes(e, matrix, osamp)


def bernstein(spark: SparkSession, order: int, traces: int) -> DataFrame:
    """(b, trace, v): Bernstein polynomials over 0 to 1."""
    g = grid(spark, {"b": order + 1, "trace": traces})
    x = F.col("trace") / (traces - 1)
    choose = F.element_at(F.array(*(F.lit(float(math.comb(order, k))) for k in range(order + 1))), F.col("b") + 1)
    return g.select("b", "trace", (choose * F.pow(x, F.col("b")) * F.pow(1 - x, order - F.col("b"))).alias("v"))


def echoes(spark: SparkSession, samples: int, count: int, gap: int = 0, keep: int | None = None) -> DataFrame:
    """(b, sample, v): each kept sample belongs to one echo, with weight sqrt(count)."""
    keep = keep or samples
    if gap < 0 or gap + keep > samples:
        raise ValueError("gap and samples to keep exceed the samples")
    s = spark.range(keep)
    return s.select(F.floor((F.col("id") + gap) / (samples // count)).cast("int").alias("b"), F.col("id").cast("int").alias("sample"), F.lit(math.sqrt(count)).alias("v"))


def frames(spark: SparkSession, per_frame: int, count: int, increment: int = 1, start: int = 0, interleave: bool = False, retain: int | None = None) -> DataFrame:
    """(b, trace, v): traces of each frame; increment frames are skipped after each block."""
    g = grid(spark, {"b": count, "t": per_frame})
    if interleave:
        trace = F.col("t") * (count + increment * per_frame) + F.col("b")
    else:
        trace = F.col("b") * (per_frame + increment * per_frame) + F.col("t")
    return g.filter(F.col("b") < (retain or count)).select("b", (trace + start * per_frame).cast("int").alias("trace"), F.lit(1.0).alias("v"))


def decay_table(spark: SparkSession, rows: int, echo: int, spacing: float, low: float, high: float) -> DataFrame:
    """(row, echo, v): exp(-t / T2) over a grid of T2."""
    g = grid(spark, {"row": rows, "echo": echo})
    return g.select("row", "echo", F.exp(-F.col("echo") * spacing / (low + F.col("row") * (high - low) / (rows - 1))).alias("v"))


def fourier_basis(n: int, points: int, osamp: int = 1) -> np.ndarray:
    """n harmonics over points, as rows."""
    big, left = osamp * points, lambda b, s: (b - s + 1) // 2
    eye = np.diag(np.exp(1j * np.pi * (np.arange(n) - n // 2)))
    padded = np.zeros((n, big), complex)
    padded[:, left(big, n) : left(big, n) + n] = eye
    f = np.fft.fftshift(np.fft.ifft(np.fft.ifftshift(padded, 1), axis=1, norm="ortho"), 1)
    return f[:, left(big, points) : left(big, points) + points]


def basis_scale(samples: int, traces: int, vectors: int) -> float:
    """The square root of the whole part of samples * traces / vectors."""
    return math.sqrt(samples * traces // vectors)


def birdcage(spark: SparkSession, m: int, voxel: float, channels: int, rings: int, coil_mm: float, sense_mm: float) -> Tensor:
    """Analytic coil maps: magnitude by distance, phase by direction and channel."""
    if channels < 1:
        raise ValueError("at least one channel")
    per = max(channels // rings, 1)
    p = _positions(spark, m, voxel).crossJoin(F.broadcast(spark.range(per * rings).select(F.col("id").cast("int").alias("channel"))))
    ring, at = F.floor(F.col("channel") / per), F.col("channel") % per
    theta = at * (2 * math.pi / per)
    cz = voxel * m * 2.0 * (-0.5 + (ring + 1.0) / (rings + 1.0))
    dx, dy, dz = F.col("px") - coil_mm * F.cos(theta), F.col("py") - coil_mm * F.sin(theta), F.col("pz") - cz
    d = F.sqrt(dx * dx + dy * dy + dz * dz)
    r = F.when(d < voxel * math.sqrt(3) / 2, 0.0).otherwise(sense_mm / d)
    angle = F.atan2(dx, dy) - F.col("channel") * (2 * math.pi / channels)
    if channels == 1:
        r, angle = F.lit(1.0), F.lit(0.0)
    return Tensor(p.select("i", "j", "k", "channel", (r * F.cos(angle)).alias("re"), (r * F.sin(angle)).alias("im")), {"i": m, "j": m, "k": m, "channel": per * rings})


def noisify(t: Tensor, sigma: float, seed: int = 0) -> Tensor:
    """Adds complex normal noise, the same for the same seed and rows: drawn from a hash of the cell, not of the partition."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *t.dims))
    u = lambda at: (F.conv(F.substring(h, at, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    r, a = sigma * F.sqrt(-2 * F.log(u(1))), 2 * math.pi * u(13)
    return t.with_values(F.col("re") + r * F.cos(a), F.col("im") + r * F.sin(a))


def steady_state(kind: str, p: dict) -> np.ndarray:
    """Longitudinal signals of the spokes of one cycle in the steady state, for one row of tissue parameters.

    kind: zte (M0, T1), ir (T1, Q, B1: inversion efficiency), t2prep (T1, T2, B1), dir and t2flair (two preparations).
    Sequence: alpha, TR, Tramp, Tssi, spoil, spokes, segments, Trec, TE.
    """
    r1, b1 = 1 / p["T1"], p.get("B1", 1.0)

    def relax(t):
        e = math.exp(-r1 * t)
        return np.array([[e, 1 - e], [0, 1]])

    tip = np.diag([math.cos(p["alpha"] * b1), 1.0])
    one, ramp, ssi = relax(p["TR"]), relax(p["Tramp"]), relax(p["Tssi"])
    power = np.linalg.matrix_power
    segment = ssi @ ramp @ power(one @ tip, p["spokes"]) @ power(one, p["spoil"]) @ ramp
    rec = relax(p.get("Trec", 0.0))
    flip = np.diag([-p.get("Q", 1.0), 1.0])
    t2 = np.diag([math.exp(-p.get("TE", 0.0) / p["T2"]), 1.0]) if "T2" in p else np.eye(2)
    prep = {"zte": np.eye(2), "ir": flip, "t2prep": t2, "dir": flip @ rec @ flip, "t2flair": rec @ flip @ t2}[kind]
    cycle = prep @ power(segment, p["segments"]) @ (rec if kind != "zte" else np.eye(2))
    mz = np.array([cycle[0, 1] / (1 - cycle[0, 0]), 1.0])
    out = []
    for _ in range(p["segments"]):
        mz = power(one, p["spoil"]) @ ramp @ mz
        for _ in range(p["spokes"]):
            out.append(mz[0] * math.sin(p["alpha"] * b1) * p.get("M0", 1.0))
            mz = one @ tip @ mz
        mz = ssi @ ramp @ mz
    return np.array(out)


def simulate(tissues: DataFrame, kind: str, sequence: dict, id: str = "id") -> DataFrame:
    """(id, trace, v) for each row of tissue parameters (columns T1, T2, M0, Q, B1 as there are): a map over rows."""
    names = [c for c in tissues.columns if c != id]

    def run(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                d = r._asdict()
                rows += [(d[id], k, v) for k, v in enumerate(steady_state(kind, sequence | {c: d[c] for c in names}))]
            yield pd.DataFrame(rows, columns=[id, "trace", "v"])

    return tissues.mapInPandas(run, f"{id} {tissues.schema[id].dataType.simpleString()}, trace int, v double")


def at_fraction(column: Column, low: Column, high: Column, m: int) -> Column:
    """A column's place between low and high as a coordinate in [-m / 2, m / 2)."""
    return (column - low) / (high - low) * m - m / 2
