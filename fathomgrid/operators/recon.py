"""Reconstruction: preconditioner, encoding operator, least-squares and regularised solves, calibration, resampling, point spread."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import mul_to_even, tukey
from ..tensor import Tensor, grid
from . import differences, fourier, prox, sense, shape, stats
from .linop import Diagonal, Extract, Identity, LinOp, Shape, Subtract, VStack, _stack_shape, compose
from .solvers import ADMM, LSMR, PDHG, Regulariser


def _ones(spark: SparkSession, s: Shape) -> Tensor:
    return Tensor(grid(spark, s).select("*", F.lit(1.0).alias("re"), F.lit(0.0).alias("im")), s)


def preconditioner(points: DataFrame, axes: dict[str, str], matrix: int, samples: Shape, osamp: float = 2.0, width: int = 4, lam: float = 0.0) -> Tensor:
    """Weights of the samples: the point spread on a doubled trajectory times the field of view's autocorrelation, taken back
    to the samples, regularised and inverted (zero weights: 1)."""
    spark = points.sparkSession
    dims, n = list(axes.values()), len(axes)
    twice = points.select(*samples, *((F.col(p) * 2).alias(p) for p in axes))
    big = mul_to_even(matrix, 2)
    a = fourier.nufft(twice, axes, big, samples, osamp, width)
    psf = a.adjoint(_ones(spark, samples))
    f = fourier.FFT({d: big for d in dims}, dims)
    box = f.forward(shape.Pad({d: matrix for d in dims}, {d: big for d in dims}).forward(_ones(spark, {d: matrix for d in dims})))
    auto = f.adjoint(box.with_values(F.col("re") * F.col("re") + F.col("im") * F.col("im"), F.lit(0.0)))
    both = Diagonal(psf.shape, auto).forward(psf)
    scale = big ** (1.5 * n) / matrix**n / matrix**n
    w = a.forward(both)
    v = (F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) * scale + lam) / (1 + lam)
    return w.with_values(F.when(v == 0, 1.0).otherwise(1 / v), F.lit(0.0))


def preconditioner_multi(points: DataFrame, axes: dict[str, str], matrix: int, samples: Shape, maps: Tensor, osamp: float = 2.0, width: int = 4, lam: float = 0.0) -> Tensor:
    """Weights of the samples of every channel: as preconditioner(), with the channels' maps in place of the field of view.

    A channel's autocorrelation is the sum over all channels of the squared spectrum of the product of their maps: a self-join
    over channels, one transform for all pairs.
    """
    dims, n = list(axes.values()), len(axes)
    channels = maps.shape["channel"]
    twice = points.select(*samples, *((F.col(p) * 2).alias(p) for p in axes))
    big = mul_to_even(matrix, 2)
    a = fourier.nufft(twice, axes, big, samples, osamp, width)
    psf = a.adjoint(_ones(points.sparkSession, samples))
    other = maps.df.select(*dims, F.col("channel").alias("other"), F.col("re").alias("r2"), F.col("im").alias("i2"))
    re, im = F.col("re") * F.col("r2") + F.col("im") * F.col("i2"), F.col("im") * F.col("r2") - F.col("re") * F.col("i2")
    small = {**{d: matrix for d in dims}, "channel": channels, "other": channels}
    pair = Tensor(maps.df.join(other, dims).select(*small, re.alias("re"), im.alias("im")), small)
    large = {**small, **{d: big for d in dims}}
    k = fourier.FFT(large, dims).forward(shape.Pad(small, large).forward(pair))
    power = k.df.groupBy(*dims, "channel").agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("re")).withColumn("im", F.lit(0.0))
    each = {**{d: big for d in dims}, "channel": channels}
    auto = fourier.FFT(each, dims).adjoint(Tensor(power.select(*each, "re", "im"), each))
    both = Diagonal(each, psf).forward(auto)
    w = fourier.nufft(twice, axes, big, samples, osamp, width, {"channel": channels}).forward(both)
    scale = big ** (1.5 * n) / matrix**n
    v = (F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) * scale + lam) / (1 + lam)
    return w.with_values(F.when(v == 0, 1.0).otherwise(1 / v), F.lit(0.0))


def make_preconditioner(kind: str, points: DataFrame, axes: dict[str, str], matrix: int, samples: Shape, maps: Tensor | None = None, lam: float = 0.0, **how) -> Tensor | None:
    """none, single, multi (needs maps), or the path of stored weights, whose shape must be the samples' (with a channel or without)."""
    if kind == "none":
        return None
    if kind == "single":
        return preconditioner(points, axes, matrix, samples, lam=lam, **how)
    if kind == "multi":
        if maps is None:
            raise ValueError("the preconditioner for several channels needs their maps")
        return preconditioner_multi(points, axes, matrix, samples, maps, lam=lam, **how)
    from ..sources.store import read_weights

    return read_weights(points.sparkSession, kind, samples)


def low_resolution_channels(points: DataFrame, axes: dict[str, str], matrix: int, samples: Shape, data: Tensor, limit: float, iterations: int = 4, osamp: float = 1.3, width: int = 4) -> Tensor:
    """An image of each channel from the samples within `limit` of the centre, faded out towards it, by preconditioned least squares."""
    near = sense.downsampled(points, list(axes), [limit] * len(axes))
    r = F.sqrt(sum(F.col(p) * F.col(p) for p in axes))
    w = near.select(*samples, tukey(r, limit / 2, limit, 0.0).alias("_f"))
    faded = data.df.join(w, list(samples)).withColumns({"re": F.col("re") * F.col("_f"), "im": F.col("im") * F.col("_f")}).drop("_f")
    own = near.filter(~F.isnan(next(iter(axes)))).select(*samples, *axes)
    a = fourier.nufft(own, axes, matrix, samples, osamp, width, {"channel": data.shape["channel"]})
    m = preconditioner(own, axes, matrix, samples)
    return recon_lsq(a, Tensor(faded.select(*data.dims, "re", "im"), data.shape), m, iterations)


def choose_kernels(how: str, points: DataFrame, axes: dict[str, str], matrix: int, samples: Shape, data: Tensor, limit: float, width: int = 6, **more) -> Tensor:
    """Sensitivity kernels: auto calibrates from the data, any other value is the path of stored ones, whose channels must be the data's."""
    if data.shape.get("channel", 1) < 2:
        raise ValueError("the data have a single channel")
    if how != "auto":
        from ..sources.store import read_tensor

        kernels = read_tensor(data.spark, how)
        if kernels.shape["channel"] != data.shape["channel"]:
            raise ValueError(f"kernels have {kernels.shape['channel']} channels, data {data.shape['channel']}")
        return kernels
    channels = low_resolution_channels(points, axes, matrix, samples, data, limit).cut()
    s = stats.rss(channels, "channel").select(*axes.values(), F.col("v").alias("re"), F.lit(0.0).alias("im"))
    return estimate_kernels(channels, Tensor(s, {d: matrix for d in axes.values()}), list(axes.values()), width, **more)


def nufft_lowmem(points: DataFrame, axes: dict[str, str], matrix: int, samples: Shape, kernels: Tensor, osamp: float = 2.0, width: int = 4) -> LinOp:
    """Image to samples of every channel, the maps inflated from small kernels when they are used: only the kernels are kept."""
    dims = list(axes.values())
    maps = kernels_to_maps(kernels, dims, matrix)
    return compose(fourier.nufft(points, axes, matrix, samples, osamp, width, {"channel": kernels.shape["channel"]}), sense.Sense(maps))


def oversampled(x: Tensor, dims: list[str]) -> Tensor:
    """The image at twice the size in each of dims, by its spectrum, with values as they were."""
    return resample(x, {d: 2 * x.shape[d] for d in dims})


def encoding(points: DataFrame, axes: dict[str, str], matrix: int, samples: Shape, maps: Tensor | None = None, osamp: float = 1.3, width: int = 4, along: Shape | None = None) -> LinOp:
    """Image to samples: NUFFT, after the coils' sensitivities if there are any. Slabs and times run along."""
    along = dict(along or {})
    if maps is None:
        return fourier.nufft(points, axes, matrix, samples, osamp, width, along)
    channels = maps.shape["channel"]
    s = sense.Sense(maps, along=along)
    n = fourier.nufft(points, axes, matrix, samples, osamp, width, {**along, "channel": channels})
    return compose(n, s)


def recon_lsq(a: LinOp, data: Tensor, m: Tensor | None = None, iterations: int = 4, damp: float = 0.0, hook: Callable | None = None) -> Tensor:
    """Preconditioned least squares."""
    weights = None if m is None else Diagonal(a.oshape, m)
    return LSMR(a, weights, iterations, damp=damp, hook=hook).run(data)


def residual(a: LinOp, x: Tensor, data: Tensor) -> Tensor:
    return shape.difference(a.forward(x), data)


def recon_rss(a: LinOp, data: Tensor, m: Tensor | None = None, iterations: int = 4) -> DataFrame:
    """Channel by channel, then the root of the sum of squares over channels."""
    return stats.rss(recon_lsq(a, data, m, iterations), "channel")


def recon_rss_normal(normal: LinOp, image: Tensor, norm: float, iterations: int = 4) -> DataFrame:
    """As recon_rss, from A^H A, A^H of the data and the data's norm."""
    return stats.rss(LSMR(normal, None, iterations).run_normal(image, norm), "channel")


#: The share of the gradient in tv2; the Laplacian has the rest.
TV2_SHARE = 0.77


def _grouped(lam: float, iso: str) -> prox.Prox:
    """L1, or L2 over the dimensions that iso names (of b, t, g)."""
    if set(iso) - set("btg"):
        raise ValueError(f"isotropic dimensions {iso} are not of b, t, g")
    return prox.L2(lam, list(iso)) if iso else prox.L1(lam)


def tgv(spark: SparkSession, image: Shape, dims: list[str], lam: float, iso: str = "") -> tuple[list[Regulariser], LinOp]:
    """Total generalised variation: regularisers over the stacked unknowns (image, vector field v), and the operator that extracts the image.

    The first penalises the gradient of the image less v, the second the symmetrised gradient of v.
    """
    first = differences.gradient(spark, image, dims)
    second = differences.gradient_of_vector(spark, first.oshape, dims)
    stacked = _stack_shape([image, first.oshape])
    x, v = Extract(stacked, 0, dict(image)), Extract(stacked, 1, first.oshape)
    return [Regulariser(_grouped(lam, iso), Subtract(compose(first, x), v)), Regulariser(_grouped(lam, iso), compose(second, v))], x


def regularisers(spark: SparkSession, image: Shape, dims: list[str], iso: str | int = "", **flags: float) -> list[Regulariser]:
    """By flag: tv, tv2 (gradient and isotropic Laplacian, by shares), tvt (along t), wavelets (width 6), l1, l1i, llr (along b).

    iso: the dimensions (of b, t and, for the gradient, g) whose components tv, tv2 and l1 shrink together; 1 means g. For TGV see tgv.
    """
    iso = "g" if iso == 1 else iso or ""
    out = []
    for name, lam in flags.items():
        if name == "tv":
            out.append(Regulariser(_grouped(lam, iso), differences.gradient(spark, image, dims)))
        elif name == "tv2":
            both = [differences.gradient(spark, image, dims), differences.isotropic_laplacian(spark, image, dims)]
            joint = iso.replace("g", "")  # the Laplacian has no components
            parts = [_grouped(lam * TV2_SHARE, joint), _grouped(lam * (1 - TV2_SHARE), joint)]
            out.append(Regulariser(prox.Stack(parts, [op.oshape for op in both]), VStack(both)))
        elif name == "tvt":
            out.append(Regulariser(prox.L1(lam), differences.gradient(spark, image, ["t"])))
        elif name == "wavelets":
            out.append(Regulariser(prox.L1(lam), differences.wavelets(spark, image, dims, 6)))
        elif name == "llr":
            out.append(Regulariser(prox.LocallyLowRank(lam, dims, "b", 5)))
        elif name in ("l1", "l1i"):
            out.append(Regulariser(_grouped(lam, iso.replace("g", "")) if name == "l1" else prox.L1I(lam)))
        else:
            raise ValueError(f"no regulariser {name}")
    return out


def scale_of(x: Tensor, how: str | float) -> float:
    """none, bart, otsu, or a number."""
    if how == "none":
        return 1.0
    if how in ("bart", "otsu"):
        v = shape.component(x, "mag")
        return float((stats.scale_bart(v) if how == "bart" else stats.scale_otsu(v)).first()[0])
    return float(how)


def recon_rlsq(a: LinOp, data: Tensor, regs: list[Regulariser], scale: str | float = "none", algorithm: str = "admm", **how) -> Tensor:
    """Regularised least squares; the data are scaled first and the image back after."""
    s = 1.0 if scale == "none" else scale_of(LSMR(a, iterations=2).run(data) if scale in ("bart", "otsu") else data, scale)
    solver = ADMM(a, regs, **how) if algorithm == "admm" else PDHG(a, regs, **how)
    return solver.run(data.scaled(s)).scaled(1 / s)


def denoise(x: Tensor, regs: list[Regulariser], iterations: int = 32) -> Tensor:
    """A single regulariser without a transform is one proximal step; others are solved against the identity."""
    if len(regs) == 1 and regs[0].t is None:
        return regs[0].prox.apply(1.0, x)
    return PDHG(Identity(x.shape), regs, iterations).run(x)


def point_spread(spark: SparkSession, a: LinOp, centre: dict[str, int], m: Tensor | None = None, iterations: int = 4) -> Tensor:
    """The least-squares response to a unit impulse, with a preconditioner or without."""
    one = spark.createDataFrame([(*centre.values(), 1.0, 0.0)], ", ".join([*(f"{d} int" for d in centre), "re double", "im double"]))
    return recon_lsq(a, a.forward(Tensor(one, a.ishape)), m, iterations)


def resample(x: Tensor, sizes: dict[str, int]) -> Tensor:
    """Fourier interpolation to other even sizes."""
    dims = list(sizes)
    k = fourier.FFT(x.shape, dims).forward(x)
    new = {**x.shape, **sizes}
    grow = all(sizes[d] >= x.shape[d] for d in dims)
    if grow:
        k = shape.Pad(x.shape, new).forward(k)
    elif all(sizes[d] <= x.shape[d] for d in dims):
        k = shape.Crop(x.shape, new).forward(k)
    else:
        raise ValueError("sizes must all grow or all shrink")
    ratio = math.prod(sizes[d] / x.shape[d] for d in dims)
    return fourier.FFT(new, dims).adjoint(k).scaled(math.sqrt(ratio))


def kernels_to_maps(kernels: Tensor, dims: list[str], matrix: int, osamp: float = 1.3, normalise: bool = False) -> Tensor:
    """Small k-space kernels inflated to maps."""
    big = {**kernels.shape, **{d: mul_to_even(matrix, osamp) for d in dims}}
    scale = math.sqrt(math.prod(big[d] / kernels.shape[d] for d in dims))
    x = fourier.FFT(big, dims).adjoint(shape.Pad(kernels.shape, big).forward(kernels))
    maps = shape.Crop(big, {**big, **{d: matrix for d in dims}}).forward(x).scaled(scale)
    return sense.normalised(maps) if normalise else maps


def maps_to_kernels(maps: Tensor, dims: list[str], width: int, osamp: float = 1.3) -> Tensor:
    big = {**maps.shape, **{d: mul_to_even(maps.shape[d], osamp) for d in dims}}
    scale = math.sqrt(math.prod(big[d] / width for d in dims))
    k = fourier.FFT(big, dims).forward(shape.Pad(maps.shape, big).forward(maps))
    return shape.Crop(big, {**big, **{d: width for d in dims}}).forward(k).scaled(1 / scale)


def estimate_kernels(channels: Tensor, reference: Tensor, dims: list[str], width: int = 6, osamp: float = 1.3, lam: float = 1e-4, power: int = 4, iterations: int = 16) -> Tensor:
    """Kernels k whose maps times the reference image give the channel images, with Sobolev weights (1 + |k|^2)^(power / 2) against roughness."""
    from .linop import _tagged

    spark, matrix = channels.spark, channels.shape[dims[0]]
    ks = {**channels.shape, **{d: width for d in dims}}
    big = {**channels.shape, **{d: mul_to_even(matrix, osamp) for d in dims}}
    scale = math.sqrt(math.prod(big[d] / width for d in dims))
    inflate: LinOp = compose(fourier.FFT(big, dims).H, shape.Pad(ks, big))
    inflate = compose(shape.Crop(big, channels.shape), inflate)
    image = compose(Diagonal(channels.shape, reference.scaled(scale)), inflate)
    r2 = sum((F.col(d) - width // 2) * (F.col(d) - width // 2) for d in dims)
    w = Tensor(grid(spark, {d: width for d in dims}).select(*dims, (F.pow(1.0 + r2, power // 2) * lam).alias("re"), F.lit(0.0).alias("im")), {d: width for d in dims})
    rough = Diagonal(ks, w)
    stack = VStack([image, rough])
    right = _tagged([channels, shape.zeros(spark, ks)])
    return LSMR(stack, iterations=iterations, atol=1e-4).run(right)


def time_windows(spark: SparkSession, segments: int, acquired: int) -> DataFrame:
    """(b, sample, v): overlapping squared-sine windows over the samples, one for each segment."""
    if segments < 2:
        raise ValueError("more than one segment is needed")
    n = 2 * acquired // (segments - 1)
    g = grid(spark, {"b": segments, "t": n})
    at = (F.col("b") * n / 2).cast("int") - n // 2 + F.col("t")
    v = F.pow(F.sin(F.col("t") * (math.pi / n)), 2)
    return g.select("b", at.cast("int").alias("sample"), v.alias("v")).filter((F.col("sample") >= 0) & (F.col("sample") < acquired))


def spline(lines: DataFrame, key: str, x: str, y: str, at: list[float], order: int = 3, clamp: bool = False) -> DataFrame:
    """(key, at, v): a polynomial spline through each key's points (natural cubic for order 3, linear for 1), at the given places."""
    kind = lines.schema[key].dataType.simpleString()
    if order not in (1, 3):
        raise ValueError("order is 1 or 3")

    def run(p):
        import pandas as pd

        p = p.sort_values(x)
        px, py = p[x].to_numpy(float), p[y].to_numpy(float)
        q = np.clip(at, px[0], px[-1]) if clamp else np.array(at, float)
        n = len(px)
        if n == 1:
            v = np.full(len(q), py[0])
        elif order == 1 or n == 2:
            i = np.clip(np.searchsorted(px, q) - 1, 0, n - 2)
            v = py[i] + (py[i + 1] - py[i]) * (q - px[i]) / (px[i + 1] - px[i])
        else:
            h = np.diff(px)
            a = np.zeros((n, n))
            a[0, 0] = a[-1, -1] = 1
            for k in range(1, n - 1):
                a[k, k - 1 : k + 2] = h[k - 1], 2 * (h[k - 1] + h[k]), h[k]
            b = np.zeros(n)
            b[1:-1] = 6 * (np.diff(py)[1:] / h[1:] - np.diff(py)[:-1] / h[:-1])
            s = np.linalg.solve(a, b)
            i = np.clip(np.searchsorted(px, q) - 1, 0, n - 2)
            u, w = px[i + 1] - q, q - px[i]
            v = (s[i] * u**3 + s[i + 1] * w**3) / (6 * h[i]) + (py[i] / h[i] - s[i] * h[i] / 6) * u + (py[i + 1] / h[i] - s[i + 1] * h[i] / 6) * w
        return pd.DataFrame({key: p[key].iloc[0], "at": np.array(at, float), "v": v})

    return lines.select(key, x, y).groupBy(key).applyInPandas(run, f"{key} {kind}, at double, v double")


def moved(data: DataFrame, axes: list[str], rotation: np.ndarray, delta: dict[str, float]) -> DataFrame:
    """Rotated coordinates (rotation^T p), then the phase ramp of the shift."""
    r = np.asarray(rotation)
    turned = {a: sum(F.col(b) * float(r[j, i]) for j, b in enumerate(axes)) for i, a in enumerate(axes)}
    return sense.shifted(data.withColumns(turned), delta)


def move_by_navigator(data: DataFrame, navigators: DataFrame, axes: list[str], spacing: int, trace: str = "trace") -> DataFrame:
    """Each trace moved by its navigator's rotation and shift (nav, r00.. row by row, d0..): an equi-join on the trace's block."""
    n = len(axes)
    j = data.withColumn("nav", F.floor(F.col(trace) / spacing).cast("int")).join(F.broadcast(navigators), "nav")
    turned = {a: sum(F.col(b) * F.col(f"r{k}{i}") for k, b in enumerate(axes)) for i, a in enumerate(axes)}
    j = j.withColumns(turned)
    a = sum(F.col(p) * F.col(f"d{i}") for i, p in enumerate(axes)) * (2 * math.pi)
    re, im = F.col("re") * F.cos(a) - F.col("im") * F.sin(a), F.col("re") * F.sin(a) + F.col("im") * F.cos(a)
    return j.withColumns({"re": re, "im": im}).select(*data.columns) if n else data


def autofocus(series: Tensor, dim: str) -> DataFrame:
    """For each cell the index of dim whose imaginary part is smallest."""
    keys = [d for d in series.dims if d != dim]
    return series.df.groupBy(*keys).agg(F.min_by(dim, F.struct(F.abs("im"), dim)).alias(dim))


def equalised(vectors: np.ndarray, singular: np.ndarray, n: int) -> np.ndarray:
    """The first n singular vectors (rows) turned in planes until their variances are equal."""
    v, r = singular[:n].astype(float) ** 2, np.eye(n)
    mean = v.mean()
    for _ in range(n - 1):
        hi, lo = int(v.argmax()), int(v.argmin())
        if v[hi] == v[lo]:
            break
        w = (mean - v[lo]) / (v[hi] - v[lo])
        c, s = math.sqrt(w), math.sqrt(1 - w)
        r[:, [hi, lo]] = r[:, [hi, lo]] @ np.array([[c, s], [-s, c]])
        v[lo], v[hi] = v[hi] + v[lo] - mean, mean
    return r.T @ vectors[:n]
