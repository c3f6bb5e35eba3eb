"""Centred unitary Fourier transforms, gridding of non-uniform samples, NUFFT and the exact NDFT.

A transform along one axis is a weight relation (join and sum) for short axes, or numpy's FFT over packed lines for long
ones. Gridding is a spatial range join made an equi-join: each sample lists the cells under its kernel.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import full_width, kernel, kernel_norm, mul_to_even
from ..runtime import cut
from ..tensor import Tensor, grid
from .linop import Diagonal, LinOp, Shape, Sparse, compose, matmul
from .shape import Pad


def _even(n: int) -> None:
    if n > 1 and n % 2:
        raise ValueError(f"odd size {n}")


def dft_weights(spark: SparkSession, n: int, sign: float = -1.0) -> DataFrame:
    """exp(sign 2 pi i (i - n/2)(o - n/2) / n) / sqrt(n) as rows (o, i, wr, wi)."""
    _even(n)
    at = spark.range(n * n).select((F.col("id") % n).cast("int").alias("o"), F.floor(F.col("id") / n).cast("int").alias("i"))
    # the product of the indices modulo n keeps the angle small
    angle = F.pmod((F.col("i") - n // 2) * (F.col("o") - n // 2), F.lit(n)) * (sign * 2 * math.pi / n)
    return at.select("o", "i", (F.cos(angle) / math.sqrt(n)).alias("wr"), (F.sin(angle) / math.sqrt(n)).alias("wi"))


def dft(spark: SparkSession, shape: Shape, dim: str, sign: float = -1.0) -> Sparse:
    return matmul(dft_weights(spark, shape[dim], sign), shape[dim], shape[dim], dim, {d: n for d, n in shape.items() if d != dim})


class FFT(LinOp):
    """The same transform over packed lines, along one or more axes: a shuffle brings the cells of as many axes together as make at most most cells.

    The transform is separable, so a volume too large for a row goes a few axes, at least one, at a time.
    """

    def __init__(self, shape: Shape, dims: list[str], most: int = 1 << 20):
        for d in dims:
            _even(shape[d])
        self.ishape = self.oshape = dict(shape)
        self.over = dims
        self.most = most

    def passes(self) -> list[list[str]]:
        """The axes of each shuffle."""
        out: list[list[str]] = []
        for d in self.over:
            if out and math.prod(self.ishape[c] for c in out[-1]) * self.ishape[d] <= self.most:
                out[-1].append(d)
            else:
                out.append([d])
        return out

    def _run(self, x: Tensor, inverse: bool) -> Tensor:
        for over in self.passes():
            x = self._along(x, over, inverse)
        return x

    def _along(self, x: Tensor, over: list[str], inverse: bool) -> Tensor:
        sizes, dims = [self.ishape[d] for d in over], x.dims
        others = [d for d in dims if d not in over]
        cells = math.prod(sizes)
        index = np.indices(sizes).reshape(len(sizes), -1).astype(np.int32)
        axes = tuple(range(1, len(sizes) + 1))

        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, step := max(1, (1 << 18) // cells)):
                    part = b.slice(at, step)
                    n = part.num_rows
                    lists = part.column("_z")
                    line = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
                    k, re, im = (lists.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
                    a = np.zeros((n, cells), complex)
                    np.add.at(a, (line, k), re + 1j * im)
                    f = np.fft.ifftn if inverse else np.fft.fftn
                    a = np.fft.fftshift(f(np.fft.ifftshift(a.reshape(n, *sizes), axes), axes=axes, norm="ortho"), axes).ravel()
                    rows = pa.array(np.repeat(np.arange(n), cells))
                    made = {d: part.column(d).take(rows) for d in others} | {d: pa.array(np.tile(i, n)) for d, i in zip(over, index)}
                    yield pa.RecordBatch.from_arrays([*(made[d] for d in dims), pa.array(a.real), pa.array(a.imag)], [*dims, "re", "im"])

        flat = F.lit(0)
        for d, n in zip(over, sizes):
            flat = flat * n + F.col(d)
        packed = x.df.groupBy(*others).agg(F.collect_list(F.struct(flat.cast("int").alias("k"), "re", "im")).alias("_z"))
        kinds = ", ".join([*(f"{d} {'int' if d in over else x.df.schema[d].dataType.simpleString()}" for d in dims), "re double", "im double"])
        return Tensor(packed.mapInArrow(run, kinds), x.shape)

    def _forward(self, x):
        return self._run(x, False)

    def _adjoint(self, y):
        return self._run(y, True)

    def looped(self, dim, n):
        return FFT({**self.ishape, dim: n}, self.over, self.most)


def coordinates(points: DataFrame, axes: dict[str, str], matrix: int, osamp: float) -> tuple[DataFrame, int]:
    """Per axis (point column -> cell column): nearest cell <cell> and offset <cell>_off on the oversampled grid; its size.

    k = p * osamp + N / 2, rounded half to even; points that are NaN or fall outside [0, N) are dropped.
    """
    n = mul_to_even(matrix, osamp)
    df = points
    for p, c in axes.items():
        k = F.col(p) * osamp + n // 2
        df = df.filter(~F.isnan(p)).withColumn(c, F.rint(k)).filter((F.col(c) >= 0) & (F.col(c) < n)).withColumn(f"{c}_off", k - F.col(c)).withColumn(c, F.col(c).cast("int"))
    return df, n


def grid_weights(points: DataFrame, axes: dict[str, str], matrix: int, osamp: float = 2.0, width: int = 4, keys: tuple[str, ...] = ("sample", "trace"), normalised: bool = True, shape: str = "expsemi") -> tuple[DataFrame, int]:
    """(cell columns, in_<key> columns, wr, wi): the separable kernel's weights of each sample's cells, wrapped around; zeros are not kept.

    width 1 is the top-hat. shape: the kernel (expsemi, kaiser, triangle). normalised: expsemi at offset 0 has norm 1; the others are as they are.
    """
    df, n = coordinates(points, axes, matrix, osamp)
    w = F.lit(1.0)
    if width > 1:
        h = full_width(width) // 2
        for c in axes.values():
            df = df.withColumn(f"{c}_o", F.explode(F.array(*(F.lit(o) for o in range(-h, h + 1)))))
            w = w * kernel(shape, (F.col(f"{c}_o") - F.col(f"{c}_off")) / (width / 2), width, osamp)
            df = df.withColumn(c, F.pmod(F.col(c) + F.col(f"{c}_o"), F.lit(n)))
        if normalised and shape == "expsemi":
            w = w * kernel_norm(width, osamp) ** len(axes)
    out = df.select(*axes.values(), *(F.col(k).alias(f"in_{k}") for k in keys), w.alias("wr"), F.lit(0.0).alias("wi"))
    return out.filter("wr <> 0"), n


def gridding(points: DataFrame, axes: dict[str, str], matrix: int, samples: Shape, osamp: float = 2.0, width: int = 4, along: Shape | None = None) -> Sparse:
    """Cartesian grid to samples (gather) as forward, samples to grid (scatter) as adjoint."""
    w, n = grid_weights(points, axes, matrix, osamp, width, tuple(samples))
    cells = {c: n for c in axes.values()}
    swapped = w.select(*(F.col(f"in_{k}").alias(k) for k in samples), *(F.col(c).alias(f"in_{c}") for c in cells), "wr", "wi")
    return Sparse(swapped, cells, dict(samples), dict(along or {}))


def convolution(kernels: Tensor, cells: Shape, channel: str = "channel") -> Sparse:
    """k-space kernels (offsets from their centre, channel) as an operator: grid to grid by channel, out[c, n] = sum over o of kernel[c, o] in[n - o], wrapped.

    An explode over the kernel's offsets, so its weights number cells times kernel.
    """
    spark = kernels.spark
    dims = [d for d in kernels.dims if d != channel]
    offsets = kernels.df.select(channel, *((F.col(d) - kernels.shape[d] // 2).alias(f"_{d}") for d in dims), F.col("re").alias("wr"), F.col("im").alias("wi"))
    w = grid(spark, cells).crossJoin(offsets)
    near = [F.pmod(F.col(d) - F.col(f"_{d}"), F.lit(cells[d])).cast("int").alias(f"in_{d}") for d in dims]
    return Sparse(w.select(*cells, channel, *near, "wr", "wi"), dict(cells), {**cells, channel: kernels.shape[channel]}, {})


def grid_decant(points: DataFrame, axes: dict[str, str], matrix: int, samples: Shape, kernels: Tensor, osamp: float = 2.0, width: int = 4) -> LinOp:
    """Cartesian grid to samples of every channel, the sensitivities convolved in k-space: a second explode, then the gather of gridding."""
    n = mul_to_even(matrix, osamp)
    c = convolution(kernels, {d: n for d in axes.values()})
    return compose(gridding(points, axes, matrix, samples, osamp, width, {"channel": kernels.shape["channel"]}), c)


def nufft_decant(points: DataFrame, axes: dict[str, str], matrix: int, samples: Shape, kernels: Tensor, osamp: float = 2.0, width: int = 4) -> LinOp:
    """Image to samples of every channel without maps in image space: apodise, pad, transform, then grid_decant."""
    spark, dims = points.sparkSession, list(axes.values())
    n = mul_to_even(matrix, osamp)
    image, big = {d: matrix for d in dims}, {d: n for d in dims}
    op: LinOp = Pad(image, big)
    for d in dims:
        op = compose(op, Diagonal(image, apodization(spark, matrix, osamp, width, d)))
    return compose(grid_decant(points, axes, matrix, samples, kernels, osamp, width), compose(FFT(big, dims), op))


def apodization(spark: SparkSession, matrix: int, osamp: float, width: int, dim: str) -> Tensor:
    """1 / max(|centred transform of the kernel|, 1e-3) over the image's cells along one axis."""
    n = mul_to_even(matrix, osamp)
    if width == 1:
        w = np.ones(matrix)
    else:
        fw = full_width(width)
        beta = 0.98 * math.pi * width * (1 - 0.5 / osamp)
        z = (np.arange(fw) - fw // 2) / (width / 2)
        k = np.where(z * z <= 1, np.exp(beta * np.sqrt(np.maximum(0, 1 - z * z)) - 1), 0)
        k *= kernel_norm(width, osamp)
        x = np.arange(matrix) - matrix // 2
        f = (k[:, None] * np.exp(2j * np.pi * (np.arange(fw) - fw // 2)[:, None] * x[None] / n)).sum(0)
        w = 1 / np.maximum(np.abs(f), 1e-3)
    rows = [(i, float(v), 0.0) for i, v in enumerate(w)]
    return Tensor(spark.createDataFrame(rows, f"{dim} int, re double, im double"), {dim: matrix})


def nufft(points: DataFrame, axes: dict[str, str], matrix: int, samples: Shape, osamp: float = 2.0, width: int = 4, along: Shape | None = None, packed: bool = True) -> LinOp:
    """Image to samples: apodise and pad, centred transform, gather. axes: point column -> image dimension."""
    spark = points.sparkSession
    along = dict(along or {})
    dims = list(axes.values())
    image = {**{d: matrix for d in dims}, **along}
    n = mul_to_even(matrix, osamp)
    big = {**{d: n for d in dims}, **along}
    op: LinOp = Pad(image, big)
    for d in dims:
        op = compose(op, Diagonal(image, apodization(spark, matrix, osamp, width, d)))
    if packed:
        op = compose(FFT(big, dims), op)
    else:
        for d in dims:
            op = compose(dft(spark, big, d), op)
    scale = math.sqrt(n / matrix) ** len(dims)
    g = gridding(points, axes, matrix, samples, osamp, width, along)
    from .linop import Scale

    return compose(Scale({**samples, **along}, scale), compose(g, op))


def ndft(points: DataFrame, axes: dict[str, str], matrix: int, samples: Shape, along: Shape | None = None) -> Sparse:
    """The exact transform: every sample with every cell, exp(-2 pi i p . r / M) / sqrt(M) for each axis. For small shapes and as the measure of nufft."""
    spark = points.sparkSession
    df = points
    angle = F.lit(0.0)
    for p, d in axes.items():
        df = df.filter(~F.isnan(p)).crossJoin(F.broadcast(spark.range(matrix).select(F.col("id").cast("int").alias(f"in_{d}"))))
        angle = angle + F.col(p) * (F.col(f"in_{d}") - matrix // 2)
    angle = angle * (-2 * math.pi / matrix)
    s = matrix ** (-0.5 * len(axes))
    w = df.select(*samples, *(f"in_{d}" for d in axes.values()), (F.cos(angle) * s).alias("wr"), (F.sin(angle) * s).alias("wi"))
    return Sparse(w, {d: matrix for d in axes.values()}, dict(samples), dict(along or {}))


def ndft_adjoint(points: DataFrame, axes: dict[str, str], matrix: int, along: Shape | None = None) -> Tensor:
    """The adjoint of ndft() on samples whose values re, im stand beside their coordinates: each row is a sample of its own, met with the cells and summed, nothing is joined."""
    along = dict(along or {})
    df, angle = points, F.lit(0.0)
    for p, d in axes.items():
        df = df.filter(~F.isnan(p)).withColumn(d, F.explode(F.sequence(F.lit(0), F.lit(matrix - 1))))
        angle = angle + F.col(p) * (F.col(d) - matrix // 2)
    angle = angle * (2 * math.pi / matrix)
    s = matrix ** (-0.5 * len(axes))
    re, im = F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle), F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle)
    shape = {**{d: matrix for d in axes.values()}, **along}
    g = df.groupBy(*shape).agg((F.sum(re) * s).alias("re"), (F.sum(im) * s).alias("im"))
    return Tensor(g, shape)


def ndft_normal(points: DataFrame, axes: dict[str, str], matrix: int, along: Shape | None = None) -> Sparse:
    """A^H A of ndft(), each row a sample of its own: a weight depends on the distance of two cells only, so one sum over all samples for each distance, and no row for a sample."""
    spark, dims = points.sparkSession, list(axes.values())
    df, angle = points, F.lit(0.0)
    for p, d in axes.items():
        df = df.filter(~F.isnan(p)).withColumn(f"_{d}", F.explode(F.sequence(F.lit(1 - matrix), F.lit(matrix - 1))))
        angle = angle + F.col(p) * F.col(f"_{d}")
    angle = angle * (2 * math.pi / matrix)
    s = float(matrix) ** -len(axes)
    lags = df.groupBy(*(f"_{d}" for d in dims)).agg((F.sum(F.cos(angle)) * s).alias("wr"), (F.sum(F.sin(angle)) * s).alias("wi"))
    pairs = grid(spark, {**{d: matrix for d in dims}, **{f"in_{d}": matrix for d in dims}})
    pairs = pairs.select("*", *((F.col(d) - F.col(f"in_{d}")).alias(f"_{d}") for d in dims))
    w = pairs.join(lags, [f"_{d}" for d in dims]).select(*dims, *(f"in_{d}" for d in dims), "wr", "wi")
    image = {d: matrix for d in dims}
    return Sparse(cut(w), image, dict(image), dict(along or {}))
