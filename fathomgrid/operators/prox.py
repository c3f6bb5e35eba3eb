"""Proximal operators: apply(alpha, x) and the convex conjugate's conj(alpha, x). All but the patch SVD are projections in JVM code."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..tensor import Tensor, combine
from .linop import LinOp, _block, _tagged


class Prox:
    def apply(self, alpha: float, x: Tensor) -> Tensor:
        raise NotImplementedError

    def conj(self, alpha: float, x: Tensor) -> Tensor:
        """By Moreau: x - alpha * apply(1 / alpha, x / alpha)."""
        return combine([(1, x), (-alpha, self.apply(1 / alpha, x.scaled(1 / alpha)))])


def _scaled(x: Tensor, f) -> Tensor:
    return x.with_values(F.col("re") * f, F.col("im") * f)


def _abs():
    return F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))


class L1(Prox):
    """Soft threshold by alpha * lam, about a bias if there is one; the conjugate (by Moreau, for every lam) may weight the bias by m."""

    def __init__(self, lam: float, bias: Tensor | None = None, m: LinOp | None = None):
        self.lam, self.bias, self.m = lam, bias, m

    def apply(self, alpha, x):
        m = _abs()
        if self.bias is not None:
            return combine([(1, self.bias), (1, L1(self.lam).apply(alpha, combine([(1, x), (-1, self.bias)])))])
        return _scaled(x, F.when(m > alpha * self.lam, 1 - alpha * self.lam / m).otherwise(0.0))

    def conj(self, alpha, x):
        if self.bias is not None:
            x = combine([(1, x), (-alpha, self.bias if self.m is None else self.m.forward(self.bias))])
        return _scaled(x, self.lam / F.greatest(_abs(), F.lit(self.lam)))


class L1I(Prox):
    """Soft threshold of the imaginary part alone; the conjugate has no real part."""

    def __init__(self, lam: float):
        self.lam = lam

    def apply(self, alpha, x):
        im = F.col("im")
        return x.with_values(F.col("re"), F.signum(im) * F.greatest(F.abs(im) - alpha * self.lam, F.lit(0.0)))

    def conj(self, alpha, x):
        im = F.col("im")
        return x.with_values(F.lit(0.0), im * self.lam / F.greatest(F.abs(im), F.lit(self.lam)))


class L2(Prox):
    """Soft threshold of the 2-norm over the block dimensions."""

    def __init__(self, lam: float, over: list[str]):
        self.lam, self.over = lam, over

    def _norm(self, x: Tensor):
        return F.sqrt(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).over(Window.partitionBy(*(d for d in x.dims if d not in self.over))))

    def apply(self, alpha, x):
        x = Tensor(x.df.withColumn("_n", self._norm(x)), x.shape)
        n = F.col("_n")
        return _scaled(x, F.when(n > alpha * self.lam, 1 - alpha * self.lam / n).otherwise(0.0))

    def conj(self, alpha, x):
        x = Tensor(x.df.withColumn("_n", self._norm(x)), x.shape)
        return _scaled(x, self.lam / F.greatest(F.col("_n"), F.lit(self.lam)))


class SumOfSquares(Prox):
    """Half the squared distance to b; the conjugate may be weighted by m, which has an inverse."""

    def __init__(self, b: Tensor | None = None, m: LinOp | None = None):
        self.b, self.m = b, m

    def apply(self, alpha, x):
        if self.b is None:
            return x.scaled(1 / (1 + alpha))
        return combine([(1 / (1 + alpha), x), (alpha / (1 + alpha), self.b)])

    def conj(self, alpha, x):
        if self.b is not None and self.m is not None:
            return self.m.inverse(combine([(1, x), (-alpha, self.m.forward(self.b))]), alpha, 1.0)
        if self.b is None:
            return x.scaled(1 / (1 + alpha))
        return combine([(1 / (1 + alpha), x), (-alpha / (1 + alpha), self.b)])


class Null(Prox):
    def apply(self, alpha, x):
        return x

    def conj(self, alpha, x):
        return x.scaled(0.0)


class Conjugate(Prox):
    """The conjugate as an operator of its own."""

    def __init__(self, inner: Prox):
        self.inner = inner

    def apply(self, alpha, x):
        return combine([(1, x), (-alpha, self.inner.apply(1 / alpha, x.scaled(1 / alpha)))])


class Transformed(Prox):
    """W^H prox W for an orthogonal W (wavelets)."""

    def __init__(self, w: LinOp, inner: Prox):
        self.w, self.inner = w, inner

    def apply(self, alpha, x):
        return self.w.adjoint(self.inner.apply(alpha, self.w.forward(x)))

    def conj(self, alpha, x):
        return self.w.adjoint(self.inner.conj(alpha, self.w.forward(x)))


class Stack(Prox):
    """One operator for each block of a stacked tensor."""

    def __init__(self, parts: list[Prox], shapes: list[dict[str, int]]):
        self.parts, self.shapes = parts, shapes

    def apply(self, alpha, x):
        return _tagged([p.apply(alpha, _block(x, k, s)) for k, (p, s) in enumerate(zip(self.parts, self.shapes))])

    def conj(self, alpha, x):
        return _tagged([p.conj(alpha, _block(x, k, s)) for k, (p, s) in enumerate(zip(self.parts, self.shapes))])


def patches(x: Tensor, dims: list[str], patch: int, window: int, f, shift: dict[str, int] | None = None) -> Tensor:
    """Each window of cells taken from f of the patch around it.

    Windows of `window` cells, the first one at the shift less a window, cut at the edges; a window's patch of `patch` cells lies about it and is
    moved inside the tensor. f maps an array of shape (patch, ..., the other dimensions' cells) to one of that shape; it runs over dense patches of
    all cells of the dimensions not in dims (absent cells are 0). A cell goes to every patch that holds it by key arithmetic: one explode, one shuffle.
    """
    if any(patch > x.shape[d] or window > patch for d in dims):
        raise ValueError("a window fits its patch, a patch the tensor")
    df, inset = x.df, (patch - window) // 2
    for d in dims:
        n, s = x.shape[d], (shift or {}).get(d, 0) % window
        start = lambda w, s=s: w * window + s
        low = lambda w, n=n, start=start: F.least(F.greatest(start(w) - inset, F.lit(0)), F.lit(n - patch))
        near = F.floor((F.col(d) - s) / window).cast("int")
        reach = -(-patch // window) + 1
        df = df.withColumn(f"_w{d}", F.explode(F.array(*(near + o for o in range(-reach, reach + 1)))))
        w = F.col(f"_w{d}")
        inside = (start(w) < n) & (start(w) + window > 0) & (F.col(d) >= low(w)) & (F.col(d) < low(w) + patch)
        df = df.filter(inside).withColumn(f"_l{d}", low(w).cast("int"))
    size, every, shift = x.shape, x.dims, {d: (shift or {}).get(d, 0) % window for d in dims}
    free = [d for d in every if d not in dims and size[d]]
    keys = [d for d in every if d not in dims and not size[d]]
    sizes = [patch] * len(dims) + [size[d] for d in free]
    flat = F.lit(0)
    for c, n in zip([*(F.col(d) - F.col(f"_l{d}") for d in dims), *map(F.col, free)], sizes):
        flat = flat * n + c
    packed = df.groupBy(*keys, *(f"_w{d}" for d in dims)).agg(F.collect_list(F.struct(flat.cast("int").alias("k"), "re", "im")).alias("_z"))
    kinds = {d: x.df.schema[d].dataType.simpleString() for d in every}
    types = [{"int": pa.int32(), "bigint": pa.int64()}[kinds[d]] if d not in keys else None for d in every]

    def window_of(start: list[int]) -> tuple[list[np.ndarray], tuple]:
        """The window's cells, and where they are in its patch."""
        spans = [np.arange(max(s, 0), min(s + window, size[d])) for s, d in zip(start, dims)]
        lows = [min(max(s - inset, 0), size[d] - patch) for s, d in zip(start, dims)]
        cells = [c.ravel() for c in np.meshgrid(*spans, *(np.arange(size[d]) for d in free), indexing="ij")]
        return cells, tuple(c - lo for c, lo in zip(cells, lows)) + tuple(cells[len(dims) :])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, step := max(1, (1 << 18) // math.prod(sizes))):
                part = b.slice(at, step)
                n, lists = part.num_rows, part.column("_z")
                row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
                k, re, im = (lists.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
                a = np.zeros((n, math.prod(sizes)), complex)
                a[row, k] = re + 1j * im
                starts = np.stack([part.column(f"_w{d}").to_numpy() * window + shift[d] for d in dims], 1).tolist()
                cells, values = [], []
                for start, one in zip(starts, a.reshape(n, *sizes)):
                    found, place = window_of(start)
                    cells.append(found)
                    values.append(f(one)[place])
                rows = pa.array(np.repeat(np.arange(n), [len(v) for v in values]))
                made = dict(zip([*dims, *free], (np.concatenate(c) for c in zip(*cells))))
                y = np.concatenate(values)
                columns = [part.column(d).take(rows) if d in keys else pa.array(made[d], t) for d, t in zip(every, types)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(y.real), pa.array(y.imag)], [*every, "re", "im"])

    return Tensor(packed.mapInArrow(run, ", ".join([*(f"{d} {kinds[d]}" for d in every), "re double", "im double"])), x.shape)


class LocallyLowRank(Prox):
    """Singular values of patches (cells of the patch by the dimension `across`), soft thresholded.

    Patches tile the tensor, or with a window lie about windows of that size (see patches), shifted by shift.
    The threshold grows with the patch: lam * (sqrt M + sqrt N + sqrt log(patches * min(M, N))).
    """

    def __init__(self, lam: float, dims: list[str], across: str, patch: int, window: int | None = None, shift: dict[str, int] | None = None):
        self.lam, self.dims, self.across, self.patch, self.window, self.shift = lam, dims, across, patch, window, shift

    def _windowed(self, alpha, x):
        others = [d for d in x.dims if d not in self.dims and d != self.across and x.shape[d]]
        if others:
            raise ValueError(f"{others} are neither in the patch nor across it")
        m, n = self.patch ** len(self.dims), x.shape[self.across]
        count = math.prod(x.shape[d] // self.window + 2 for d in self.dims)
        cut = alpha * self.lam * (math.sqrt(m) + math.sqrt(n) + math.sqrt(math.log(max(count * min(m, n), 1))))

        def f(a):
            u, s, v = np.linalg.svd(a.reshape(m, n), full_matrices=False)
            return ((u * np.maximum(s - cut, 0)) @ v).reshape(a.shape)

        return patches(x, self.dims, self.patch, self.window, f, self.shift)

    def apply(self, alpha, x):
        if self.window is not None:
            return self._windowed(alpha, x)
        p, dims, across = self.patch, self.dims, self.across
        m, n = p ** len(dims), x.shape[across]
        count = math.prod(-(-x.shape[d] // p) for d in dims)
        cut = alpha * self.lam * (math.sqrt(m) + math.sqrt(n) + math.sqrt(math.log(max(count * min(m, n), 1))))
        others = [d for d in x.dims if d not in dims and d != across]
        keyed = x.df.select("*", *(F.floor(F.col(d) / p).cast("int").alias(f"_p{d}") for d in dims))
        every = x.dims

        def run(f: pd.DataFrame) -> pd.DataFrame:
            row = np.zeros(len(f), np.int64)
            for d in dims:
                row = row * p + f[d].to_numpy() % p
            a = np.zeros((m, n), complex)
            a[row, f[across].to_numpy()] = f.re.to_numpy() + 1j * f.im.to_numpy()
            u, s, v = np.linalg.svd(a, full_matrices=False)
            a = (u * np.maximum(s - cut, 0)) @ v
            y = a[row, f[across].to_numpy()]
            return f[every].assign(re=y.real, im=y.imag)

        kinds = ", ".join([*(f"{d} {x.df.schema[d].dataType.simpleString()}" for d in x.dims), "re double", "im double"])
        return Tensor(keyed.groupBy(*others, *(f"_p{d}" for d in dims)).applyInPandas(run, kinds), x.shape)
