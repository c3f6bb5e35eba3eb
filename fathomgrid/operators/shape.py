"""Slices, pads, crops, masks, reshapes, merges and differences: key arithmetic and filters, no shuffle but where two tables meet."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..tensor import Tensor, grid
from .linop import LinOp, Shape


def window_of(n: int, start: int = 0, size: int = 0, stride: int = 1) -> tuple[int, int, int]:
    """A (start, size, stride) as given to n cells: a negative start wraps, a size of 0 or less counts from the end."""
    start = start + n if start < 0 else start
    size = n - start + size if size <= 0 else size
    if not (0 <= start < n and 0 < size <= n - start and stride > 0):
        raise ValueError(f"slice {start}, {size}, {stride} of {n}")
    return start, size, stride


def slice_dim(t: Tensor, dim: str, start: int = 0, size: int = 0, stride: int = 1) -> Tensor:
    s, n, step = window_of(t.shape[dim], start, size, stride)
    d = F.col(dim)
    df = t.df.filter((d >= s) & (d < s + n) & ((d - s) % step == 0)).withColumn(dim, F.floor((d - s) / step).cast("int"))
    return Tensor(df.select(*t.dims, "re", "im"), {**t.shape, dim: -(-n // step)})


def slice_segments(t: Tensor, dim: str, per_segment: int, segments: tuple[int, int, int], within: tuple[int, int, int]) -> Tensor:
    """Slices segments of per_segment cells each, and the cells within each."""
    cut = split_dim(t, dim, per_segment, "_segment")
    return merge_dims(slice_dim(slice_dim(cut, "_segment", *segments), dim, *within), "_segment", dim)


def split_dim(t: Tensor, dim: str, inner: int, outer: str) -> Tensor:
    """dim as outer * inner + dim."""
    if t.shape[dim] % inner:
        raise ValueError(f"{t.shape[dim]} is no multiple of {inner}")
    df = t.df.withColumn(outer, F.floor(F.col(dim) / inner).cast("int")).withColumn(dim, (F.col(dim) % inner).cast("int"))
    shape = {k: v for d, n in t.shape.items() for k, v in (((dim, inner), (outer, n // inner)) if d == dim else ((d, n),))}
    return Tensor(df.select(*shape, "re", "im"), shape)


def merge_dims(t: Tensor, outer: str, inner: str) -> Tensor:
    """outer * size of inner + inner, named inner."""
    n = t.shape[inner]
    shape = {d: (n * t.shape[outer] if d == inner else x) for d, x in t.shape.items() if d != outer}
    return Tensor(t.df.withColumn(inner, F.col(outer) * n + F.col(inner)).select(*shape, "re", "im"), shape)


def append(a: Tensor, b: Tensor, dim: str, scales: tuple[float, float] = (1.0, 1.0)) -> Tensor:
    """b after a along dim; other dimensions must agree."""
    if {d: n for d, n in a.shape.items() if d != dim} != {d: n for d, n in b.shape.items() if d != dim}:
        raise ValueError(f"cannot append {b.shape} to {a.shape}")
    moved = b.scaled(scales[1]).df.withColumn(dim, F.col(dim) + a.shape[dim])
    return Tensor(a.scaled(scales[0]).df.unionByName(moved.select(*a.dims, "re", "im")), {**a.shape, dim: a.shape[dim] + b.shape[dim]})


def difference(a: Tensor, b: Tensor) -> Tensor:
    """b - a, cell by cell."""
    if a.shape != b.shape:
        raise ValueError("shapes differ")
    other = a.df.select(*a.dims, F.col("re").alias("r"), F.col("im").alias("i"))
    return Tensor(b.df.join(other, a.dims).select(*a.dims, (F.col("re") - F.col("r")).alias("re"), (F.col("im") - F.col("i")).alias("im")), a.shape)


class Pad(LinOp):
    """Centres the tensor in a larger one, zeros around it; (big - small + 1) // 2 cells to the left. The adjoint crops."""

    def __init__(self, small: Shape, big: Shape):
        if any(big[d] < n for d, n in small.items()):
            raise ValueError("the padded shape is smaller")
        self.ishape, self.oshape = dict(small), {d: big[d] for d in small}
        self.left = {d: (big[d] - n + 1) // 2 for d, n in small.items()}

    def _forward(self, x):
        return Tensor(x.df.select(*((F.col(d) + self.left[d]).cast("int").alias(d) if self.ishape[d] != self.oshape[d] else F.col(d) for d in x.dims), "re", "im"), self.oshape)

    def _adjoint(self, y):
        df = y.df
        for d, n in self.ishape.items():
            if self.oshape[d] != n:
                df = df.filter((F.col(d) >= self.left[d]) & (F.col(d) < self.left[d] + n))
        return Tensor(df.select(*((F.col(d) - self.left[d]).cast("int").alias(d) if self.ishape[d] != self.oshape[d] else F.col(d) for d in y.dims), "re", "im"), self.ishape)


class Crop(LinOp):
    """The centre of the tensor; the adjoint pads. Crop after Pad of the same shapes is the identity."""

    def __init__(self, big: Shape, small: Shape):
        self.pad = Pad(small, big)
        self.ishape, self.oshape = self.pad.oshape, self.pad.ishape

    def undoes(self, other: LinOp) -> bool:
        return isinstance(other, Pad) and other.ishape == self.oshape and other.oshape == self.ishape

    def _forward(self, x):
        return self.pad.adjoint(x)

    def _adjoint(self, y):
        return self.pad.forward(y)


class Mask(LinOp):
    """Keeps the cells where the mask (over some dimensions, value above 0) is set; a projection, its own adjoint."""

    def __init__(self, shape: Shape, mask: Tensor):
        self.ishape = self.oshape = dict(shape)
        self.mask = mask

    def _forward(self, x):
        return Tensor(x.df.join(self.mask.df.filter("re > 0").select(*self.mask.dims), self.mask.dims, "left_semi"), x.shape)

    _adjoint = _forward


def real_reference(t: Tensor, at: dict[str, int]) -> Tensor:
    """The real part after division by the phase of the reference slice (cells without one, or with reference 0, keep theirs)."""
    ref = t
    for d, i in at.items():
        ref = ref.chip(d, i)
    m = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    r = ref.df.filter(m > 0).select(*ref.dims, (F.col("re") / m).alias("pr"), (F.col("im") / m).alias("pi"))
    j = t.df.join(r, ref.dims, "left")
    re = F.coalesce(F.col("re") * F.col("pr") + F.col("im") * F.col("pi"), F.col("re"))
    return Tensor(j.select(*t.dims, re.alias("re"), F.lit(0.0).alias("im")), t.shape)


def component(t: Tensor, which: str):
    """The magnitude, real part, imaginary part or phase as a column v."""
    re, im = F.col("re"), F.col("im")
    v = {"mag": F.sqrt(re * re + im * im), "real": re, "imag": im, "phase": F.atan2(im, re)}[which]
    return t.df.select(*t.dims, v.alias("v"))


def zeros(spark, shape: Shape) -> Tensor:
    return Tensor(grid(spark, shape).withColumns({"re": F.lit(0.0), "im": F.lit(0.0)}), shape)
