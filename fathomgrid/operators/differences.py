"""Finite differences as weight relations (forward and adjoint from one table) and orthogonal wavelets."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tensor import Tensor, grid
from .linop import LinOp, Shape, Sparse, compose, matmul


def _cells(spark: SparkSession, shape: Shape, dims: list[str]) -> DataFrame:
    return grid(spark, {d: shape[d] for d in dims})


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _difference(spark: SparkSession, shape: Shape, dims: list[str], axis: str, step: int, scale: float, out: dict, inn: dict) -> DataFrame:
    """Rows of scale * (x[n + step] - x[n]), circular; out, inn: further key columns."""
    cells = _cells(spark, shape, dims)
    rows = []
    for move, w in ((step, scale), (0, -scale)):
        near = [F.pmod(F.col(d) + move, F.lit(shape[d])).cast("int") if d == axis else F.col(d) for d in dims]
        cols = [*(F.col(d) for d in dims), *(F.lit(v).alias(k) for k, v in out.items()), *(c.alias(f"in_{d}") for c, d in zip(near, dims)), *(F.lit(v).alias(f"in_{k}") for k, v in inn.items())]
        rows.append(cells.select(*cols, F.lit(w).alias("wr"), F.lit(0.0).alias("wi")))
    return _union(rows)


def gradient(spark: SparkSession, shape: Shape, dims: list[str], g: str = "g") -> Sparse:
    """Circular forward differences along each of dims as a further dimension g, each (x[n+1] - x[n]) / (2 sqrt(number of dims))."""
    s = 1 / (2 * math.sqrt(len(dims)))
    w = _union([_difference(spark, shape, dims, d, 1, s, {g: k}, {}) for k, d in enumerate(dims)])
    inner = {d: shape[d] for d in dims}
    return Sparse(w, inner, {**inner, g: len(dims)}, {d: n for d, n in shape.items() if d not in dims})


def divergence(spark: SparkSession, shape: Shape, dims: list[str], g: str = "g") -> Sparse:
    """Circular backward differences of the components of g, summed: (x[n] - x[n-1]) / (2 sqrt(2 dims)); the adjoint is the true one."""
    s = 1 / (2 * math.sqrt(2 * len(dims)))
    w = _union([_difference(spark, shape, dims, d, -1, -s, {}, {g: k}) for k, d in enumerate(dims)])
    inner = {d: shape[d] for d in dims}
    return Sparse(w, {**inner, g: len(dims)}, inner, {d: n for d, n in shape.items() if d not in dims})


def gradient_of_vector(spark: SparkSession, shape: Shape, dims: list[str], g: str = "g") -> Sparse:
    """The symmetrised gradient of a vector field: diagonals first, then pairs scaled by 1 / sqrt 2 (backward differences)."""
    n = len(dims)
    s = 1 / (2 * math.sqrt(2 * n))
    parts = [_difference(spark, shape, dims, d, -1, -s, {g: k}, {g: k}) for k, d in enumerate(dims)]
    at = n
    for a in range(n):
        for b in range(a + 1, n):
            parts.append(_difference(spark, shape, dims, dims[a], -1, -s / math.sqrt(2), {g: at}, {g: b}))
            parts.append(_difference(spark, shape, dims, dims[b], -1, -s / math.sqrt(2), {g: at}, {g: a}))
            at += 1
    inner = {d: shape[d] for d in dims}
    return Sparse(_union(parts), {**inner, g: n}, {**inner, g: at}, {d: x for d, x in shape.items() if d not in dims})


def stencil(spark: SparkSession, shape: Shape, weights: list[tuple[dict[str, int], float]], dims: list[str], margins: list[list[str]] | None = None) -> Sparse:
    """Sums of moved cells; output cells on the border of the moved dimensions stay 0."""
    inner = {d: shape[d] for d in dims}
    cells = _cells(spark, shape, dims)
    rows = []
    for move, w in weights:
        inside = F.lit(True)
        for d in move.get("_inside", dims) if "_inside" in move else [d for d in dims if d in move]:
            inside = inside & (F.col(d) >= 1) & (F.col(d) < shape[d] - 1)
        near = [(F.col(d) + move.get(d, 0)).cast("int").alias(f"in_{d}") for d in dims]
        rows.append(cells.filter(inside).select(*dims, *near, F.lit(w).alias("wr"), F.lit(0.0).alias("wi")))
    w = _union(rows).groupBy(*dims, *(f"in_{d}" for d in dims)).agg(F.sum("wr").alias("wr"), F.sum("wi").alias("wi"))
    return Sparse(w, inner, inner, {d: n for d, n in shape.items() if d not in dims})


def laplacian(spark: SparkSession, shape: Shape, dims: list[str]) -> Sparse:
    """-1/2 of the sum over dims of x/3 - x+/6 - x-/6; the first and last plane of a dimension have no part of it."""
    rows = []
    for d in dims:
        rows += [({"_inside": [d]}, -1 / 6), ({d: 1, "_inside": [d]}, 1 / 12), ({d: -1, "_inside": [d]}, 1 / 12)]
    return stencil(spark, shape, rows, dims)


def isotropic_laplacian(spark: SparkSession, shape: Shape, dims: list[str]) -> Sparse:
    """The 27-point stencil (9-point on two dimensions): weights by the number of moved axes, border untouched."""
    # fixed values: weights of the centre, faces, edges and corners
    by_moves = (-200.0, 20.0, 6.0, 1.0)
    s = 1 / (48 * math.sqrt(28.3))
    rows = []
    for k in range(3 ** len(dims)):
        move = {d: (k // 3**i) % 3 - 1 for i, d in enumerate(dims)}
        rows.append(({**{d: m for d, m in move.items() if m}, "_inside": dims}, s * by_moves[sum(m != 0 for m in move.values())]))
    return stencil(spark, shape, rows, dims)


# Daubechies scaling coefficients by width, each to be divided by sqrt 2.
DAUBECHIES = {
    4: (0.6830127, 1.1830127, 0.3169873, -0.1830127),
    6: (0.47046721, 1.14111692, 0.650365, -0.19093442, -0.12083221, 0.0498175),
    8: (0.32580343, 1.01094572, 0.89220014, -0.03957503, -0.26450717, 0.0436163, 0.0465036, -0.01498699),
}


def wavelet_levels(n: int) -> list[int]:
    """The lengths that are split, longest first: halves as long as they stay even, the last over 4 or what remains."""
    out, size = [n], n
    while (size // 2) % 2 == 0 and size > 4:
        size //= 2
        out.append(size)
    return out


def wavelet_level(spark: SparkSession, shape: Shape, dim: str, size: int, width: int = 4) -> Sparse:
    """One periodic level: the first size cells become low and high halves, the rest passes."""
    c = [x / math.sqrt(2) for x in DAUBECHIES[width]]
    r = [(-1) ** k * c[width - 1 - k] for k in range(width)]
    n = shape[dim]
    half = spark.range(size // 2).select(F.col("id").cast("int").alias("h"))
    rows = []
    for k in range(width):
        near = F.pmod(2 * F.col("h") - width // 2 + k, F.lit(size)).cast("int").alias("i")
        rows.append(half.select(F.col("h").alias("o"), near, F.lit(c[k]).alias("wr")))
        rows.append(half.select((F.col("h") + size // 2).cast("int").alias("o"), near, F.lit(r[k]).alias("wr")))
    if n > size:
        rows.append(spark.range(size, n).select(F.col("id").cast("int").alias("o"), F.col("id").cast("int").alias("i"), F.lit(1.0).alias("wr")))
    w = _union(rows).groupBy("o", "i").agg(F.sum("wr").alias("wr")).withColumn("wi", F.lit(0.0))
    return matmul(w, n, n, dim, {d: x for d, x in shape.items() if d != dim})


def wavelet_matrix(n: int, width: int = 4) -> np.ndarray:
    """All levels over n cells as one orthogonal matrix: each row is a wavelet, so about n * width * levels entries are not 0."""
    c = np.array(DAUBECHIES[width]) / math.sqrt(2)
    high = (-1.0) ** np.arange(width) * c[::-1]
    out = np.eye(n)
    for size in wavelet_levels(n):
        if size >= 4 and size % 2 == 0:
            h = np.arange(size // 2)
            step = np.zeros((size, size))
            for k in range(width):
                near = (2 * h - width // 2 + k) % size
                np.add.at(step, (h, near), c[k])
                np.add.at(step, (h + size // 2, near), high[k])
            out[:size] = step @ out[:size]
    return out


def wavelets(spark: SparkSession, shape: Shape, dims: list[str], width: int = 4) -> LinOp:
    """All levels of all dims, one join and one sum for each dimension; the adjoint is the inverse."""
    op: LinOp | None = None
    for d in dims:
        m = wavelet_matrix(shape[d], width)
        if np.array_equal(m, np.eye(shape[d])):
            continue
        rows = [(int(o), int(i), float(m[o, i]), 0.0) for o, i in zip(*np.nonzero(m))]
        level = matmul(spark.createDataFrame(rows, "o int, i int, wr double, wi double"), shape[d], shape[d], d, {e: x for e, x in shape.items() if e != d})
        op = level if op is None else compose(level, op)
    if op is None:
        raise ValueError("nothing to split")
    return op


def interior_difference(t: Tensor, dim: str, kind: str = "forward") -> Tensor:
    """Differences along one dimension where both neighbours are: forward x[n+1] - x[n], backward x[n] - x[n-1], central half of x[n+1] - x[n-1]; others are absent."""
    ahead, behind, factor = {"forward": (1, 0, 1.0), "backward": (0, 1, 1.0), "central": (1, 1, 0.5)}[kind]
    n = t.shape[dim]
    moved = lambda by, sign: t.df.withColumn(dim, F.col(dim) - by).withColumns({"re": F.col("re") * sign, "im": F.col("im") * sign})
    both = moved(ahead, factor).unionByName(moved(-behind, -factor)).filter((F.col(dim) >= behind) & (F.col(dim) < n - ahead))
    return Tensor(both.groupBy(*t.dims).agg(F.sum("re").alias("re"), F.sum("im").alias("im")), t.shape)


def circular_difference_by_window(t: Tensor, dim: str, scale: float) -> Tensor:
    """The gradient along one dense dimension by lead over each line: no weight table, one shuffle by line."""
    from pyspark.sql import Window

    others = [d for d in t.dims if d != dim]
    w = Window.partitionBy(*others).orderBy(dim)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w))
    return Tensor(t.df.select(*t.dims, ((nxt("re") - F.col("re")) * scale).alias("re"), ((nxt("im") - F.col("im")) * scale).alias("im")), t.shape)
