"""Coil sensitivities, off-resonance segments, basis (subspace) operators, trajectories and calibration helpers."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tensor import Tensor
from .linop import LinOp, Shape, matmul
from .shape import component, real_reference, slice_dim, slice_segments


class Sense(LinOp):
    """x(cell) to x * S(cell, channel); the adjoint sums conj(S) y over channels. Further dimensions run along."""

    def __init__(self, maps: Tensor, channel: str = "channel", along: Shape | None = None):
        self.maps, self.channel = maps, channel
        cells = {d: n for d, n in maps.shape.items() if d != channel}
        self.cells = cells
        self.ishape = {**cells, **(along or {})}
        self.oshape = {**cells, **(along or {}), channel: maps.shape[channel]}

    def _maps(self) -> DataFrame:
        return self.maps.df.withColumnsRenamed({"re": "sr", "im": "si"})

    def _forward(self, x):
        j = x.df.join(self._maps(), list(self.cells))
        re, im = F.col("re") * F.col("sr") - F.col("im") * F.col("si"), F.col("re") * F.col("si") + F.col("im") * F.col("sr")
        return Tensor(j.select(*(d for d in self.oshape), re.alias("re"), im.alias("im")), self.oshape)

    def _adjoint(self, y):
        j = y.df.join(self._maps(), [*self.cells, self.channel])
        re, im = F.sum(F.col("re") * F.col("sr") + F.col("im") * F.col("si")), F.sum(F.col("im") * F.col("sr") - F.col("re") * F.col("si"))
        return Tensor(j.groupBy(*self.ishape).agg(re.alias("re"), im.alias("im")), self.ishape)


def normalised(maps: Tensor, channel: str = "channel", lam: float = 0.0) -> Tensor:
    """Maps divided by their root sum of squares over channels (plus lam)."""
    cells = [d for d in maps.dims if d != channel]
    s = maps.df.groupBy(*cells).agg(F.sqrt(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("s"))
    j = maps.df.join(s, cells)
    d = F.col("s") + lam
    safe = lambda c: F.when(d > 0, F.col(c) / d).otherwise(0.0)
    return Tensor(j.select(*maps.dims, safe("re").alias("re"), safe("im").alias("im")), maps.shape)


class Segments(LinOp):
    """Off-resonance: x(cell) to x * exp(-2 pi i f(cell) tau) for each segment; the adjoint sums over segments."""

    def __init__(self, field: DataFrame, shape: Shape, taus: list[float], segment: str = "segment"):
        self.field, self.taus, self.segment = field, taus, segment
        self.cells = [c for c in field.columns if c != "f"]
        self.ishape, self.oshape = dict(shape), {**shape, segment: len(taus)}

    def _turned(self, x: Tensor, sign: float, cross: bool) -> DataFrame:
        t = x.spark.createDataFrame([(i, float(v)) for i, v in enumerate(self.taus)], f"{self.segment} int, tau double")
        j = x.df.join(self.field, self.cells)
        j = j.crossJoin(F.broadcast(t)) if cross else j.join(F.broadcast(t), self.segment)
        a = F.col("f") * F.col("tau") * (sign * 2 * math.pi)
        return j.select(*self.oshape, (F.col("re") * F.cos(a) - F.col("im") * F.sin(a)).alias("re"), (F.col("re") * F.sin(a) + F.col("im") * F.cos(a)).alias("im"))

    def _forward(self, x):
        return Tensor(self._turned(x, -1.0, True), self.oshape)

    def _adjoint(self, y):
        return Tensor(self._turned(y, 1.0, False).groupBy(*self.ishape).agg(F.sum("re").alias("re"), F.sum("im").alias("im")), self.ishape)


def basis_blend(images: Tensor, basis: DataFrame, sample: int, trace: int, scale: float = 1.0, dim: str = "b") -> Tensor:
    """The image at one (sample, trace): the basis row contracted with the coefficient images."""
    row = basis.filter((F.col("sample") == sample) & (F.col("trace") == trace)).select(F.col(dim), F.col("re").alias("wr"), F.col("im").alias("wi"))
    keys = [d for d in images.dims if d != dim]
    j = images.df.join(F.broadcast(row), dim)
    re, im = F.sum(F.col("re") * F.col("wr") - F.col("im") * F.col("wi")) * scale, F.sum(F.col("re") * F.col("wi") + F.col("im") * F.col("wr")) * scale
    return Tensor(j.groupBy(*keys).agg(re.alias("re"), im.alias("im")), {d: images.shape[d] for d in keys})


def basis_outer(samples: DataFrame, traces: DataFrame, n: int) -> DataFrame:
    """(b, sample, trace, v): every product of a sample vector (b, sample, v) and a trace vector (b, trace, v); n: trace vectors."""
    a = samples.select(F.col("b").alias("ba"), "sample", F.col("v").alias("va"))
    b = traces.select(F.col("b").alias("bb"), "trace", F.col("v").alias("vb"))
    return a.crossJoin(b).select((F.col("ba") * n + F.col("bb")).cast("int").alias("b"), "sample", "trace", (F.col("va") * F.col("vb")).alias("v"))


def basis_concat(one: DataFrame, two: DataFrame, n: int) -> DataFrame:
    """two's vectors numbered on after one's n."""
    if sorted(one.columns) != sorted(two.columns):
        raise ValueError("the bases have different dimensions")
    return one.unionByName(two.withColumn("b", F.col("b") + n))


def basis_slice(basis: Tensor, per_segment: int = 0, segments: tuple[int, int, int] = (0, 0, 1), **windows: tuple[int, int, int]) -> Tensor:
    """A basis cut to (start, size, stride) of b, sample and trace; with per_segment the window of trace holds within each of the segments chosen."""
    for d, w in windows.items():
        if d != "trace" or not per_segment:
            basis = slice_dim(basis, d, *w)
    return slice_segments(basis, "trace", per_segment, segments, windows.get("trace", (0, 0, 1))) if per_segment else basis


def time_courses(images: Tensor, time: str = "t", otsu: bool = False) -> DataFrame:
    """(cells, time, v): each cell's course in phase with its last image; otsu: of the cells at or above the threshold of that image only."""
    cells = [d for d in images.dims if d != time]
    last = images.chip(time, images.shape[time] - 1)
    real = real_reference(images, {time: images.shape[time] - 1}).df.select(*cells, time, F.col("re").alias("v"))
    if otsu:
        from .stats import otsu as threshold

        m = component(last, "mag")
        kept = m.crossJoin(F.broadcast(threshold(m).select("threshold"))).filter(F.col("v") >= F.col("threshold")).select(*cells)
        real = real.join(kept, cells, "left_semi")
    return real


def basis_contraction(basis: DataFrame, vectors: int, traces: int, along: Shape, dim: str = "b", out: str = "trace"):
    """Coefficients to time courses, as an operator (basis rows b, trace, re, im)."""
    w = basis.select(F.col("trace").alias("o"), F.col(dim).alias("i"), F.col("re").alias("wr"), F.col("im").alias("wi"))
    return matmul(w, traces, vectors, dim, along, out)


def apply_inverse(t: Tensor, r, dim: str = "b") -> Tensor:
    """The b dimension times the inverse of a small matrix."""
    import numpy as np

    from .stats import apply_matrix

    return apply_matrix(t, dim, np.linalg.inv(r))


def nav_windows(traces: DataFrame, count: int, spacing: int, width: int, total: int, trace: str = "trace") -> DataFrame:
    """Traces with each navigator whose window (width traces about nav * spacing, clamped) holds them: an equi-join on few candidates, no range join."""
    near = F.floor(F.col(trace) / spacing).cast("int")
    reach = -(-width // spacing) + 1
    cand = traces.withColumn("nav", F.explode(F.array(*(near + o for o in range(-reach, reach + 1))))).filter((F.col("nav") >= 0) & (F.col("nav") < count))
    start = F.greatest(F.col("nav") * spacing - width // 2, F.lit(0))
    stop = F.least(F.col("nav") * spacing - width // 2 + width, F.lit(total))
    return cand.filter((F.col(trace) >= start) & (F.col(trace) < stop))


def valid_points(points: DataFrame, axes: list[str], matrix: int) -> DataFrame:
    """Points with any |k| > M / 2 become NaN in all axes."""
    bad = F.lit(False)
    for a in axes:
        bad = bad | F.isnan(a) | (F.abs(F.col(a)) > matrix / 2)
    return points.withColumns({a: F.when(bad, F.lit(float("nan"))).otherwise(F.col(a)) for a in axes})


def downsampled(points: DataFrame, axes: list[str], thresholds: list[float]) -> DataFrame:
    """Points outside the ellipsoid of thresholds become NaN."""
    r2 = sum((F.col(a) / t) * (F.col(a) / t) for a, t in zip(axes, thresholds))
    out = F.sqrt(r2) > 1
    return points.withColumns({a: F.when(out | F.isnan(a), F.lit(float("nan"))).otherwise(F.col(a)) for a in axes})


def bounds(points: DataFrame, axes: list[str], keys: tuple[str, str] = ("sample", "trace")) -> DataFrame:
    """One row: first and last sample and trace with a valid point; the last is where a trim ends, exclusive."""
    ok = F.lit(True)
    for a in axes:
        ok = ok & ~F.isnan(a)
    return points.filter(ok).agg(*(f(k).alias(f"{n}_{k}") for k in keys for f, n in ((F.min, "first"), (F.max, "last"))))


def guess_matrix(points: DataFrame, axes: list[str]) -> DataFrame:
    """max(2 ceil(max |k|), 1) for each axis."""
    return points.agg(*(F.greatest(2 * F.ceil(F.max(F.when(~F.isnan(a), F.abs(F.col(a))))), F.lit(1)).cast("long").alias(f"m_{a}") for a in axes))


def shifted(data: DataFrame, axes: dict[str, float], re: str = "re", im: str = "im") -> DataFrame:
    """The phase ramp exp(2 pi i p . delta) of a shift by fractions of the field of view; NaN points become zero."""
    a = F.lit(0.0)
    bad = F.lit(False)
    for p, d in axes.items():
        a = a + F.col(p) * d
        bad = bad | F.isnan(p)
    a = a * (2 * math.pi)
    turn: tuple[Column, Column] = F.col(re) * F.cos(a) - F.col(im) * F.sin(a), F.col(re) * F.sin(a) + F.col(im) * F.cos(a)
    return data.withColumns({re: F.when(bad, 0.0).otherwise(turn[0]), im: F.when(bad, 0.0).otherwise(turn[1])})


#: A dictionary of so many values or fewer goes to the tasks as one matrix (32 MB); a larger one is joined.
DICTIONARY_VALUES = 1 << 22


def _matrix(atoms: DataFrame, atom: str, at: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(atoms in order, components in order, matrix) of a small dictionary."""
    rows = atoms.select(atom, at, F.col("v").cast("double").alias("v")).toPandas()
    names, i = np.unique(rows[atom].to_numpy(), return_inverse=True)
    parts, j = np.unique(rows[at].to_numpy(), return_inverse=True)
    m = np.zeros((len(names), len(parts)))
    np.add.at(m, (i, j), rows["v"].to_numpy())
    return names, parts, m


def _by_matrix(points: DataFrame, names: np.ndarray, parts: np.ndarray, choose: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], key: str, atom: str, at: str) -> DataFrame:
    """(key, atom, rho): choose gives for a block of points over the components the places of the atoms and rho; points without any component of the dictionary have no row."""

    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, 4096):
                part = b.slice(start, 4096)
                lists = part.column("_z")
                line = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                c, v = (lists.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(2))
                k = np.minimum(np.searchsorted(parts, c), max(len(parts) - 1, 0))
                known = parts[k] == c
                p = np.zeros((part.num_rows, len(parts)))
                np.add.at(p, (line[known], k[known]), v[known])
                has = np.bincount(line[known], minlength=part.num_rows) > 0
                best, rho = choose(p[has])
                yield pa.RecordBatch.from_arrays([part.column(key).filter(pa.array(has)), pa.array(names[best]), pa.array(rho)], [key, atom, "rho"])

    kind = points.schema[key].dataType.simpleString()
    name = {"i": "int" if names.dtype.itemsize <= 4 else "long"}.get(names.dtype.kind, "string")
    points = points.filter(F.col(at).isNotNull() & F.col("v").isNotNull())
    packed = points.groupBy(key).agg(F.collect_list(F.struct(at, F.col("v").cast("double").alias("v"))).alias("_z"))
    return packed.mapInArrow(run, f"{key} {kind}, {atom} {name}, rho double")


def dictionary_match(points: DataFrame, atoms: DataFrame, key: str, atom: str, at: str) -> DataFrame:
    """For each point the atom of the largest |<d, p>| (first on ties) and the inner product.

    A dictionary that fits a task is multiplied with blocks of packed points; a larger one is joined on the component, summed and the best
    taken by max_by. Points without any component of the dictionary, and empty dictionaries, give no rows.
    """
    if 0 < atoms.count() <= DICTIONARY_VALUES:
        names, parts, m = _matrix(atoms, atom, at)

        def choose(p):
            dots = p @ m.T
            best = np.argmax(np.round(np.abs(dots), 9), axis=1)
            return best, dots[np.arange(len(p)), best]

        return _by_matrix(points, names, parts, choose, key, atom, at)
    d = atoms.select(atom, at, F.col("v").alias("dv"))
    dots = points.join(d, at).groupBy(key, atom).agg(F.sum(F.col("v") * F.col("dv")).alias("rho"))
    best = F.max_by(F.struct(atom, "rho"), F.struct(F.round(F.abs("rho"), 9), -F.col(atom)))
    return dots.groupBy(key).agg(best.alias("best")).select(key, f"best.{atom}", "best.rho")


@dataclass
class BallTree:
    """Unit atoms in a binary tree: a node's centre is the mean of its atoms, left and right are its children (-1: none), first is its first atom."""

    centre: np.ndarray
    left: np.ndarray
    right: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(matrix: np.ndarray) -> BallTree:
        """Splits by two seeds: the atom least like the centre and the one least like that; ties go to the left, the first seed's side.

        Two atoms are a child each, in their order. Atoms that cannot be parted are one leaf.
        """
        length = np.linalg.norm(matrix, axis=1, keepdims=True)
        unit = np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)
        centre, left, right, first = [], [], [], []

        def node(members):
            centre.append(unit[members].mean(axis=0))
            left.append(-1)
            right.append(-1)
            first.append(members[0])
            return len(centre) - 1

        open_ = [(node(np.arange(len(unit))), np.arange(len(unit)))]
        while open_:
            at, members = open_.pop()
            if len(members) < 2:
                continue
            if len(members) == 2:
                sides = members[:1], members[1:]
            else:
                seed = members[np.argmin(unit[members] @ centre[at])]
                other = members[np.argmin(unit[members] @ unit[seed])]
                far = unit[members] @ unit[seed] < unit[members] @ unit[other]
                sides = members[~far], members[far]
            if all(map(len, sides)):
                left[at], right[at] = node(sides[0]), node(sides[1])
                open_ += [(left[at], sides[0]), (right[at], sides[1])]
        return BallTree(np.array(centre), np.array(left), np.array(right), np.array(first))

    def find(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each point the leaf's first atom and the product with its centre: from the root to the child whose centre has the larger |product|, left on ties."""
        at = np.zeros(len(p), int)
        while (inner := np.flatnonzero(self.left[at] >= 0)).size:
            a, b = self.left[at[inner]], self.right[at[inner]]
            near = np.abs(np.einsum("ij,ij->i", p[inner], self.centre[a])) < np.abs(np.einsum("ij,ij->i", p[inner], self.centre[b]))
            at[inner] = np.where(near, b, a)
        return self.first[at], np.einsum("ij,ij->i", p, self.centre[at])


def dictionary_tree_match(points: DataFrame, atoms: DataFrame, key: str, atom: str, at: str) -> DataFrame:
    """For each point the atom at which a ball tree's descent ends, and the product with that unit atom: fast and not always the best one.

    The tree goes to each task, so a dictionary beyond DICTIONARY_VALUES is an error; an empty one gives no rows.
    """
    n = atoms.count()
    if n > DICTIONARY_VALUES:
        raise ValueError(f"a dictionary of {n} values is too large for a tree in each task")
    if not n:
        return points.select(key, points[key].alias(atom), F.lit(0.0).alias("rho")).limit(0)
    names, parts, m = _matrix(atoms, atom, at)
    return _by_matrix(points, names, parts, BallTree.of(m).find, key, atom, at)
