"""Linear operators on tensors, their algebra, and the rewrites that the optimizer cannot know.

Contract: forward(x) and adjoint(y) with <A x, y> = <x, A^H y>; ishape and oshape are checked at every call; inverse(y, s, b) is
y / (s A + b) where an operator has it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tensor import Tensor, combine, grid

Shape = dict[str, int]


class LinOp:
    ishape: Shape
    oshape: Shape

    def forward(self, x: Tensor) -> Tensor:
        if x.shape != self.ishape:
            raise ValueError(f"{type(self).__name__}: input {x.shape}, expected {self.ishape}")
        return self._forward(x)

    def adjoint(self, y: Tensor) -> Tensor:
        if y.shape != self.oshape:
            raise ValueError(f"{type(self).__name__}: output {y.shape}, expected {self.oshape}")
        return self._adjoint(y)

    def inverse(self, y: Tensor, s: float = 1.0, b: float = 0.0) -> Tensor:
        raise NotImplementedError(f"{type(self).__name__} has no inverse")

    def _forward(self, x: Tensor) -> Tensor:
        raise NotImplementedError

    def _adjoint(self, y: Tensor) -> Tensor:
        raise NotImplementedError

    @property
    def H(self) -> LinOp:  # noqa: N802
        return self.inner if isinstance(self, Adjoint) else Adjoint(self)

    def __matmul__(self, other: LinOp) -> LinOp:
        return compose(self, other)

    def __sub__(self, other: LinOp) -> LinOp:
        return Subtract(self, other)


class Identity(LinOp):
    def __init__(self, shape: Shape):
        self.ishape = self.oshape = dict(shape)

    def _forward(self, x):
        return x

    _adjoint = _forward

    def inverse(self, y, s=1.0, b=0.0):
        return y.scaled(1 / (s + b))


class Scale(LinOp):
    """Multiplication by one number."""

    def __init__(self, shape: Shape, factor: complex):
        self.ishape = self.oshape = dict(shape)
        self.factor = complex(factor)

    def _forward(self, x):
        return x.scaled(self.factor)

    def _adjoint(self, y):
        return y.scaled(self.factor.conjugate())

    def inverse(self, y, s=1.0, b=0.0):
        return y.scaled(1 / (s * self.factor + b))


class Adjoint(LinOp):
    def __init__(self, inner: LinOp):
        self.inner = inner
        self.ishape, self.oshape = inner.oshape, inner.ishape

    def _forward(self, x):
        return self.inner.adjoint(x)

    def _adjoint(self, y):
        return self.inner.forward(y)


class Diagonal(LinOp):
    """Multiplication by weights over some of the dimensions, the same for all others; the adjoint conjugates."""

    def __init__(self, shape: Shape, weights: Tensor):
        if any(shape.get(d) != n for d, n in weights.shape.items()):
            raise ValueError("the weights' dimensions are not the tensor's")
        self.ishape = self.oshape = dict(shape)
        self.weights = weights

    def _apply(self, x: Tensor, f: Callable) -> Tensor:
        w = self.weights.df.select(*self.weights.dims, F.col("re").alias("wr"), F.col("im").alias("wi"))
        j = x.df.join(w, self.weights.dims)
        re, im = f(F.col("re"), F.col("im"), F.col("wr"), F.col("wi"))
        return Tensor(j.select(*x.dims, re.alias("re"), im.alias("im")), x.shape)

    def _forward(self, x):
        return self._apply(x, lambda a, b, c, d: (a * c - b * d, a * d + b * c))

    def _adjoint(self, y):
        return self._apply(y, lambda a, b, c, d: (a * c + b * d, b * c - a * d))

    def inverse(self, y, s=1.0, b=0.0):
        """y / (s w + b)."""

        def f(x, z, wr, wi):
            p, q = wr * s + b, wi * s
            m = p * p + q * q
            return (x * p + z * q) / m, (z * p - x * q) / m

        return self._apply(y, f)


@dataclass
class Sparse(LinOp):
    """A weight relation: rows (output dims, input dims prefixed by in_, wr, wi). Dimensions on neither side run along.

    forward is an equi-join on the input key and a partial and final sum by output key; the adjoint swaps the keys and conjugates. Spark
    chooses the join; a small relation is broadcast by its size.
    """

    weights: DataFrame
    idims: Shape
    odims: Shape
    along: Shape

    def __post_init__(self):
        self.ishape = {**self.idims, **self.along}
        self.oshape = {**self.odims, **self.along}

    def _run(self, x: Tensor, source: list[str], out: Shape, sign: float, shape: Shape) -> Tensor:
        names = [f"in_{d}" if source is not self._o else d for d in (self.idims if source is not self._o else self.odims)]
        w = self.weights.withColumnsRenamed({n: f"_k{i}" for i, n in enumerate(names)})
        target = {(d if source is not self._o else f"in_{d}"): f"_o{i}" for i, d in enumerate(out)}
        w = w.withColumnsRenamed(target)
        dims = list(self.idims if source is not self._o else self.odims)
        on = [F.col(d) == F.col(f"_k{i}") for i, d in enumerate(dims)]
        j = x.df.join(w, on)
        re = F.sum(F.col("re") * F.col("wr") - F.col("im") * F.col("wi") * sign)
        im = F.sum(F.col("im") * F.col("wr") + F.col("re") * F.col("wi") * sign)
        g = j.groupBy(*(F.col(f"_o{i}").alias(d) for i, d in enumerate(out)), *(F.col(d) for d in self.along)).agg(re.alias("re"), im.alias("im"))
        return Tensor(g.select(*shape, "re", "im"), shape)

    _o = ["output"]

    def _forward(self, x):
        return self._run(x, ["input"], self.odims, 1.0, self.oshape)

    def _adjoint(self, y):
        return self._run(y, self._o, self.idims, -1.0, self.ishape)


def matmul(weights: DataFrame, rows: int, columns: int, dim: str, along: Shape | None = None, out: str | None = None) -> Sparse:
    """A matrix (o, i, wr, wi) along one dimension."""
    out = out or dim
    return Sparse(weights.select(F.col("o").alias(out), F.col("i").alias(f"in_{dim}"), "wr", "wi"), {dim: columns}, {out: rows}, dict(along or {}))


class Compose(LinOp):
    """left after right."""

    def __init__(self, left: LinOp, right: LinOp):
        if left.ishape != right.oshape:
            raise ValueError(f"cannot compose: {right.oshape} into {left.ishape}")
        self.left, self.right = left, right
        self.ishape, self.oshape = right.ishape, left.oshape

    def _forward(self, x):
        return self.left.forward(self.right.forward(x))

    def _adjoint(self, y):
        return self.right.adjoint(self.left.adjoint(y))


def compose(left: LinOp, right: LinOp) -> LinOp:
    """The product, rewritten: identities drop out, scales merge and move left, an adjoint of a product is the product of adjoints."""
    if left.ishape != right.oshape:
        raise ValueError(f"cannot compose: {right.oshape} into {left.ishape}")
    if isinstance(left, Identity):
        return right
    if isinstance(right, Identity):
        return left
    if isinstance(left, Scale) and isinstance(right, Scale):
        return Scale(left.ishape, left.factor * right.factor)
    if isinstance(right, Scale):
        return compose(Scale(left.oshape, right.factor), left)
    if isinstance(left, Scale) and isinstance(right, Compose) and isinstance(right.left, Scale):
        return compose(Scale(left.ishape, left.factor * right.left.factor), right.right)
    if getattr(left, "undoes", None) is not None and left.undoes(right):
        return Identity(right.ishape)
    return Compose(left, right)


def adjoint(op: LinOp) -> LinOp:
    """The adjoint, pushed into products."""
    if isinstance(op, Compose):
        return compose(adjoint(op.right), adjoint(op.left))
    if isinstance(op, Identity):
        return op
    if isinstance(op, Scale):
        return Scale(op.ishape, op.factor.conjugate())
    return op.H


class Subtract(LinOp):
    """A - B; rows and columns are both checked."""

    def __init__(self, a: LinOp, b: LinOp):
        if a.ishape != b.ishape or a.oshape != b.oshape:
            raise ValueError("shapes differ")
        self.a, self.b, self.ishape, self.oshape = a, b, a.ishape, a.oshape

    def _forward(self, x):
        return combine([(1, self.a.forward(x)), (-1, self.b.forward(x))])

    def _adjoint(self, y):
        return combine([(1, self.a.adjoint(y)), (-1, self.b.adjoint(y))])


class Normal(LinOp):
    """A^H A."""

    def __init__(self, a: LinOp):
        self.a, self.ishape, self.oshape = a, a.ishape, a.ishape

    def _forward(self, x):
        return self.a.adjoint(self.a.forward(x))

    _adjoint = _forward


def _tagged(parts: list[Tensor]) -> Tensor:
    """Blocks as one tensor: a column block, and each block's dimensions padded by zeros of index where it has fewer."""
    shape: Shape = {"block": len(parts)}
    for t in parts:
        for d, n in t.shape.items():
            shape[d] = max(shape.get(d, 1), n)
    df = None
    for k, t in enumerate(parts):
        d = t.df.select(F.lit(k).alias("block"), *(F.col(d) if d in t.shape else F.lit(0).alias(d) for d in shape if d != "block"), "re", "im")
        df = d if df is None else df.unionByName(d)
    return Tensor(df, shape)


def _block(t: Tensor, k: int, shape: Shape) -> Tensor:
    return Tensor(t.df.filter(F.col("block") == k).select(*shape, "re", "im"), shape)


def _stack_shape(shapes: list[Shape]) -> Shape:
    out: Shape = {"block": len(shapes)}
    for s in shapes:
        for d, n in s.items():
            out[d] = max(out.get(d, 1), n)
    return out


class VStack(LinOp):
    """Rows of blocks: one input, a block of output each; the adjoint sums."""

    def __init__(self, ops: list[LinOp]):
        if any(o.ishape != ops[0].ishape for o in ops):
            raise ValueError("inputs differ")
        self.ops, self.ishape, self.oshape = ops, ops[0].ishape, _stack_shape([o.oshape for o in ops])

    def _forward(self, x):
        return _tagged([o.forward(x) for o in self.ops])

    def _adjoint(self, y):
        return combine([(1, o.adjoint(_block(y, k, o.oshape))) for k, o in enumerate(self.ops)])


class HStack(LinOp):
    """Columns of blocks: a block of input each, outputs summed."""

    def __init__(self, ops: list[LinOp]):
        if any(o.oshape != ops[0].oshape for o in ops):
            raise ValueError("outputs differ")
        self.ops, self.oshape, self.ishape = ops, ops[0].oshape, _stack_shape([o.ishape for o in ops])

    def _forward(self, x):
        return combine([(1, o.forward(_block(x, k, o.ishape))) for k, o in enumerate(self.ops)])

    def _adjoint(self, y):
        return _tagged([o.adjoint(y) for o in self.ops])


class DStack(LinOp):
    """Block diagonal."""

    def __init__(self, ops: list[LinOp]):
        self.ops = ops
        self.ishape, self.oshape = _stack_shape([o.ishape for o in ops]), _stack_shape([o.oshape for o in ops])

    def _forward(self, x):
        return _tagged([o.forward(_block(x, k, o.ishape)) for k, o in enumerate(self.ops)])

    def _adjoint(self, y):
        return _tagged([o.adjoint(_block(y, k, o.oshape)) for k, o in enumerate(self.ops)])

    def inverse(self, y, s=1.0, b=0.0):
        return _tagged([o.inverse(_block(y, k, o.oshape), s, b) for k, o in enumerate(self.ops)])


class Extract(LinOp):
    """One block of a stacked tensor; the adjoint fills the others with zeros."""

    def __init__(self, stacked: Shape, block: int, shape: Shape):
        self.ishape, self.oshape, self.block = stacked, shape, block

    def _forward(self, x):
        return _block(x, self.block, self.oshape)

    def _adjoint(self, y):
        df = y.df.select(F.lit(self.block).alias("block"), *(F.col(d) if d in y.shape else F.lit(0).alias(d) for d in self.ishape if d != "block"), "re", "im")
        return Tensor(df, self.ishape)


class Loop(LinOp):
    """The operator for every index of a further dimension: the same plan with one more key."""

    def __new__(cls, op: LinOp, dim: str, n: int):
        if isinstance(op, Sparse):
            return Sparse(op.weights, op.idims, op.odims, {**op.along, dim: n})
        if isinstance(op, Diagonal):
            return Diagonal({**op.ishape, dim: n}, op.weights)
        if isinstance(op, (Identity, Scale)):
            return Identity({**op.ishape, dim: n}) if isinstance(op, Identity) else Scale({**op.ishape, dim: n}, op.factor)
        if isinstance(op, Compose):
            return compose(Loop(op.left, dim, n), Loop(op.right, dim, n))
        if isinstance(op, Adjoint):
            return Adjoint(Loop(op.inner, dim, n))
        if hasattr(op, "looped"):
            return op.looped(dim, n)
        raise NotImplementedError(type(op).__name__)


def dense(op: LinOp, spark) -> DataFrame:
    """(output dims, input dims prefixed in_, re, im): an operator's matrix by columns, for tests on small shapes."""
    df = None
    for row in grid(spark, op.ishape).collect():
        key = row.asDict()
        one = spark.createDataFrame([(*key.values(), 1.0, 0.0)], ", ".join([*(f"{d} int" for d in key), "re double", "im double"]))
        y = op.forward(Tensor(one, op.ishape)).df.select("*", *(F.lit(v).alias(f"in_{d}") for d, v in key.items()))
        df = y if df is None else df.unionByName(y)
    return df
