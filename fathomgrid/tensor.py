"""Tensors as relations: integer dimension columns and the value columns re, im (double).

A row that is absent is a zero; densify() fills them in where a window needs its neighbours. Dimensions go by name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import cut


@dataclass(frozen=True)
class Tensor:
    df: DataFrame
    shape: dict[str, int]

    @property
    def dims(self) -> list[str]:
        return list(self.shape)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def with_values(self, re: Column, im: Column) -> Tensor:
        return Tensor(self.df.select(*self.dims, re.cast("double").alias("re"), im.cast("double").alias("im")), self.shape)

    def scaled(self, a: complex) -> Tensor:
        a = complex(a)
        if a == 1:
            return self
        return self.with_values(F.col("re") * a.real - F.col("im") * a.imag, F.col("re") * a.imag + F.col("im") * a.real)

    def conj(self) -> Tensor:
        return self.with_values(F.col("re"), -F.col("im"))

    def renamed(self, names: dict[str, str]) -> Tensor:
        return Tensor(self.df.select(*(F.col(c).alias(names.get(c, c)) for c in self.df.columns)), {names.get(d, d): n for d, n in self.shape.items()})

    def chip(self, dim: str, at: int) -> Tensor:
        """The slice at one index, without that dimension (an equality that reaches the scan)."""
        return Tensor(self.df.filter(F.col(dim) == at).drop(dim), {d: n for d, n in self.shape.items() if d != dim})

    def densify(self) -> Tensor:
        """All cells as rows, zero where there was none."""
        cells = grid(self.spark, self.shape)
        full = cells.join(self.df, self.dims, "left").select(*self.dims, F.coalesce("re", F.lit(0.0)).alias("re"), F.coalesce("im", F.lit(0.0)).alias("im"))
        return Tensor(full, self.shape)

    def cut(self) -> Tensor:
        return Tensor(cut(self.df), self.shape)

    def dot(self, other: Tensor) -> complex:
        """Sum of self * conj(other)."""
        b = other.df.select(*self.dims, F.col("re").alias("r2"), F.col("im").alias("i2"))
        r = self.df.join(b, self.dims).agg(F.sum(F.col("re") * F.col("r2") + F.col("im") * F.col("i2")), F.sum(F.col("im") * F.col("r2") - F.col("re") * F.col("i2"))).first()
        return complex(r[0] or 0.0, r[1] or 0.0)

    def checked_dot(self, other: Tensor, tolerance: float = 1e-6) -> float:
        """The dot product where it must be real and finite; an error where it is not. Spark sums partials, then the partials."""
        z = self.dot(other)
        if not (z.real - z.real == 0 and z.imag - z.imag == 0):
            raise ArithmeticError(f"a dot product is not finite: {z}")
        if abs(z.imag) > tolerance * max(abs(z), 1e-300):
            raise ArithmeticError(f"a dot product is not real: {z}")
        return z.real

    def norm(self) -> float:
        return (self.df.agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).first()[0] or 0.0) ** 0.5

    def to_numpy(self):
        """A small tensor as a numpy array (axes in the order of the dimensions)."""
        import numpy as np

        out = np.zeros(tuple(self.shape.values()), complex)
        for r in self.df.select(*self.dims, "re", "im").collect():
            out[tuple(r[: len(self.shape)])] += complex(r[-2], r[-1])
        return out


def grid(spark: SparkSession, shape: dict[str, int]) -> DataFrame:
    """All index tuples of a shape, by key arithmetic on one range."""
    n = 1
    for x in shape.values():
        n *= x
    df, stride = spark.range(n), 1
    columns = []
    for d, x in reversed(shape.items()):
        columns.append((F.floor(F.col("id") / stride) % x).cast("int").alias(d))
        stride *= x
    return df.select(*reversed(columns))


def from_numpy(spark: SparkSession, array, dims: Iterable[str]) -> Tensor:
    """A tensor of a small numpy array."""
    import numpy as np

    dims = list(dims)
    a = np.asarray(array, complex)
    rows = [(*map(int, at), float(v.real), float(v.imag)) for at, v in np.ndenumerate(a)]
    return Tensor(spark.createDataFrame(rows, ", ".join([*(f"{d} int" for d in dims), "re double", "im double"])), dict(zip(dims, a.shape)))


def combine(parts: Iterable[tuple[complex, Tensor]]) -> Tensor:
    """The weighted sum of tensors of one shape: a union and one aggregation."""
    parts = [(complex(a), t) for a, t in parts]
    first = parts[0][1]
    if any(t.shape != first.shape for _, t in parts):
        raise ValueError("shapes differ")
    df = None
    for a, t in parts:
        d = t.scaled(a).df.select(*first.dims, "re", "im")
        df = d if df is None else df.unionByName(d)
    return Tensor(df.groupBy(*first.dims).agg(F.sum("re").alias("re"), F.sum("im").alias("im")), first.shape)


def mapped(t: Tensor, f: Callable[[Column, Column], tuple[Column, Column]]) -> Tensor:
    return t.with_values(*f(F.col("re"), F.col("im")))
