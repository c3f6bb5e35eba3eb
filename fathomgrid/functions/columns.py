"""Column expressions on complex values and kernels; all stay in generated JVM code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]


def cmul(a: Pair, b: Pair) -> Pair:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def cconj(a: Pair) -> Pair:
    return a[0], -a[1]


def cabs2(re: Column, im: Column) -> Column:
    return re * re + im * im


def cabs(re: Column, im: Column) -> Column:
    return F.sqrt(cabs2(re, im))


def phase(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def polar(r: Column, angle: Column) -> Pair:
    return r * F.cos(angle), r * F.sin(angle)


def unit(re: Column, im: Column) -> Pair:
    """x / |x|, 1 where x is 0."""
    m = cabs(re, im)
    return F.when(m > 0, re / m).otherwise(1.0), F.when(m > 0, im / m).otherwise(0.0)


def rounded(c: Column, places: int = 6) -> Column:
    """round() without negative zero."""
    return F.round(c, places) + F.lit(0.0)


def mul_to_even(n: int, m: float) -> int:
    """The even size for n cells at oversampling m: 2 * floor((n m + 1) / 2)."""
    return 2 * ((int(n * m) + 1) // 2)


def beta(width: int, osamp: float) -> float:
    return 0.98 * math.pi * width * (1 - 0.5 / osamp)


def full_width(width: int) -> int:
    return 1 if width == 1 else 2 * ((width + 1) // 2) + 1


def exp_semi(z: Column, width: int, osamp: float) -> Column:
    """exp(beta sqrt(1 - z^2) - 1) within the unit interval, 0 beyond; z: distance over half the width."""
    return F.when(z * z <= 1, F.exp(F.lit(beta(width, osamp)) * F.sqrt(F.greatest(F.lit(0.0), 1 - z * z)) - 1)).otherwise(0.0)


def triangle(z: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(z))


def bessel_i0(x: Column, terms: int = 14) -> Column:
    """The modified Bessel function of order 0 by its power series; full precision for |x| up to 2."""
    q = x * x / 4
    out = F.lit(1.0)
    for k in range(terms, 0, -1):
        out = 1 + q / float(k * k) * out
    return out


def kaiser_bessel(z: Column, width: int, osamp: float) -> Column:
    """beta I0(sqrt(1 - z^2)) within the unit interval, 0 beyond, beta = 2.34 pi width osamp / 2."""
    return F.when(z * z <= 1, F.lit(2.34 * math.pi * width * osamp / 2) * bessel_i0(F.sqrt(F.greatest(F.lit(0.0), 1 - z * z)))).otherwise(0.0)


def kernel(name: str, z: Column, width: int, osamp: float) -> Column:
    """A gridding kernel by name, at a distance over half the width."""
    return {"expsemi": lambda: exp_semi(z, width, osamp), "kaiser": lambda: kaiser_bessel(z, width, osamp), "triangle": lambda: triangle(z)}[name]()


def kernel_norm(width: int, osamp: float) -> float:
    """The factor that gives the sampled kernel at offset 0 a 2-norm of 1 (one axis; N axes: its N-th power)."""
    if width == 1:
        return 1.0
    fw, b = full_width(width), beta(width, osamp)
    z = [(o - fw // 2) / (width / 2) for o in range(fw)]
    return sum(math.exp(b * math.sqrt(1 - x * x) - 1) ** 2 for x in z if x * x <= 1) ** -0.5


def tukey(r: Column, start: float, end: float, height: float) -> Column:
    """1 inside start, a cosine ramp down to height at end, 0 beyond; 0 for a NaN radius."""
    ramp = (height + 1) / 2 + (1 - height) / 2 * F.cos((r - start) * math.pi / (end - start))
    return F.when(F.isnan(r), 0.0).when(r <= start, 1.0).when(r <= end, ramp).otherwise(0.0)
