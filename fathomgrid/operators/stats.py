"""Statistics: norms, Gram matrices, Otsu thresholds, nearest-rank percentiles, scaling, compression, ranking by ratio."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import cabs2
from ..tensor import Tensor


def rss(t: Tensor, over: str) -> DataFrame:
    """Root of the sum of squares over one dimension, as v."""
    return t.df.groupBy(*(d for d in t.dims if d != over)).agg(F.sqrt(F.sum(cabs2(F.col("re"), F.col("im")))).alias("v"))


def gram(t: Tensor, variable: str, demean: bool = False, ddof_axis: str = "variables") -> DataFrame:
    """(a, b, re, im): conj(x_a) . x_b over all other dimensions, divided by the number of variables (or samples) less one."""
    keys = [d for d in t.dims if d != variable]
    df = t.df
    if demean:
        m = df.groupBy(variable).agg(F.avg("re").alias("mr"), F.avg("im").alias("mi"))
        df = df.join(m, variable).select(*t.dims, (F.col("re") - F.col("mr")).alias("re"), (F.col("im") - F.col("mi")).alias("im"))
    n = t.shape[variable] if ddof_axis == "variables" else int(np.prod([t.shape[d] for d in keys]))
    # the variables of a key meet in one row, as many as there are variables: one shuffle, and pairs are summed where they are made
    packed = df.groupBy(*keys).agg(F.collect_list(F.struct(F.col(variable).alias("a"), F.col("re").alias("ar"), F.col("im").alias("ai"))).alias("_z"))
    one = packed.select("_z", F.explode("_z").alias("_x")).select("_z", "_x.*")
    other = F.transform("_z", lambda z: F.struct(z["a"].alias("b"), z["ar"].alias("br"), z["ai"].alias("bi")))
    j = one.select("a", "ar", "ai", F.explode(other).alias("_y")).select("a", "ar", "ai", "_y.*").filter("a <= b")
    re, im = F.col("ar") * F.col("br") + F.col("ai") * F.col("bi"), F.col("ar") * F.col("bi") - F.col("ai") * F.col("br")
    half = j.groupBy("a", "b").agg((F.sum(re) / (n - 1)).alias("re"), (F.sum(im) / (n - 1)).alias("im"))
    mirror = F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "re", (-F.col("im")).alias("im"))
    return half.select(F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", "re", "im"))).otherwise(F.array(F.struct("a", "b", "re", "im"), mirror))).alias("_g")).select("_g.*")


def correlation(t: Tensor, variable: str) -> DataFrame:
    """The de-meaned Gram matrix divided by both deviations."""
    g = gram(t, variable, demean=True)
    d = g.filter("a = b").select(F.col("a").alias("k"), F.sqrt("re").alias("s"))
    j = g.join(d.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a").join(d.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
    return j.select("a", "b", (F.col("re") / (F.col("sa") * F.col("sb"))).alias("re"), (F.col("im") / (F.col("sa") * F.col("sb"))).alias("im"))


def otsu(values: DataFrame, column: str = "v", bins: int = 128) -> DataFrame:
    """One row (threshold, above): of bins thresholds from 0 to the maximum the first with the least weighted sample variance of the two classes.

    One pass gives each value its bin, a second sums bins: no value meets every threshold. Counts are of values at or above the threshold.
    """
    v = F.col(column).cast("double")
    top = values.agg(F.max(v).alias("m"))
    x = values.select(v.alias("v")).crossJoin(F.broadcast(top))
    guess = F.least(F.floor(F.col("v") / F.col("m") * (bins - 1)), F.lit(bins - 1)).cast("int")
    at = lambda k: k * F.col("m") / (bins - 1)
    # the bin is the number of the last threshold at or below the value, made sure of by comparison
    k = F.when(at(guess + 1) <= F.col("v"), guess + 1).when(at(guess) > F.col("v"), guess - 1).otherwise(guess)
    hist = x.filter("m > 0 and v >= 0").select("m", k.alias("k"), "v").groupBy("k", "m").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    whole = Window.partitionBy("m")
    up = whole.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # each threshold takes the sums of the bins from its own on
    ks = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("b"))
    dense = F.broadcast(ks).crossJoin(F.broadcast(top)).filter("m > 0").join(hist.select("k", "n", "s", "q"), F.col("b") == F.col("k"), "left").select(F.col("b").alias("k"), "m", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "s", "q")))
    t = dense.select("k", "m", F.sum("n").over(up).alias("n1"), F.sum("s").over(up).alias("s1"), F.sum("q").over(up).alias("q1"), F.sum("n").over(whole).alias("n"), F.sum("s").over(whole).alias("s"), F.sum("q").over(whole).alias("q"))
    t = t.withColumn("n0", F.col("n") - F.col("n1")).filter("n1 > 1 and n0 > 1")
    var = lambda n, s, q: (q - s * s / n) / (n - 1)
    sigma = F.col("n0") / F.col("n") * var(F.col("n0"), F.col("s") - F.col("s1"), F.col("q") - F.col("q1")) + F.col("n1") / F.col("n") * var(F.col("n1"), F.col("s1"), F.col("q1"))
    best = F.min_by(F.struct((F.col("k") * F.col("m") / (bins - 1)).alias("threshold"), F.col("n1").alias("above")), F.struct(F.round(sigma, 9), F.col("k")))
    return t.agg(best.alias("best")).select("best.threshold", "best.above")


def nearest_rank(values: DataFrame, fractions: list[float], column: str = "v", rule: str = "image") -> DataFrame:
    """(p, v): the sorted value at trunc(p (n - 1)) (rule image) or trunc(n p) (rule data); p is a fraction.

    A range sort: partitions are counted, then only the partitions that hold wanted ranks are read again, once, and ranked each on its own.
    """
    spark = values.sparkSession
    x = values.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    parts = x.groupBy("v").agg(F.count("*").alias("c")).repartitionByRange("v").withColumn("part", F.spark_partition_id())
    ranges, n = [], 0
    for r in parts.groupBy("part").agg(F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("lo").collect():
        ranges.append((n, n + r.c, r.lo, r.hi))
        n += r.c
    if not n or not fractions:
        return spark.createDataFrame([], "p double, v double")
    rank = {float(p): min(n - 1, int(p * (n - 1)) if rule == "image" else int(n * p)) for p in fractions}
    held = {k: next(i for i, (first, end, _, _) in enumerate(ranges) if first <= k < end) for k in rank.values()}
    # NaN is the largest value, and equal to itself
    part = F.coalesce(*(F.when(F.col("v").between(*ranges[i][2:]), F.lit(i)) for i in sorted(set(held.values()))))
    inside = x.withColumn("part", part).filter("part is not null").groupBy("part", "v").agg(F.count("*").alias("c"))
    start = F.element_at(F.create_map(*(F.lit(y) for i in set(held.values()) for y in (i, ranges[i][0]))), F.col("part"))
    upto = F.sum("c").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = inside.withColumn("upto", start + upto)
    here = F.array_compact(F.array(*(F.when((F.col("upto") - F.col("c") <= k) & (F.col("upto") > k), F.lit(p)) for p, k in rank.items())))
    return ranked.select(F.explode(here).alias("p"), "v")


def scale_bart(values: DataFrame, column: str = "v", rule: str = "image") -> DataFrame:
    """1 / (the 90th percentile, or the maximum if that is no outlier)."""
    r = nearest_rank(values, [0.5, 0.9, 1.0], column, rule).agg(*(F.max(F.when(F.col("p") == p, F.col("v"))).alias(c) for p, c in ((0.5, "med"), (0.9, "p90"), (1.0, "top"))))
    by = F.when(F.col("top") - F.col("p90") < 2 * (F.col("p90") - F.col("med")), F.col("p90")).otherwise(F.col("top"))
    return r.select((1 / by).alias("scale"))


def scale_otsu(values: DataFrame, column: str = "v", bins: int = 128) -> DataFrame:
    """1 / median of the values above the Otsu threshold."""
    t = otsu(values, column, bins).select("threshold")
    above = values.select(F.col(column).cast("double").alias("v")).crossJoin(F.broadcast(t)).filter("v > threshold").select("v")
    return nearest_rank(above, [0.5], "v").select((1 / F.col("v")).alias("scale"))


def cumulative_below(values: DataFrame, order: Column, threshold: float, column: str = "v") -> DataFrame:
    """How many of the normalised cumulative sums, largest first, are below the threshold (over 0, at most 1), for a small table."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold is over 0, at most 1")
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy(F.lit(1))
    c = values.select((F.sum(column).over(w) / F.sum(column).over(total)).alias("c"))
    return c.agg(F.count(F.when(F.col("c") < threshold, 1)).alias("n"))


def small_matrix(df: DataFrame, n: int) -> np.ndarray:
    """A small (a, b, re, im) table as a matrix on the driver."""
    m = np.zeros((n, n), complex)
    for r in df.collect():
        m[r.a, r.b] = complex(r.re, r.im)
    return m


def eig(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a Hermitian matrix, largest first, and vectors as columns, phases fixed by their largest entries."""
    w, v = np.linalg.eigh((m + m.conj().T) / 2)
    w, v = w[::-1], v[:, ::-1]
    top = v[np.argmax(np.abs(v), axis=0), np.arange(v.shape[1])]
    return w, v * (np.abs(top) / top)


def compression(t: Tensor, channel: str, keep: int | float) -> np.ndarray:
    """Rows of the matrix that compresses the channels: keep so many, or so great a fraction of the energy."""
    w, v = eig(small_matrix(gram(t, channel), t.shape[channel]).conj())
    n = keep if isinstance(keep, int) else int((np.cumsum(w) / w.sum() < keep).sum()) + 1
    return v[:, :n].conj().T


def apply_matrix(t: Tensor, channel: str, matrix: np.ndarray) -> Tensor:
    """matrix times the channel dimension (no conjugate): a broadcast join and a sum."""
    from .linop import matmul

    rows = [(int(o), int(i), float(x.real), float(x.imag)) for (o, i), x in np.ndenumerate(np.asarray(matrix, complex))]
    w = t.spark.createDataFrame(rows, "o int, i int, wr double, wi double")
    return matmul(w, matrix.shape[0], matrix.shape[1], channel, {d: n for d, n in t.shape.items() if d != channel}).forward(t)


def rovir(signal: np.ndarray, interference: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signal-to-interference ratios, best first, and the orthonormalised channel combinations (rows)."""
    low = np.linalg.cholesky(interference + 1e-9 * np.trace(interference).real / len(interference) * np.eye(len(interference)))
    inv = np.linalg.inv(low)
    w, v = eig(inv @ signal @ inv.conj().T)
    return w, gram_schmidt((inv.conj().T @ v).T)


def gram_schmidt(rows: np.ndarray) -> np.ndarray:
    """Modified Gram-Schmidt over rows."""
    out = np.array(rows, complex)
    for i in range(len(out)):
        for j in range(i):
            out[i] -= out[j] * (out[j].conj() @ out[i])
        out[i] /= np.linalg.norm(out[i])
    return out


def basis_from_courses(spark: SparkSession, courses: DataFrame, cells: list[str], time: str, n: int, steps: int) -> np.ndarray:
    """The first n singular vectors of time courses (cells, time, v), from their Gram matrix over time: steps squared sums reach the driver, whatever the cells."""
    line = courses.groupBy(*cells).agg(F.map_from_entries(F.collect_list(F.struct(time, "v"))).alias("c"))
    line = line.select(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.coalesce(F.element_at("c", k.cast("int")), F.lit(0.0))).alias("x"))
    pair = line.select(F.posexplode("x").alias("a", "va"), "x").select("a", "va", F.posexplode("x").alias("b", "vb"))
    g = np.zeros((steps, steps))
    for r in pair.groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("v")).collect():  # steps squared rows
        g[r.a, r.b] = r.v
    _, v = np.linalg.eigh(g)
    return v[:, ::-1][:, :n].T


def svd_basis(spark: SparkSession, dynamics: np.ndarray, n: int) -> np.ndarray:
    """The first n right singular vectors of a small table of time courses, as rows with phases fixed."""
    _, _, v = np.linalg.svd(dynamics, full_matrices=False)
    top = v[np.arange(len(v)), np.argmax(np.abs(v), axis=1)]
    return (v * (np.abs(top) / top)[:, None])[:n]
