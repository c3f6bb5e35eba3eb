"""More registered queries: operator algebra, kernels, patches, calibration, storage, with their SQL twins."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import generators as G
from ..functions.columns import kaiser_bessel, rounded
from ..operators import differences, fourier, prox, recon, sense, shape, solvers, stats
from ..operators.linop import Adjoint, Compose, Diagonal, DStack, Extract, Identity, Loop, Normal, Scale, VStack, matmul
from ..runtime import shared_dir
from ..sources import store
from ..tensor import Tensor, from_numpy
from .catalogue import MAPPED, _points, _size, cells, query
from .tables import COILS, IMAGES, KSPACE, LINES, PAIRS, PI, SAMPLES, coils, images, kspace, lines, out, pairs, read

S = {"x": 64, "trace": 0}


def _lines(spark, d) -> Tensor:
    return Tensor(lines(spark, d).df, S)


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/fathomgrid-store-{uuid.uuid4().hex}"


# ---- slices and algebra ----


@query(f"WITH {IMAGES} SELECT trace, CAST(i - 2 AS INT) AS i, CAST((j - 1) // 2 AS INT) AS j, round(re, 6) + 0.0 AS re FROM images WHERE i BETWEEN 2 AND 6 AND j BETWEEN 1 AND 6 AND (j - 1) % 2 = 0")
def slice_image(spark, d):
    """A block of each image, every second column."""
    t = shape.slice_dim(shape.slice_dim(images(spark, d), "i", 2, 5), "j", 1, 6, 2)
    return out(t.df, "trace", "i", "j", re="re")


@query(f"WITH {IMAGES} SELECT trace, CAST(j AS INT) AS i, CAST(i AS INT) AS j, round(re, 6) + 0.0 AS re FROM images")
def shuffle_dims(spark, d):
    """Both axes of the images change places."""
    return out(images(spark, d).renamed({"i": "j", "j": "i"}).df, "trace", "i", "j", re="re")


@query(f"WITH {LINES} SELECT trace, x, round(-re, 6) + 0.0 AS re FROM lines")
def extract_block(spark, d):
    """The second block of a stack of the lines and their negatives."""
    op = VStack([Identity(S), Scale(S, -1.0)])
    return out(Extract(op.oshape, 1, S).forward(op.forward(_lines(spark, d))).df, "trace", "x", re="re")


@query(f"WITH {LINES} SELECT CAST(b AS INT) AS block, trace, x, round(CASE b WHEN 0 THEN re / 4.5e0 ELSE re / 0.5e0 END, 6) + 0.0 AS re FROM lines, range(2) AS r(b)")
def dstack_inverse(spark, d):
    """Y / (s A + b) of a block diagonal of 2 and the identity, s = 2 and b = 0.5, then s = 0 for the second."""
    t = _lines(spark, d)
    op = DStack([Scale(S, 2.0), Scale(S, 0.0)])
    both = t.df.withColumn("block", F.lit(0)).unionByName(t.df.withColumn("block", F.lit(1)))
    return out(op.inverse(Tensor(both.select("block", "x", "trace", "re", "im"), op.oshape), 2.0, 0.5).df, "block", "trace", "x", re="re")


@query(f"WITH {LINES} SELECT trace, x, round(re / (3 * (1 + x) + 0.5e0), 6) + 0.0 AS re FROM lines")
def tensor_scale_inverse(spark, d):
    """Weights along one dimension, broadcast over the other; y / (s w + b)."""
    w = spark.range(64).select(F.col("id").cast("int").alias("x"), (F.col("id") + 1.0).alias("re"), F.lit(0.0).alias("im"))
    return out(Diagonal(S, Tensor(w, {"x": 64})).inverse(_lines(spark, d), 3.0, 0.5).df, "trace", "x", re="re")


@query(f"WITH {PAIRS} SELECT trace, x, round(2 * re + im, 6) + 0.0 AS re, round(2 * im - re, 6) + 0.0 AS im FROM pairs")
def diag_scale_adjoint(spark, d):
    """The adjoint of a product of scales, 2 + i conjugated."""
    t = pairs(spark, d)
    op = Adjoint(Compose(Scale(t.shape, 2 + 1j), Identity(t.shape)))
    return cells(op.forward(t), "trace", "x")


@query(f"WITH {LINES} SELECT a.trace, a.x, round((2 * a.re - b.re - c.re) / 4, 6) + 0.0 AS re FROM lines a JOIN lines b ON a.trace = b.trace AND b.x = (a.x + 1) % 64 JOIN lines c ON a.trace = c.trace AND c.x = (a.x + 63) % 64")
def normal_operator(spark, d):
    """A^H A of the gradient."""
    return out(Normal(differences.gradient(spark, S, ["x"])).forward(_lines(spark, d)).df, "trace", "x", re="re")


@query(f"WITH {IMAGES} SELECT trace, CAST(o AS INT) AS o, CAST(i AS INT) AS i, round(sum(re * (1 + o * j) / 8.0e0), 6) + 0.0 AS re FROM images, range(3) AS r(o) GROUP BY trace, o, i")
def loop_matmul(spark, d):
    """A 3 x 8 matrix along one axis, looped over the others: one more key in the same plan."""
    w = spark.range(24).select(F.floor(F.col("id") / 8).cast("int").alias("o"), (F.col("id") % 8).cast("int").alias("i")).withColumns({"wr": (1 + F.col("o") * F.col("i")) / 8.0, "wi": F.lit(0.0)})
    op = Loop(Loop(matmul(w, 3, 8, "j", {}, "o"), "i", 8), "trace", 0)
    t = images(spark, d)
    return out(op.forward(Tensor(t.df, {"j": 8, "i": 8, "trace": 0})).df, "trace", "o", "i", re="re")


@query(f"WITH {LINES} SELECT trace, a.x % 2 AS b, a.x // 2 AS x, round(CASE a.x % 2 WHEN 0 THEN (3 * a.re - p.re) / 5 ELSE (2 * a.re - p.re) / 5 END, 6) + 0.0 AS re FROM lines a JOIN lines p USING (trace) WHERE p.x = a.x + 1 - 2 * (a.x % 2)")
def apply_r(spark, d):
    """The b dimension times the inverse of [[2, 1], [1, 3]]."""
    t = shape.split_dim(lines(spark, d), "x", 2, "y")
    t = Tensor(t.df.select("trace", F.col("x").alias("b"), F.col("y").alias("x"), "re", "im"), {"trace": 0, "b": 2, "x": 32})
    return out(sense.apply_inverse(t, [[2.0, 1.0], [1.0, 3.0]]).df, "trace", "b", "x", re="re")


@query(f"WITH {PAIRS} SELECT round(sum(re * re + im * im), 4) + 0.0 AS dot FROM pairs")
def dot_checked(spark, d):
    """A4, A5: a dot product by partial and final sums that must be real and finite."""
    t = pairs(spark, d)
    return spark.createDataFrame([(round(t.checked_dot(t), 4) + 0.0,)], "dot double")


@query(f"WITH {LINES} SELECT CAST(k AS INT) AS kind, a.trace, a.x, round(CASE k WHEN 0 THEN n.re - a.re WHEN 1 THEN a.re - p.re ELSE (n.re - p.re) / 2 END, 6) + 0.0 AS re FROM range(3) AS r(k), lines a LEFT JOIN lines n ON n.trace = a.trace AND n.x = a.x + 1 LEFT JOIN lines p ON p.trace = a.trace AND p.x = a.x - 1 WHERE (k = 1 OR a.x < 63) AND (k = 0 OR a.x > 0)")
def interior_differences(spark, d):
    """Forward, backward and central differences where both neighbours are."""
    t, df = lines(spark, d), None
    for k, kind in enumerate(("forward", "backward", "central")):
        part = differences.interior_difference(t, "x", kind).df.select(F.lit(k).alias("kind"), "trace", "x", "re")
        df = part if df is None else df.unionByName(part)
    return out(df, "kind", "trace", "x", re="re")


# ---- proximal operators ----


@query(f"WITH {LINES} SELECT CAST(b AS INT) AS block, trace, x, round(CASE b WHEN 0 THEN re ELSE sign(re) * greatest(abs(re) - 0.05e0, 0) END, 6) + 0.0 AS re FROM lines, range(2) AS r(b)")
def prox_stack(spark, d):
    """Nothing for one block, soft thresholding for the other."""
    t = _lines(spark, d)
    both = t.df.withColumn("block", F.lit(0)).unionByName(t.df.withColumn("block", F.lit(1)))
    op = prox.Stack([prox.Null(), prox.L1(0.1)], [S, S])
    return out(op.apply(0.5, Tensor(both.select("block", "x", "trace", "re", "im"), {"block": 2, **S})).df, "block", "trace", "x", re="re")


def _matrix_sql(name: str, m: np.ndarray) -> str:
    entries = ", ".join(f"({o}, {i}, CAST({float(m[o, i])!r} AS DOUBLE))" for o, i in zip(*np.nonzero(m)))
    return f"{name}(o, i, w) AS (VALUES {entries})"


_W4 = _matrix_sql("w", differences.wavelet_matrix(64, 4))


@query(f"WITH {LINES}, {_W4}, f AS (SELECT trace, o, sum(re * w) AS v FROM lines JOIN w ON x = i GROUP BY trace, o), s AS (SELECT trace, o, sign(v) * greatest(abs(v) - 0.05e0, 0) AS v FROM f) SELECT trace, CAST(i AS INT) AS x, round(sum(v * w), 5) + 0.0 AS re FROM s JOIN w USING (o) GROUP BY trace, i")
def prox_wavelets(spark, d):
    """Soft thresholds on the wavelets, and back."""
    op = prox.Transformed(differences.wavelets(spark, S, ["x"], 4), prox.L1(0.1))
    y = op.apply(0.5, _lines(spark, d)).df
    return y.select("trace", "x", rounded(F.col("re"), 5).alias("re"))


_PATCH = "SELECT g.trace, g.i, g.j, round(avg(p.re), 6) + 0.0 AS re FROM (SELECT *, {si} AS si, {sj} AS sj FROM images) g JOIN images p ON p.trace = g.trace AND p.i >= si AND p.i < si + 5 AND p.j >= sj AND p.j < sj + 5 GROUP BY g.trace, g.i, g.j"
_LOW = "least(greatest(CAST(floor(({c} - {s}) / 3.0) AS BIGINT) * 3 + {s} - 1, 0), 3)"


@query(f"WITH {IMAGES}, m AS ({_PATCH.format(si=_LOW.format(c='i', s=0), sj=_LOW.format(c='j', s=0))}) SELECT trace, CAST(i AS INT) AS i, CAST(j AS INT) AS j, re FROM m")
def patch_mean(spark, d):
    """Windows of 3 x 3 cells, each from the mean of the 5 x 5 patch about it."""
    y = prox.patches(images(spark, d), ["i", "j"], 5, 3, lambda a: np.full(a.shape, a.mean()))
    return out(y.df, "trace", "i", "j", re="re")


@query(f"WITH {IMAGES}, m AS ({_PATCH.format(si=_LOW.format(c='i', s=1), sj=_LOW.format(c='j', s=2))}) SELECT trace, CAST(i AS INT) AS i, CAST(j AS INT) AS j, re FROM m")
def patch_mean_shifted(spark, d):
    """The same with windows shifted by 1 and 2 cells, cut at the edges."""
    y = prox.patches(images(spark, d), ["i", "j"], 5, 3, lambda a: np.full(a.shape, a.mean()), {"i": 1, "j": 2})
    return out(y.df, "trace", "i", "j", re="re")


# ---- kernels and gridding ----

_I0 = "(1 + " + " + ".join(f"pow({{q}}, {k}) / CAST({float(math.factorial(k)) ** 2!r} AS DOUBLE)" for k in range(1, 13)) + ")"
_KB = f"CASE WHEN z * z <= 1 THEN {2.34 * math.pi * 4 * 2.0 / 2!r}e0 * {_I0.format(q='((1 - z * z) / 4)')} ELSE 0 END"
_NEAR = MAPPED + ", near AS (SELECT *, (c + m + 64) % 64 AS cell, (m - o) / 2 AS z FROM placed, (SELECT unnest([-2, -1, 0, 1, 2]) AS m))"


@query(f"WITH {_NEAR}, w AS (SELECT channel, cell, v, {_KB} AS w FROM near) SELECT channel, CAST(cell AS INT) AS cell, round(sum(v * w), 2) + 0.0 AS re FROM w WHERE w <> 0 GROUP BY channel, cell")
def grid_kaiser(spark, d):
    """Samples scattered under a Kaiser-Bessel kernel of width 4."""
    placed, n = fourier.coordinates(_points(spark, d), {"kx": "cell"}, 32, 2.0)
    w = placed.select("channel", "v", "cell", "cell_off", F.explode(F.array(*(F.lit(o) for o in range(-2, 3)))).alias("o"))
    k = kaiser_bessel((F.col("o") - F.col("cell_off")) / 2, 4, 2.0)
    g = w.select("channel", F.pmod(F.col("cell") + F.col("o"), F.lit(n)).alias("cell"), "v", k.alias("w")).filter("w <> 0").groupBy("channel", "cell").agg(F.sum(F.col("v") * F.col("w")).alias("re"))
    return g.select("channel", "cell", rounded(F.col("re"), 2).alias("re"))


@query(f"WITH {_NEAR}, w AS (SELECT event_id, cell, greatest(1 - abs(z), 0) AS w FROM near) SELECT event_id AS sample, CAST(cell AS INT) AS cell, round(w, 6) + 0.0 AS w FROM w WHERE w <> 0")
def grid_triangle(spark, d):
    """the weights of a triangular kernel of width 4."""
    w, _ = fourier.grid_weights(_points(spark, d), {"kx": "cell"}, 32, 2.0, 4, ("sample",), shape="triangle")
    return w.select(F.col("in_sample").alias("sample"), "cell", rounded(F.col("wr")).alias("w"))


_DECANT = "kern(c, o, w) AS (VALUES (0, -1, 0.25e0), (0, 0, 0.5e0), (0, 1, 0.25e0), (1, -1, 0.0e0), (1, 0, 1.0e0), (1, 1, -0.5e0))"


def _kernels(spark) -> Tensor:
    return from_numpy(spark, np.array([[0.25, 0.5, 0.25], [0.0, 1.0, -0.5]]), ["channel", "cell"])


@query(f"WITH {MAPPED}, {_DECANT}, g AS (SELECT c, sum(v) AS v FROM placed GROUP BY c), k AS (SELECT kern.c AS channel, (g.c + o + 64) % 64 AS cell, sum(v * w) AS v FROM g, kern GROUP BY 1, 2) SELECT event_id AS sample, CAST(k.channel AS INT) AS channel, round(k.v, 4) + 0.0 AS re FROM placed JOIN k ON k.cell = placed.c")
def grid_decant(spark, d):
    """The grid of all samples, convolved with each channel's k-space kernel and read back at the samples (top-hat)."""
    p = _points(spark, d)
    op = fourier.grid_decant(p.select("sample", "kx"), {"kx": "cell"}, 32, {"sample": 0}, _kernels(spark), 2.0, 1)
    plain = fourier.gridding(p.select("sample", "kx"), {"kx": "cell"}, 32, {"sample": 0}, 2.0, 1)
    grid = plain.adjoint(Tensor(p.select("sample", F.col("v").alias("re"), F.lit(0.0).alias("im")), {"sample": 0}))
    y = op.forward(Tensor(grid.df, {"cell": 64}))
    return y.df.select("sample", "channel", rounded(F.col("re"), 4).alias("re"))


_IMAGE = f"img AS (SELECT n AS x, cos(0.3e0 * n) AS v FROM range(32) AS r(n)), f AS (SELECT k AS cell, sum(v * cos(2 * {PI} * (x + 16 - 32) * (k - 32) / 64)) / 8 AS re, -sum(v * sin(2 * {PI} * (x + 16 - 32) * (k - 32) / 64)) / 8 AS im FROM img, range(64) AS s(k) GROUP BY k)"


@query(f"WITH {MAPPED}, {_DECANT}, {_IMAGE}, k AS (SELECT kern.c AS channel, (cell + o + 64) % 64 AS cell, sum(re * w) AS re, sum(im * w) AS im FROM f, kern GROUP BY 1, 2) SELECT event_id AS sample, CAST(k.channel AS INT) AS channel, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM placed JOIN k ON k.cell = placed.c")
def nufft_decant(spark, d):
    """an image to the samples of two channels, the sensitivities convolved in k-space."""
    p = _points(spark, d).select("sample", "kx")
    k = _kernels(spark).renamed({"cell": "x"})
    op = fourier.nufft_decant(p, {"kx": "x"}, 32, {"sample": 0}, k, 2.0, 1)
    x = spark.range(32).select(F.col("id").cast("int").alias("x"), F.cos(F.col("id") * 0.3).alias("re"), F.lit(0.0).alias("im"))
    return out(op.forward(Tensor(x, {"x": 32})).df, "sample", "channel", re="re", im="im")


# ---- bases ----


@query(f"SELECT CAST(k AS INT) AS b, CAST(p AS INT) AS trace, round(cos(a) / sqrt(20e0), 6) + 0.0 AS re, round(sin(a) / sqrt(20e0), 6) + 0.0 AS im FROM (SELECT k, p, {PI} * (k - 2) + 2 * {PI} * (8 + k - 10) * (5 + p - 10) / 20 AS a FROM range(4) AS r(k), range(10) AS s(p))")
def fourier_basis(spark, d):
    """Four harmonics over ten points, oversampled twice."""
    return cells(from_numpy(spark, G.fourier_basis(4, 10, 2), ["b", "trace"]), "b", "trace")


@query("SELECT round(sqrt(CAST(count(*) * 7 // 9 AS DOUBLE)), 9) + 0.0 AS scale FROM events")
def basis_scale(spark, d):
    """The whole part before the root; as many samples as events, 7 traces, 9 vectors."""
    return spark.createDataFrame([(round(G.basis_scale(read(spark, d, "events").count(), 7, 9), 9) + 0.0,)], "scale double")


@query("SELECT CAST(b - 1 AS INT) AS b, CAST((s - 1) * 2 + (t % 5 - 1) // 2 AS INT) AS trace, round([1, 4, 6, 4, 1][b + 1] * pow(t / 19.0e0, b) * pow(1 - t / 19.0e0, 4 - b), 6) + 0.0 AS re FROM (SELECT b, t, t // 5 AS s FROM range(5) AS r(b), range(20) AS q(t)) WHERE b BETWEEN 1 AND 3 AND s BETWEEN 1 AND 2 AND t % 5 BETWEEN 1 AND 3 AND (t % 5 - 1) % 2 = 0")
def basis_slice(spark, d):
    """Vectors 1 to 3; traces 1 and 3 of the segments 1 and 2, of five traces each."""
    b = G.bernstein(spark, 4, 20).select("b", F.lit(0).alias("sample"), "trace", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    t = sense.basis_slice(Tensor(b, {"b": 5, "sample": 1, "trace": 20}), 5, (1, 2, 1), b=(1, 3, 1), trace=(1, 3, 2))
    return out(t.df, "b", "trace", re="re")


@query(f"WITH {PAIRS}, l AS (SELECT trace, re, im, sqrt(re * re + im * im) AS m FROM pairs WHERE x = 31) SELECT p.trace, p.x AS t, round(CASE WHEN m > 0 THEN (p.re * l.re + p.im * l.im) / m ELSE p.re END, 6) + 0.0 AS v FROM pairs p JOIN l USING (trace)")
def image_courses(spark, d):
    """Each cell's course in phase with its last image."""
    t = pairs(spark, d)
    c = sense.time_courses(Tensor(t.df.withColumnRenamed("x", "t"), {"trace": 0, "t": 32}))
    return out(c, "trace", "t", v="v")


@query(f"WITH {PAIRS}, l AS (SELECT trace, re, im, sqrt(re * re + im * im) AS m FROM pairs WHERE x = 31), c AS (SELECT p.trace, p.x AS t, CASE WHEN m > 0 THEN (p.re * l.re + p.im * l.im) / m ELSE p.re END AS v FROM pairs p JOIN l USING (trace)) SELECT round(sum(v * v), 4) + 0.0 AS energy FROM c")
def basis_img(spark, d):
    """A full basis of the courses by their singular vectors holds all their energy."""
    t = pairs(spark, d)
    c = sense.time_courses(Tensor(t.df.withColumnRenamed("x", "t"), {"trace": 0, "t": 32}))
    b = stats.basis_from_courses(spark, c, ["trace"], "t", 32, 32)
    y = stats.apply_matrix(Tensor(c.select("trace", "t", F.col("v").alias("re"), F.lit(0.0).alias("im")), {"trace": 0, "t": 32}), "t", b)
    return y.df.agg(F.sum(F.col("re") * F.col("re")).alias("e")).select(rounded(F.col("e"), 4).alias("energy"))


# ---- solvers on a small system with a known answer ----

_RIGHT = "b AS (SELECT CAST(label AS INT) AS x, sum(CAST(vec_id AS DOUBLE)) / count(*) / 100 AS v FROM embeddings WHERE label < 8 GROUP BY label)"
_SOLVED = f"WITH {_RIGHT} SELECT x, round(v - (SELECT sum(v) FROM b) / (1 + (SELECT count(*) FROM b)), 4) + 0.0 AS re FROM b"


def _system(spark, d):
    """The identity plus one everywhere, and a right side of the channels' means."""
    w = spark.range(64).select(F.floor(F.col("id") / 8).cast("int").alias("o"), (F.col("id") % 8).cast("int").alias("i")).withColumns({"wr": F.when(F.col("o") == F.col("i"), 2.0).otherwise(1.0), "wi": F.lit(0.0)})
    b = read(spark, d, "embeddings").filter("label < 8").groupBy(F.col("label").cast("int").alias("x")).agg((F.sum(F.col("vec_id").cast("double")) / F.count("*") / 100).alias("re")).withColumn("im", F.lit(0.0))
    return matmul(w, 8, 8, "x", {}), Tensor(b, {"x": 8}).cut()


@query(_SOLVED)
def lsmr_system(spark, d):
    """O1, O2, O3: two bidiagonal steps solve a system with two eigenvalues."""
    a, b = _system(spark, d)
    return solvers.LSMR(a, iterations=3).run(b).df.select("x", rounded(F.col("re"), 4).alias("re"))


@query(_SOLVED)
def lsqr_system(spark, d):
    """O4."""
    a, b = _system(spark, d)
    return solvers.LSQR(a, iterations=3).run(b).df.select("x", rounded(F.col("re"), 4).alias("re"))


@query(_SOLVED)
def cg_system(spark, d):
    """O5."""
    a, b = _system(spark, d)
    return solvers.conjugate_gradients(a, b, 3).df.select("x", rounded(F.col("re"), 4).alias("re"))


# ---- sensitivities ----


@query(f"WITH {COILS}, t AS (SELECT * FROM coils), q AS (SELECT channel, k, sum(re * cos(a) + im * sin(a)) / sqrt(32e0) AS re, sum(im * cos(a) - re * sin(a)) / sqrt(32e0) AS im FROM (SELECT *, 2 * {PI} * (x - 16) * (k - 16) / 32 AS a FROM t, range(32) AS r(k)) GROUP BY channel, k) SELECT CAST(k - 12 AS INT) AS x, channel, round(re / 2, 6) + 0.0 AS re, round(im / 2, 6) + 0.0 AS im FROM q WHERE k BETWEEN 12 AND 19")
def maps_to_kernels(spark, d):
    """The maps' central spectrum as kernels of eight cells, no oversampling."""
    return cells(recon.maps_to_kernels(coils(spark, d), ["x"], 8, 1.0), "x", "channel")


@query(f"WITH {COILS}, q AS (SELECT channel, n, sum(re * cos(a) - im * sin(a)) / sqrt(64e0) AS re, sum(im * cos(a) + re * sin(a)) / sqrt(64e0) AS im FROM (SELECT *, 2 * {PI} * (x + 16 - 32) * (n - 32) / 64 AS a FROM coils, range(64) AS r(n)) GROUP BY channel, n) SELECT CAST(n AS INT) AS x, channel, round(re * sqrt(2e0), 6) + 0.0 AS re, round(im * sqrt(2e0), 6) + 0.0 AS im FROM q")
def kernels_to_maps(spark, d):
    """Kernels of 32 cells inflated to maps of 64."""
    return cells(recon.kernels_to_maps(coils(spark, d), ["x"], 64, 1.0), "x", "channel")


# ---- storage ----


@query(f"WITH {LINES} SELECT trace, round(re, 6) + 0.0 AS re FROM lines WHERE x = 7")
def store_slab(spark, d):
    """Lines written and one slab of them read, by an equality that reaches the scan."""
    at = _folder(spark)
    store.write_tensor(Tensor(lines(spark, d).df, {"trace": _size(read(spark, d, "embeddings"), "vec_id"), "x": 64}), at, "lines")
    return out(store.read_tensor(spark, at, "lines", slab={"x": 7}).df, "trace", re="re")


@query("SELECT name, rank, dims, CASE name WHEN 'lines' THEN (max(vec_id) + 1) || ',64' ELSE '32,4' END AS sizes FROM embeddings, (VALUES ('lines', 2, 'trace,x'), ('maps', 2, 'x,channel')) AS t(name, rank, dims) GROUP BY name, rank, dims")
def store_catalogue(spark, d):
    """Two tensors in one store, listed with order and dimensions."""
    at = _folder(spark)
    store.write_tensor(Tensor(lines(spark, d).df, {"trace": _size(read(spark, d, "embeddings"), "vec_id"), "x": 64}), at, "lines")
    store.write_tensor(coils(spark, d), at, "maps")
    return store.catalogue(spark, at)


@query("SELECT p_partkey AS at, p_name AS value FROM part")
def store_strings(spark, d):
    """Names written and read, with their places."""
    at = _folder(spark)
    store.write_strings(read(spark, d, "part").select(F.col("p_partkey").alias("at"), "p_name"), "p_name", at, "names")
    return store.read_strings(spark, at, "names")


@query(f"WITH {SAMPLES} SELECT event_id AS sample, round(kx, 6) + 0.0 AS kx, 32 AS matrix FROM samples")
def store_trajectory(spark, d):
    """Points written with the matrix they are for, and read."""
    at = _folder(spark)
    store.write_trajectory(_points(spark, d), ["kx"], at, [32])
    points, told = store.read_trajectory(spark, at)
    return points.select("sample", rounded(F.col("kx")).alias("kx"), F.lit(told["matrix"][0]).alias("matrix"))


@query("SELECT CAST(b AS INT) AS b, CAST(t AS INT) AS trace, round([1, 4, 6, 4, 1][b + 1] * pow(t / 49.0e0, b) * pow(1 - t / 49.0e0, 4 - b), 6) + 0.0 AS re FROM range(5) AS r(b), range(50) AS s(t)")
def store_basis(spark, d):
    """A basis and its matrix written and read."""
    at = _folder(spark)
    b = G.bernstein(spark, 4, 50).select("b", F.lit(0).alias("sample"), "trace", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    store.write_basis(b, at, np.eye(5))
    basis, r = store.read_basis(spark, at)
    if not np.array_equal(r, np.eye(5)):
        raise RuntimeError("the basis' matrix came back changed")
    return out(basis, "b", "trace", re="re")


@query(f"WITH {SAMPLES} SELECT event_id AS sample, round(v / 2, 6) + 0.0 AS w FROM samples")
def store_weights(spark, d):
    """Weights written, read with their shape checked, by the preconditioners' factory."""
    at, p = _folder(spark), _points(spark, d)
    n = {"sample": _size(p, "sample")}
    store.write_tensor(Tensor(p.select("sample", (F.col("v") / 2).alias("re"), F.lit(0.0).alias("im")), n), at, "weights")
    return out(recon.make_preconditioner(at, p, {"kx": "x"}, 32, n).df, "sample", w="re")


@query(f"WITH {KSPACE} SELECT CAST(channel AS INT) AS channel, round(avg(re), 6) + 0.0 AS mean FROM kspace GROUP BY channel")
def store_matrix(spark, d):
    """A small vector written twice under one name to the sink of inner steps, the second read to the driver."""
    at = _folder(spark)
    m = kspace(spark, d).df.groupBy(F.col("channel").cast("int").alias("channel")).agg(F.avg("re").alias("re")).withColumn("im", F.lit(0.0))
    t, sink = Tensor(m, {"channel": 4}), store.DebugSink(at)
    sink.write("mean", t)
    v = store.read_matrix(spark, at, sink.write("mean", t))
    return spark.createDataFrame([(i, round(float(x.real), 6) + 0.0) for i, x in enumerate(v)], "channel int, mean double")


# ---- primal-dual solvers, dictionary by a tree ----


def _primal_dual_sql(steps: int, lam: float, lad: bool = False, adaptive: bool = False, restart: int | None = None) -> str:
    """The steps over all lines, one after the other: b data, y and w duals, xx the image, mx, my, mw the averages of the period."""
    before = "coalesce(lag({c}) OVER s, last_value({c}) OVER (PARTITION BY trace ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
    grad = "((coalesce(lead({c}) OVER s, first_value({c}) OVER s) - {c}) / 2)"
    adj = f"(({before} - {{c}}) / 2)"
    over = "WINDOW s AS (PARTITION BY trace ORDER BY x)"
    data = "(y + sigma * (bar - b))"
    dual = f"{data} / greatest(abs({data}), 1.0e0)" if lad else f"{data} / (1 + sigma)"
    reg = f"(w + sigma * {grad.format(c='bar')})"
    with_ = [
        "v0 AS MATERIALIZED (SELECT trace, x, re AS b, 0.0e0 AS y, 0.0e0 AS w, 0.0e0 AS xx, 0.0e0 AS bar, 0.0e0 AS mx, 0.0e0 AS my, 0.0e0 AS mw FROM lines)",
        "s0 AS MATERIALIZED (SELECT 1 / sqrt(2.0e0) AS sigma, 1 / sqrt(2.0e0) AS tau, 0.5e0 AS change)",
    ]
    for k in range(1, steps + 1):
        n = (k - 1) % restart + 2 if restart else 2
        with_.append(f"y{k} AS MATERIALIZED (SELECT trace, x, b, xx AS x0, y AS y0, w AS w0, {dual} AS y, {lam}e0 * {reg} / greatest(abs({reg}), {lam}e0) AS w, mx, my, mw, sigma, tau FROM v{k - 1}, s{k - 1} {over})")
        with_.append(f"x{k} AS MATERIALIZED (SELECT *, x0 - tau * (y + {adj.format(c='w')}) AS xx FROM y{k} {over})")
        mean = ", ".join(f"m{c} + ({v} - m{c}) / {n} AS m{c}" for c, v in (("x", "xx"), ("y", "y"), ("w", "w")))
        end = bool(restart) and k % restart == 0
        again = "mx AS xx, mx AS bar, my AS y, mw AS w, mx, my, mw" if end else "xx, 2 * xx - x0 AS bar, y, w, mx, my, mw"
        with_.append(f"m{k} AS MATERIALIZED (SELECT trace, x, b, x0, xx, y, w, {mean} FROM x{k})")
        with_.append(f"v{k} AS MATERIALIZED (SELECT trace, x, b, {again} FROM m{k})")
        if adaptive:
            with_.append(f"d{k} AS MATERIALIZED (SELECT trace, x, x0 - xx AS dx, y0 - y AS dy, w0 - w AS dw, sigma, tau FROM x{k})")
            sides = f"dx / tau - dy AS p0, dx / tau - {adj.format(c='dw')} AS p1, dy / sigma - dx AS q0, dw / sigma - {grad.format(c='dx')} AS q1"
            with_.append(f"r{k} AS MATERIALIZED (SELECT sqrt(sum(p0 * p0 + p1 * p1)) AS p, sqrt(sum(q0 * q0 + q1 * q1)) AS q FROM (SELECT {sides} FROM d{k} {over}))")
            f = "CASE WHEN p > 1.5e0 * q THEN 1 - change WHEN p < q / 1.5e0 THEN 1 / (1 - change) ELSE 1.0e0 END"
            with_.append(f"s{k} AS MATERIALIZED (SELECT sigma * ({f}) AS sigma, tau / ({f}) AS tau, CASE WHEN p > 1.5e0 * q OR p < q / 1.5e0 THEN change * 0.95e0 ELSE change END AS change FROM s{k - 1}, r{k})")
        else:
            with_.append(f"s{k} AS MATERIALIZED (SELECT * FROM s{k - 1})")
    return f"WITH {LINES}, {', '.join(with_)} SELECT trace, x, round({'mx' if restart else 'xx'}, 6) + 0.0 AS re FROM v{steps}"


def _primal_dual(spark, d, **how):
    x = _lines(spark, d)
    reg = solvers.Regulariser(prox.L1(0.05), differences.gradient(spark, S, ["x"]))
    return out(solvers.PDHG(Identity(S), [reg], tol=0.0, **how).run(x).df, "trace", "x", re="re")


@query(_primal_dual_sql(4, 0.05, adaptive=True))
def pdhg_adaptive(spark, d):
    """Total variation of all lines at once, steps that follow the residuals."""
    return _primal_dual(spark, d, iterations=4, adaptive=True)


@query(_primal_dual_sql(3, 0.05, lad=True))
def pdhg_lad(spark, d):
    """The same with the absolute deviation as data term."""
    return _primal_dual(spark, d, iterations=3, lad=True)


@query(_primal_dual_sql(4, 0.05, restart=2))
def pdhg_restarted(spark, d):
    """Restarts to the averages."""
    return _primal_dual(spark, d, iterations=4, restart=2)


_TREE = (
    "WITH RECURSIVE " + LINES + ", atoms AS (SELECT label AS atom, x, avg(re) AS d FROM lines GROUP BY 1, 2), "
    "rows AS (SELECT atom, list(d ORDER BY x) AS v FROM atoms GROUP BY atom), "
    "unit AS (SELECT atom, list_transform(v, lambda y: y / sqrt(list_dot_product(v, v))) AS v FROM rows), "
    "node AS (SELECT CAST(1 AS BIGINT) AS id, list({'a': atom, 'v': v} ORDER BY atom) AS ms FROM unit UNION ALL "
    "SELECT id * 2 + side, CASE side WHEN 0 THEN lo ELSE hi END FROM (SELECT id, CASE len(ms) WHEN 2 THEN ms[1:1] ELSE list_filter(ms, lambda m: list_dot_product(m.v, one) >= list_dot_product(m.v, two)) END AS lo, "
    "CASE len(ms) WHEN 2 THEN ms[2:2] ELSE list_filter(ms, lambda m: list_dot_product(m.v, one) < list_dot_product(m.v, two)) END AS hi FROM ("
    "SELECT id, ms, one, ms[list_position(e, list_min(e))].v AS two FROM (SELECT id, ms, one, list_transform(ms, lambda m: list_dot_product(m.v, one)) AS e FROM ("
    "SELECT id, ms, ms[list_position(c, list_min(c))].v AS one FROM (SELECT id, ms, list_transform(ms, lambda m: list_dot_product(m.v, mid)) AS c FROM ("
    "SELECT id, ms, list_transform(range(64), lambda j: list_avg(list_transform(ms, lambda m: m.v[j + 1]))) AS mid FROM node WHERE len(ms) > 1)))))), (VALUES (0), (1)) AS s(side) WHERE len(lo) > 0 AND len(hi) > 0), "
    "tree AS (SELECT id, ms[1].a AS atom, list_transform(range(64), lambda j: list_avg(list_transform(ms, lambda m: m.v[j + 1]))) AS mid FROM node), "
    "walk AS (SELECT trace, list(re ORDER BY x) AS p, CAST(1 AS BIGINT) AS id FROM lines GROUP BY trace UNION ALL "
    "SELECT trace, p, CASE WHEN abs(list_dot_product(p, l.mid)) < abs(list_dot_product(p, r.mid)) THEN r.id ELSE l.id END FROM walk w JOIN tree l ON l.id = 2 * w.id JOIN tree r ON r.id = 2 * w.id + 1) "
    "SELECT trace, atom, round(list_dot_product(p, mid), 6) + 0.0 AS rho FROM walk JOIN tree USING (id) WHERE NOT EXISTS (SELECT 1 FROM tree c WHERE c.id = 2 * walk.id)"
)


@query(_TREE)
def dictionary_tree(spark, d):
    """Each line by a ball tree over the channel means."""
    t = lines(spark, d).df
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("trace"), F.col("label").alias("atom"))
    atoms = t.join(e, "trace").groupBy("atom", "x").agg(F.avg("re").alias("v"))
    return out(sense.dictionary_tree_match(t.select("trace", "x", F.col("re").alias("v")), atoms, "trace", "atom", "x"), "trace", "atom", rho="rho")
