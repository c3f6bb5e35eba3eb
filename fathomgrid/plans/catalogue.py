"""Every registered query of the analytics engine: name to (spark, sf_dir) -> DataFrame, and its SQL twin."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import generators as G
from ..functions.columns import beta, exp_semi, kernel_norm, rounded, tukey
from ..operators import differences, fourier, prox, sense, shape, stats
from ..operators.linop import HStack, Identity, Scale, Subtract, VStack, compose, matmul
from ..tensor import Tensor, combine
from .tables import COILS, IMAGES, KSPACE, LINES, PAIRS, PI, SAMPLES, coils, images, kspace, lines, out, pairs, read, samples

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "grid_expsemi"
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def cells(t: Tensor, *keys: str) -> DataFrame:
    return out(t.df, *keys, re="re", im="im")


# ---- norms and dot products ----


@query("SELECT label, round(sqrt(sum(x * x)), 6) + 0.0 AS norm FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label")
def norm_channel(spark, d):
    """2-norm of each channel; a fold over the packed array, no explode."""
    e = read(spark, d, "embeddings")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return out(e.groupBy("label").agg(F.sqrt(F.sum(square)).alias("n")), "label", norm="n")


@query(f"WITH {LINES} SELECT trace, round(sqrt(sum(re * re)), 6) + 0.0 AS rss FROM lines GROUP BY trace")
def rss_embedding(spark, d):
    """A7."""
    return out(stats.rss(lines(spark, d), "x"), "trace", rss="v")


@query(f"WITH {PAIRS} SELECT a.label, round(sum(a.re * b.re + a.im * b.im), 6) + 0.0 AS re, round(sum(a.im * b.re - a.re * b.im), 6) + 0.0 AS im FROM pairs a JOIN pairs b ON b.trace = a.trace + 1 AND a.x = b.x GROUP BY a.label")
def dot_pairs(spark, d):
    """A2, A3: dot of each line with the next, summed by channel."""
    t = pairs(spark, d).df
    b = t.select((F.col("trace") - 1).alias("trace"), "x", F.col("re").alias("r2"), F.col("im").alias("i2"))
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("trace"), "label")
    j = t.join(b, ["trace", "x"]).join(e, "trace")
    g = j.groupBy("label").agg(F.sum(F.col("re") * F.col("r2") + F.col("im") * F.col("i2")).alias("re"), F.sum(F.col("im") * F.col("r2") - F.col("re") * F.col("i2")).alias("im"))
    return out(g, "label", re="re", im="im")


@query(f"WITH {KSPACE} SELECT channel, round(sum(re), 3) + 0.0 AS total, round(avg(re), 6) + 0.0 AS mean, round(min(re), 6) + 0.0 AS low, round(max(re), 6) + 0.0 AS high, round(sqrt(sum(re * re)), 4) + 0.0 AS norm FROM kspace GROUP BY channel")
def channel_summary(spark, d):
    """Sum, mean, extremes and norm of each channel."""
    k = kspace(spark, d).df.groupBy("channel").agg(F.sum("re").alias("s"), F.avg("re").alias("a"), F.min("re").alias("lo"), F.max("re").alias("hi"), F.sqrt(F.sum(F.col("re") * F.col("re"))).alias("n"))
    return k.select("channel", rounded(F.col("s"), 3).alias("total"), rounded(F.col("a")).alias("mean"), rounded(F.col("lo")).alias("low"), rounded(F.col("hi")).alias("high"), rounded(F.col("n"), 4).alias("norm"))


# ---- slices, pads, reshapes, merges ----


@query(f"WITH {LINES} SELECT trace, CAST((x - 4) // 3 AS INT) AS x, round(re, 6) + 0.0 AS re FROM lines WHERE x >= 4 AND x < 60 AND (x - 4) % 3 = 0")
def slice_strided(spark, d):
    """Start 4, size 56, stride 3."""
    return out(shape.slice_dim(lines(spark, d), "x", 4, 56, 3).df, "trace", "x", re="re")


@query(f"WITH {LINES} SELECT trace, CAST((x // 16 - 1) * 6 + (x % 16 - 2) // 2 AS INT) AS x, round(re, 6) + 0.0 AS re FROM lines WHERE x // 16 BETWEEN 1 AND 2 AND x % 16 BETWEEN 2 AND 13 AND (x % 16) % 2 = 0")
def slice_segment(spark, d):
    """Segments 1-2 of 16 cells, every second cell of 2-13 within."""
    return out(shape.slice_segments(lines(spark, d), "x", 16, (1, 2, 1), (2, 12, 2)).df, "trace", "x", re="re")


@query(f"WITH {LINES} SELECT trace, x - 56 AS x, round(re, 6) + 0.0 AS re FROM lines WHERE x >= 56")
def slice_negative(spark, d):
    """A negative start wraps."""
    return out(shape.slice_dim(lines(spark, d), "x", -8).df, "trace", "x", re="re")


@query(f"WITH {LINES} SELECT trace, round(re, 6) + 0.0 AS re FROM lines WHERE x = 7")
def slab_read(spark, d):
    """One index, the dimension dropped."""
    return out(lines(spark, d).chip("x", 7).df, "trace", re="re")


@query(f"WITH {LINES} SELECT trace, n AS x, round(coalesce(re, 0), 6) + 0.0 AS re FROM (SELECT DISTINCT trace, CAST(n AS INT) AS n FROM lines, range(80) AS r(n)) AS g LEFT JOIN lines USING (trace) WHERE lines.x = n - 8 UNION ALL SELECT trace, CAST(n AS INT) AS x, 0.0 AS re FROM (SELECT DISTINCT trace FROM lines), range(80) AS r(n) WHERE n < 8 OR n >= 72")
def pad_center(spark, d):
    """64 cells centred in 80, zeros made explicit."""
    t = lines(spark, d)
    p = shape.Pad({"trace": 0, "x": 64}, {"trace": 0, "x": 80}).forward(t)
    zero = t.df.select("trace").distinct().withColumn("x", F.explode(F.array(*(F.lit(i) for i in [*range(8), *range(72, 80)])))).withColumn("re", F.lit(0.0))
    return out(p.df.select("trace", "x", "re").unionByName(zero), "trace", "x", re="re")


@query(f"WITH {LINES} SELECT trace, x - 12 AS x, round(re, 6) + 0.0 AS re FROM lines WHERE x BETWEEN 12 AND 51")
def crop_center(spark, d):
    """P5."""
    return out(shape.Crop({"trace": 0, "x": 64}, {"trace": 0, "x": 40}).forward(lines(spark, d)).df, "trace", "x", re="re")


@query(f"WITH {IMAGES} SELECT trace, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(re, 6) + 0.0 AS re FROM images")
def reshape_2d(spark, d):
    """A line of 64 as 8 x 8."""
    t = shape.split_dim(lines(spark, d), "x", 8, "i")
    return out(t.df.withColumnRenamed("x", "j"), "trace", "i", "j", re="re")


@query(f"WITH {PAIRS} SELECT a.trace, a.x, round(b.re - a.re, 6) + 0.0 AS re, round(b.im - a.im, 6) + 0.0 AS im FROM pairs a JOIN pairs b ON a.trace = b.trace - 1 AND a.x = b.x")
def diff_vectors(spark, d):
    """Each line from the one after it."""
    t = pairs(spark, d)
    b = Tensor(t.df.withColumn("trace", F.col("trace") - 1), t.shape)
    return cells(shape.difference(t, b), "trace", "x")


@query(f"WITH {LINES}, n AS (SELECT max(trace) + 1 AS n FROM lines) SELECT trace, x, round(re, 6) + 0.0 AS re FROM lines UNION ALL SELECT trace + n, x, round(re * 0.5, 6) + 0.0 FROM lines, n")
def merge_traces(spark, d):
    """The lines appended to themselves at half scale."""
    t = lines(spark, d)
    n = t.df.agg(F.max("trace") + 1).first()[0]
    t = Tensor(t.df, {"trace": n, "x": 64})
    return out(shape.append(t, t, "trace", (1.0, 0.5)).df, "trace", "x", re="re")


@query(f"WITH {LINES} SELECT trace, x, round(re, 6) + 0.0 AS re FROM lines WHERE x IN (SELECT x FROM lines GROUP BY x HAVING avg(re) > 0)")
def mask_apply(spark, d):
    """Cells whose mean is above 0 are kept."""
    t = lines(spark, d)
    m = Tensor(t.df.groupBy("x").agg(F.avg("re").alias("re")).withColumn("im", F.lit(0.0)), {"x": 64})
    return out(shape.Mask(t.shape, m).forward(t).df, "trace", "x", re="re")


@query(f"WITH {PAIRS}, r AS (SELECT trace, re / sqrt(re * re + im * im) AS pr, im / sqrt(re * re + im * im) AS pi FROM pairs WHERE x = 0 AND re * re + im * im > 0) SELECT p.trace, x, round(re * pr + im * pi, 6) + 0.0 AS re FROM pairs p JOIN r USING (trace)")
def real_phase_ref(spark, d):
    """Real part after division by the phase of cell 0."""
    return out(shape.real_reference(pairs(spark, d), {"x": 0}).df, "trace", "x", re="re")


@query(f"WITH {PAIRS} SELECT trace, x, round(sqrt(re * re + im * im), 6) + 0.0 AS mag, round(atan2(im, re), 6) + 0.0 AS phase FROM pairs")
def components(spark, d):
    """P17."""
    t = pairs(spark, d)
    m, p = shape.component(t, "mag"), shape.component(t, "phase").withColumnRenamed("v", "p")
    return out(m.join(p, ["trace", "x"]), "trace", "x", mag="v", phase="p")


# ---- transforms ----

DFT = "SELECT trace, CAST(k AS INT) AS x, round(sum(re * cos(a) {m} im * sin(a)) / sqrt(32e0), 6) + 0.0 AS re, round(sum(im * cos(a) {p} re * sin(a)) / sqrt(32e0), 6) + 0.0 AS im FROM (SELECT *, 2 * {pi} * ((x - 16) * (k - 16)) / 32 AS a FROM pairs, range(32) AS r(k)) GROUP BY trace, k"
FORWARD, BACKWARD = DFT.format(m="+", p="-", pi=PI), DFT.format(m="-", p="+", pi=PI)


@query(f"WITH {PAIRS} {FORWARD}")
def dft_centered(spark, d):
    """the centred unitary transform as a weight relation."""
    t = pairs(spark, d)
    return cells(fourier.dft(spark, t.shape, "x").forward(t), "trace", "x")


@query(f"WITH {PAIRS} {BACKWARD}")
def dft_adjoint(spark, d):
    """F1, the other way."""
    t = pairs(spark, d)
    return cells(fourier.dft(spark, t.shape, "x").adjoint(t), "trace", "x")


@query(f"WITH {PAIRS} {FORWARD}")
def fft_packed(spark, d):
    """the same by numpy's FFT over packed lines."""
    t = pairs(spark, d)
    return cells(fourier.FFT(t.shape, ["x"]).forward(t), "trace", "x")


@query(f"WITH {PAIRS}, f AS ({FORWARD.replace('round(', '(').replace(', 6)', ')')}) SELECT trace, round(sum(re * re + im * im), 6) + 0.0 AS energy FROM f GROUP BY trace")
def parseval_check(spark, d):
    """the energy of each line, after the transform."""
    t = pairs(spark, d)
    y = fourier.dft(spark, t.shape, "x").forward(t)
    return out(y.df.groupBy("trace").agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("e")), "trace", energy="e")


@query(
    f"WITH {IMAGES}, a AS (SELECT trace, k AS i, j, sum(re * cos(t)) AS re, -sum(re * sin(t)) AS im FROM (SELECT *, 2 * {PI} * ((i - 4) * (k - 4)) / 8 AS t FROM images, range(8) AS r(k)) GROUP BY trace, k, j) "
    f"SELECT trace, CAST(i AS INT) AS i, CAST(k AS INT) AS j, round(sum(re * cos(t) + im * sin(t)) / 8, 6) + 0.0 AS re, round(sum(im * cos(t) - re * sin(t)) / 8, 6) + 0.0 AS im FROM (SELECT *, 2 * {PI} * ((j - 4) * (k - 4)) / 8 AS t FROM a, range(8) AS r(k)) GROUP BY trace, i, k"
)
def fft_2d(spark, d):
    """both axes of 8 x 8 images at once."""
    t = images(spark, d)
    return cells(fourier.FFT(t.shape, ["i", "j"]).forward(t), "trace", "i", "j")


# ---- gridding ----

MAPPED = SAMPLES + ", mapped AS (SELECT *, kx * 2 + 32 AS k, round_even(kx * 2 + 32, 0) AS ki FROM samples), placed AS (SELECT *, CAST(ki AS INT) AS c, k - ki AS o FROM mapped WHERE ki >= 0 AND ki < 64)"
KERNEL = f"CASE WHEN z * z <= 1 THEN exp({beta(4, 2.0)!r} * sqrt(greatest(1 - z * z, 0)) - 1) ELSE 0 END * {kernel_norm(4, 2.0)!r}"
WEIGHTS = MAPPED + f", near AS (SELECT *, (c + m + 64) % 64 AS cell, (m - o) / 2 AS z FROM placed, (SELECT unnest([-2, -1, 0, 1, 2]) AS m)), weights AS (SELECT event_id, channel, v, cell, {KERNEL} AS w FROM near)"


def _points(spark, d):
    return samples(spark, d).withColumnsRenamed({"event_id": "sample"})


def _data(points: DataFrame) -> Tensor:
    return Tensor(points.select("sample", "channel", F.col("v").alias("re"), F.lit(0.0).alias("im")), {"sample": 0, "channel": 8})


@query(MAPPED.join(["WITH ", " SELECT channel, c AS cell, round(sum(v), 4) + 0.0 AS re FROM placed GROUP BY channel, c"]))
def grid_tophat(spark, d):
    """Each sample to its nearest cell; 64 cells, 8 channels."""
    p = _points(spark, d)
    placed, _ = fourier.coordinates(p, {"kx": "cell"}, 32, 2.0)
    g = placed.groupBy("channel", "cell").agg(F.sum("v").alias("re"))
    return g.select("channel", "cell", rounded(F.col("re"), 4).alias("re"))


@query(f"WITH {WEIGHTS} SELECT channel, CAST(cell AS INT) AS cell, round(sum(v * w), 4) + 0.0 AS re FROM weights WHERE w <> 0 GROUP BY channel, cell")
def grid_expsemi(spark, d):
    """Samples scattered under a kernel of width 4. The samples are the weight relation's own rows, so nothing is joined: explode, weigh, sum."""
    p, n = _points(spark, d), 64
    placed, n = fourier.coordinates(p, {"kx": "cell"}, 32, 2.0)
    w = placed.select("channel", "v", "cell", "cell_off", F.explode(F.array(*(F.lit(o) for o in range(-2, 3)))).alias("o"))
    k = exp_semi((F.col("o") - F.col("cell_off")) / 2, 4, 2.0) * kernel_norm(4, 2.0)
    g = w.select("channel", F.pmod(F.col("cell") + F.col("o"), F.lit(n)).alias("cell"), "v", k.alias("w")).filter("w <> 0").groupBy("channel", "cell").agg(F.sum(F.col("v") * F.col("w")).alias("re"))
    return g.select("channel", "cell", rounded(F.col("re"), 4).alias("re"))


@query(f"WITH {WEIGHTS}, g AS (SELECT channel, cell, sum(v * w) AS re FROM weights GROUP BY channel, cell) SELECT event_id AS sample, x.channel, round(sum(w * re), 4) + 0.0 AS re FROM weights x JOIN g USING (channel, cell) WHERE w <> 0 GROUP BY event_id, x.channel")
def degrid_expsemi(spark, d):
    """The grid gathered back at the samples, each its own channel."""
    p = _points(spark, d)
    op = fourier.gridding(p, {"kx": "cell"}, 32, {"sample": 0}, 2.0, 4, {"channel": 8})
    y = op.adjoint(_data(p))
    w, _ = fourier.grid_weights(p.select("sample", "channel", "kx", "v"), {"kx": "cell"}, 32, 2.0, 4, ("sample", "channel"))
    j = w.select("cell", F.col("in_sample").alias("sample"), F.col("in_channel").alias("channel"), "wr").join(y.df, ["cell", "channel"])
    g = j.groupBy("sample", "channel").agg(F.sum(F.col("wr") * F.col("re")).alias("re"))
    return g.select("sample", "channel", rounded(F.col("re"), 4).alias("re"))


@query(f"WITH k AS (SELECT m, CASE WHEN m * m <= 4 THEN exp({beta(4, 2.0)!r} * sqrt(greatest(1 - m * m / 4.0e0, 0)) - 1) ELSE 0 END * {kernel_norm(4, 2.0)!r} AS w FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS m)) SELECT CAST(n AS INT) AS x, round(1 / greatest(abs(sum(w * cos(2 * {PI} * m * (n - 16) / 64))), 1e-3), 6) + 0.0 AS w FROM k, range(32) AS r(n) GROUP BY n")
def apodize_weights(spark, d):
    """the image's weights against the kernel."""
    return out(fourier.apodization(spark, 32, 2.0, 4, "x").df, "x", w="re")


@query(
    f"WITH {WEIGHTS}, g AS (SELECT channel, cell, sum(v * w) AS v FROM weights GROUP BY channel, cell), "
    f"f AS (SELECT channel, n AS x, sum(v * cos(2 * {PI} * (cell - 32) * (n + 16 - 32) / 64)) / 8 AS re, sum(v * sin(2 * {PI} * (cell - 32) * (n + 16 - 32) / 64)) / 8 AS im FROM g, range(32) AS r(n) GROUP BY channel, n), "
    f"ap AS (SELECT n AS x, 1 / greatest(abs(sum(w * cos(2 * {PI} * m * (n - 16) / 64))), 1e-3) AS a FROM (SELECT m, CASE WHEN m * m <= 4 THEN exp({beta(4, 2.0)!r} * sqrt(greatest(1 - m * m / 4.0e0, 0)) - 1) ELSE 0 END * {kernel_norm(4, 2.0)!r} AS w FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS m)), range(32) AS r(n) GROUP BY n) "
    "SELECT channel, CAST(f.x AS INT) AS x, round(re * a * sqrt(2e0), 4) + 0.0 AS re, round(im * a * sqrt(2e0), 4) + 0.0 AS im FROM f JOIN ap ON f.x = ap.x"
)
def nufft_adjoint_events(spark, d):
    """events to images of 32 cells by the adjoint NUFFT."""
    p = _points(spark, d)
    op = fourier.nufft(p.select("sample", "kx"), {"kx": "x"}, 32, {"sample": 0}, 2.0, 4, {"channel": 8})
    y = op.adjoint(_data(p))
    return y.df.select("channel", "x", rounded(F.col("re"), 4).alias("re"), rounded(F.col("im"), 4).alias("im"))


@query(f"WITH {SAMPLES} SELECT channel, CAST(n AS INT) AS x, round(sum(v * cos(a)) / sqrt(32e0), 4) + 0.0 AS re, round(sum(v * sin(a)) / sqrt(32e0), 4) + 0.0 AS im FROM (SELECT *, 2 * {PI} * kx * (n - 16) / 32 AS a FROM samples, range(32) AS r(n)) GROUP BY channel, n")
def ndft_events(spark, d):
    """The exact adjoint; each sample meets the 32 cells, and sums at once."""
    p = _points(spark, d).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(31))))
    a = F.col("kx") * (F.col("x") - 16) * (2 * math.pi / 32)
    g = p.groupBy("channel", "x").agg((F.sum(F.col("v") * F.cos(a)) / math.sqrt(32)).alias("re"), (F.sum(F.col("v") * F.sin(a)) / math.sqrt(32)).alias("im"))
    return g.select("channel", "x", rounded(F.col("re"), 4).alias("re"), rounded(F.col("im"), 4).alias("im"))


# ---- differences and wavelets ----


@query(f"WITH {LINES} SELECT trace, x, round((coalesce(lead(re) OVER w, first_value(re) OVER w) - re) / 2, 6) + 0.0 AS re FROM lines WINDOW w AS (PARTITION BY trace ORDER BY x)")
def grad_forward(spark, d):
    """Circular forward difference, by lead over each line."""
    return out(differences.circular_difference_by_window(lines(spark, d), "x", 0.5).df, "trace", "x", re="re")


@query(f"WITH {LINES} SELECT trace, x, round((coalesce(lag(re) OVER w, last_value(re) OVER (PARTITION BY trace ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) - re) / 2, 6) + 0.0 AS re FROM lines WINDOW w AS (PARTITION BY trace ORDER BY x)")
def grad_adjoint(spark, d):
    """W1, adjoint."""
    t = lines(spark, d)
    op = differences.gradient(spark, {"trace": 0, "x": 64}, ["x"])
    y = Tensor(t.df.withColumn("g", F.lit(0)), {"x": 64, "g": 1, "trace": 0})
    return out(op.adjoint(y).df, "trace", "x", re="re")


@query(f"WITH {IMAGES}, g AS (SELECT a.trace, a.i, a.j, 0 AS g, b.re - a.re AS v FROM images a JOIN images b ON a.trace = b.trace AND b.i = (a.i + 1) % 8 AND b.j = a.j UNION ALL SELECT a.trace, a.i, a.j, 1, b.re - a.re FROM images a JOIN images b ON a.trace = b.trace AND b.j = (a.j + 1) % 8 AND b.i = a.i) SELECT trace, CAST(i AS INT) AS i, CAST(j AS INT) AS j, g, round(v / (2 * sqrt(2e0)), 6) + 0.0 AS re FROM g")
def grad_2d(spark, d):
    """W1 on images, two components."""
    t = images(spark, d)
    return out(differences.gradient(spark, {"trace": 0, "i": 8, "j": 8}, ["i", "j"]).forward(Tensor(t.df, {"i": 8, "j": 8, "trace": 0})).df, "trace", "i", "j", "g", re="re")


@query(f"WITH {LINES} SELECT trace, x, round((re - coalesce(lag(re) OVER w, last_value(re) OVER (PARTITION BY trace ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))) / (2 * sqrt(2e0)), 6) + 0.0 AS re FROM lines WINDOW w AS (PARTITION BY trace ORDER BY x)")
def div_backward(spark, d):
    """Circular backward difference of one component."""
    op = differences.divergence(spark, {"trace": 0, "x": 64}, ["x"])
    return out(op.forward(Tensor(lines(spark, d).df.withColumn("g", F.lit(0)), {"x": 64, "g": 1, "trace": 0})).df, "trace", "x", re="re")


@query(
    f"WITH {IMAGES}, p AS (SELECT trace, i, j, 0 AS g, re FROM images UNION ALL SELECT trace, j, i, 1, re FROM images), "
    "b AS (SELECT a.trace, a.i, a.j, a.g, a.re - x.re AS di, a.re - y.re AS dj FROM p a JOIN p x ON x.trace = a.trace AND x.g = a.g AND x.i = (a.i + 7) % 8 AND x.j = a.j JOIN p y ON y.trace = a.trace AND y.g = a.g AND y.j = (a.j + 7) % 8 AND y.i = a.i), "
    "o AS (SELECT trace, i, j, 0 AS g, di AS v FROM b WHERE g = 0 UNION ALL SELECT trace, i, j, 1, dj FROM b WHERE g = 1 UNION ALL SELECT trace, i, j, 2, sum(CASE WHEN g = 1 THEN di ELSE dj END) / sqrt(2e0) FROM b GROUP BY trace, i, j) "
    "SELECT trace, CAST(i AS INT) AS i, CAST(j AS INT) AS j, g, round(v / 4, 6) + 0.0 AS re FROM o"
)
def gradvec2(spark, d):
    """The symmetrised gradient of the field (image, transposed image)."""
    t = images(spark, d).df
    two = t.select("trace", F.col("j").alias("i"), F.col("i").alias("j"), "re", "im").withColumn("g", F.lit(1))
    v = Tensor(t.withColumn("g", F.lit(0)).unionByName(two), {"i": 8, "j": 8, "g": 2, "trace": 0})
    return out(differences.gradient_of_vector(spark, {"trace": 0, "i": 8, "j": 8}, ["i", "j"]).forward(v).df, "trace", "i", "j", "g", re="re")


@query(f"WITH {LINES} SELECT trace, x, round(-(re / 3 - n / 6 - p / 6) / 2, 6) + 0.0 AS re FROM (SELECT *, lead(re) OVER w AS n, lag(re) OVER w AS p FROM lines WINDOW w AS (PARTITION BY trace ORDER BY x)) WHERE n IS NOT NULL AND p IS NOT NULL")
def laplacian_line(spark, d):
    """W4 along one axis."""
    t = lines(spark, d)
    return out(differences.laplacian(spark, {"trace": 0, "x": 64}, ["x"]).forward(Tensor(t.df, {"x": 64, "trace": 0})).df, "trace", "x", re="re")


@query(f"WITH {IMAGES} SELECT a.trace, CAST(a.i AS INT) AS i, CAST(a.j AS INT) AS j, round(sum(b.re * CASE abs(a.i - b.i) + abs(a.j - b.j) WHEN 0 THEN -200 WHEN 1 THEN 20 ELSE 6 END) / (48 * sqrt(28.3e0)), 6) + 0.0 AS re FROM images a JOIN images b ON a.trace = b.trace AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 WHERE a.i BETWEEN 1 AND 6 AND a.j BETWEEN 1 AND 6 GROUP BY a.trace, a.i, a.j")
def iso_stencil_2d(spark, d):
    """W5, its two-dimensional form."""
    t = images(spark, d)
    return out(differences.isotropic_laplacian(spark, {"trace": 0, "i": 8, "j": 8}, ["i", "j"]).forward(Tensor(t.df, {"i": 8, "j": 8, "trace": 0})).df, "trace", "i", "j", re="re")


def _wave_sql(width: int) -> str:
    c = differences.DAUBECHIES[width]
    r = [(-1) ** k * c[width - 1 - k] for k in range(width)]
    rows = ", ".join(f"({k}, {c[k]!r}e0, {r[k]!r}e0)" for k in range(width))
    return f"c AS (SELECT k, lo / sqrt(2e0) AS lo, hi / sqrt(2e0) AS hi FROM (VALUES {rows}) AS t(k, lo, hi))"


def _level(source: str, size: int, width: int) -> str:
    at = f"(2 * h - {width // 2} + k + {size}) % {size}"
    return (
        f"SELECT trace, CAST(h AS INT) AS x, sum(re * lo) AS re FROM {source}, c, range({size // 2}) AS r(h) WHERE x = {at} GROUP BY trace, h UNION ALL "
        f"SELECT trace, CAST(h + {size // 2} AS INT), sum(re * hi) FROM {source}, c, range({size // 2}) AS r(h) WHERE x = {at} GROUP BY trace, h UNION ALL SELECT trace, x, re FROM {source} WHERE x >= {size}"
    )


@query(f"WITH {LINES}, {_wave_sql(4)}, a AS ({_level('lines', 64, 4)}) SELECT trace, x, round(re, 6) + 0.0 AS re FROM a")
def wavelet_d4_level1(spark, d):
    """One level."""
    return out(differences.wavelet_level(spark, {"trace": 0, "x": 64}, "x", 64, 4).forward(Tensor(lines(spark, d).df, {"x": 64, "trace": 0})).df, "trace", "x", re="re")


_SIZES = (64, 32, 16, 8, 4)
_CHAIN = ", ".join(f"w{i} AS MATERIALIZED ({_level('lines' if i == 0 else f'w{i - 1}', s, 6)})" for i, s in enumerate(_SIZES))


@query(f"WITH {LINES}, {_wave_sql(6)}, {_CHAIN} SELECT trace, x, round(re, 6) + 0.0 AS re FROM w4")
def wavelet_d6_multi(spark, d):
    """All levels, lengths 64 to 4."""
    return out(differences.wavelets(spark, {"trace": 0, "x": 64}, ["x"], 6).forward(Tensor(lines(spark, d).df, {"x": 64, "trace": 0})).df, "trace", "x", re="re")


@query(f"WITH {LINES} SELECT trace, x, round(re, 4) + 0.0 AS re FROM lines")
def wavelet_inverse(spark, d):
    """The adjoint after the transform gives the lines back."""
    op = differences.wavelets(spark, {"trace": 0, "x": 64}, ["x"], 4)
    y = op.adjoint(op.forward(Tensor(lines(spark, d).df, {"x": 64, "trace": 0})))
    return y.df.select("trace", "x", rounded(F.col("re"), 4).alias("re"))


# ---- filters, windows, bases ----


@query(f"WITH {SAMPLES} SELECT event_id, round(v * CASE WHEN abs(kx) <= 4 THEN 1 WHEN abs(kx) <= 12 THEN (1.2e0 + 0.8e0 * cos({PI} * (abs(kx) - 4) / 8)) / 2 ELSE 0 END, 6) + 0.0 AS v FROM samples")
def tukey_filter(spark, d):
    """W12."""
    return out(samples(spark, d).withColumn("v", F.col("v") * tukey(F.abs("kx"), 4, 12, 0.2)), "event_id", v="v")


@query("WITH t AS (SELECT event_id AS trace, value AS v FROM events WHERE event_id < 1000), n AS (SELECT n AS nav, greatest(n * 50 - 40, 0) AS lo, least(n * 50 + 40, 1000) AS hi FROM range(20) AS r(n)) SELECT CAST(nav AS INT) AS nav, count(*) AS n, round(avg(v), 6) + 0.0 AS mean FROM t JOIN n ON trace >= lo AND trace < hi GROUP BY nav")
def nav_window(spark, d):
    """W10, G7, V19's join: traces by navigator windows that overlap."""
    t = read(spark, d, "events").filter("event_id < 1000").select(F.col("event_id").alias("trace"), F.col("value").alias("v"))
    w = sense.nav_windows(t, 20, 50, 80, 1000)
    return out(w.groupBy("nav").agg(F.count("*").alias("n"), F.avg("v").alias("m")), "nav", "n", mean="m")


@query("WITH t AS (SELECT event_id AS trace, value AS v FROM events), s AS (SELECT max(trace) + 1 AS size FROM t), n AS (SELECT n AS nav, greatest(n * 50 - 40, 0) AS lo, n * 50 + 40 AS hi FROM s, range(CAST(ceil(size / 50) AS BIGINT)) AS r(n)) SELECT CAST(nav AS INT) AS nav, count(*) AS n, round(avg(v), 6) + 0.0 AS mean FROM t JOIN n ON trace >= lo AND trace < hi GROUP BY nav")
def nav_window_all(spark, d):
    """nav_window over all events: as many navigators as they fill, where its SQL has 20 over 1000 traces."""
    t = read(spark, d, "events").select(F.col("event_id").alias("trace"), F.col("value").alias("v"))
    size = _size(t, "trace")
    w = sense.nav_windows(t, -(-size // 50), 50, 80, size)
    return out(w.groupBy("nav").agg(F.count("*").alias("n"), F.avg("v").alias("m")), "nav", "n", mean="m")


@query("SELECT CAST(b AS INT) AS b, CAST(b * 10 + t AS INT) AS trace, 1.0e0 AS v FROM range(6) AS r(b), range(5) AS s(t)")
def frames_basis(spark, d):
    """G5."""
    return G.frames(spark, 5, 6, 1)


@query("SELECT CAST((s + 4) // 16 AS INT) AS b, CAST(s AS INT) AS sample, 2.0e0 AS v FROM range(56) AS r(s)")
def echo_basis(spark, d):
    """4 echoes of 64 samples, a gap of 4."""
    return G.echoes(spark, 64, 4, 4, 56)


@query("SELECT CAST(b AS INT) AS b, CAST(t AS INT) AS trace, round([1, 4, 6, 4, 1][b + 1] * pow(t / 49.0e0, b) * pow(1 - t / 49.0e0, 4 - b), 6) + 0.0 AS v FROM range(5) AS r(b), range(50) AS s(t)")
def bernstein_basis(spark, d):
    """G1."""
    return out(G.bernstein(spark, 4, 50), "b", "trace", v="v")


@query("SELECT CAST(r AS INT) AS row, CAST(e AS INT) AS echo, round(exp(-e * 0.01e0 / (0.01e0 + r * 0.49e0 / 15)), 6) + 0.0 AS v FROM range(16) AS a(r), range(8) AS b(e)")
def kron_decay_table(spark, d):
    """G2, before its SVD."""
    return out(G.decay_table(spark, 16, 8, 0.01, 0.01, 0.5), "row", "echo", v="v")


@query("SELECT CAST(b * 5 + c AS INT) AS b, CAST(s AS INT) AS sample, CAST(t AS INT) AS trace, round(2.0e0 * [1, 4, 6, 4, 1][c + 1] * pow(t / 9.0e0, c) * pow(1 - t / 9.0e0, 4 - c), 6) + 0.0 AS v FROM (SELECT s // 4 AS b, s FROM range(16) AS r(s)), range(5) AS q(c), range(10) AS u(t)")
def basis_outer(spark, d):
    """Echoes by Bernstein polynomials."""
    return out(sense.basis_outer(G.echoes(spark, 16, 4), G.bernstein(spark, 4, 10), 5), "b", "sample", "trace", v="v")


@query("SELECT CAST(b AS INT) AS b, CAST(t AS INT) AS trace, round([1, 2, 1][b + 1] * pow(t / 9.0e0, b) * pow(1 - t / 9.0e0, 2 - b), 6) + 0.0 AS v FROM range(3) AS r(b), range(10) AS s(t) UNION ALL SELECT CAST(b + 3 AS INT), CAST(t AS INT), round([1, 1][b + 1] * pow(t / 9.0e0, b) * pow(1 - t / 9.0e0, 1 - b), 6) + 0.0 FROM range(2) AS r(b), range(10) AS s(t)")
def basis_concat(spark, d):
    """U2, U3."""
    return out(sense.basis_concat(G.bernstein(spark, 2, 10), G.bernstein(spark, 1, 10), 3), "b", "trace", v="v")


_BERN = "bern AS (SELECT b, t, [1, 7, 21, 35, 35, 21, 7, 1][b + 1] * pow(t / 9.0e0, b) * pow(1 - t / 9.0e0, 7 - b) AS w FROM range(8) AS r(b), range(10) AS s(t))"


@query(f"WITH {IMAGES}, {_BERN} SELECT trace, CAST(i AS INT) AS i, round(sum(re * w) * 2, 6) + 0.0 AS re FROM images JOIN bern ON j = b AND t = 3 GROUP BY trace, i")
def basis_blend(spark, d):
    """Coefficients (j) contracted with the basis at one time."""
    b = G.bernstein(spark, 7, 10).select("b", F.lit(0).alias("sample"), "trace", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    t = images(spark, d)
    img = Tensor(t.df.select(F.col("trace").alias("voxel"), "i", F.col("j").alias("b"), "re", "im"), {"voxel": 0, "i": 8, "b": 8})
    return out(sense.basis_blend(img, b, 0, 3, 2.0).df.withColumnRenamed("voxel", "trace"), "trace", "i", re="re")


@query(f"WITH {LINES}, {_BERN} SELECT CAST(b AS INT) AS b, trace % 7 AS channel, round(sum(re * w), 4) + 0.0 AS re FROM lines JOIN bern ON x % 10 = t WHERE w <> 0 GROUP BY b, trace % 7")
def basis_grid(spark, d):
    """Samples accumulated under a basis that repeats over them."""
    w = G.bernstein(spark, 7, 10).filter("v <> 0").select("b", F.col("trace").alias("t"), F.col("v").alias("w"))
    t = lines(spark, d).df.select((F.col("trace") % 7).alias("channel"), (F.col("x") % 10).alias("t"), "re")
    t = t.groupBy("channel", "t").agg(F.sum("re").alias("re"))
    g = t.join(F.broadcast(w), "t").groupBy("b", "channel").agg(F.sum(F.col("re") * F.col("w")).alias("re"))
    return g.select("b", "channel", rounded(F.col("re"), 4).alias("re"))


@query(f"WITH {LINES} SELECT trace, CAST(o AS INT) AS o, round(sum(re * (1 + o * x) / 64.0e0), 6) + 0.0 AS re FROM lines, range(4) AS r(o) GROUP BY trace, o")
def matmul_rows(spark, d):
    """A 4 x 64 matrix times each line."""
    w = spark.range(256).select((F.col("id") % 4).cast("int").alias("o"), F.floor(F.col("id") / 4).cast("int").alias("i"))
    w = w.select("o", "i", ((1 + F.col("o") * F.col("i")) / 64.0).alias("wr"), F.lit(0.0).alias("wi"))
    return out(matmul(w, 4, 64, "x", {"trace": 0}, "o").forward(Tensor(lines(spark, d).df, {"x": 64, "trace": 0})).df, "trace", "o", re="re")


# ---- sensitivities ----


@query(f"WITH {COILS} SELECT trace, p.x, channel, round(p.re * c.re - p.im * c.im, 6) + 0.0 AS re, round(p.re * c.im + p.im * c.re, 6) + 0.0 AS im FROM pairs p JOIN coils c ON p.x = c.x")
def sense_forward(spark, d):
    """J2."""
    op = sense.Sense(coils(spark, d), along={"trace": 0})
    return cells(op.forward(Tensor(pairs(spark, d).df, {"x": 32, "trace": 0})), "trace", "x", "channel")


@query(f"WITH {COILS} SELECT trace, p.x, round(sum(p.re * (c.re * c.re + c.im * c.im)), 6) + 0.0 AS re, round(sum(p.im * (c.re * c.re + c.im * c.im)), 6) + 0.0 AS im FROM pairs p JOIN coils c ON p.x = c.x GROUP BY trace, p.x")
def sense_normal(spark, d):
    """The adjoint after the forward operator."""
    op = sense.Sense(coils(spark, d), along={"trace": 0})
    return cells(op.adjoint(op.forward(Tensor(pairs(spark, d).df, {"x": 32, "trace": 0}))), "trace", "x")


@query(f"WITH {COILS} SELECT trace, p.x, round(sum(p.re * c.re + p.im * c.im), 6) + 0.0 AS re, round(sum(p.im * c.re - p.re * c.im), 6) + 0.0 AS im FROM (SELECT trace // 4 AS trace, trace % 4 AS channel, x, re, im FROM pairs) p JOIN coils c ON p.x = c.x AND p.channel = c.channel GROUP BY trace, p.x")
def sense_adjoint(spark, d):
    """Groups of four lines as channels, combined."""
    t = pairs(spark, d).df.select(F.floor(F.col("trace") / 4).alias("trace"), (F.col("trace") % 4).alias("channel"), "x", "re", "im")
    return cells(sense.Sense(coils(spark, d), along={"trace": 0}).adjoint(Tensor(t, {"x": 32, "trace": 0, "channel": 4})), "trace", "x")


@query(f"WITH {COILS}, s AS (SELECT x, sqrt(sum(re * re + im * im)) AS s FROM coils GROUP BY x) SELECT c.x, channel, round(re / s, 6) + 0.0 AS re, round(im / s, 6) + 0.0 AS im FROM coils c JOIN s ON c.x = s.x")
def sense_normalize(spark, d):
    """V11."""
    return cells(sense.normalised(coils(spark, d)), "x", "channel")


@query(f"WITH {PAIRS} SELECT trace, x, CAST(s AS INT) AS segment, round(re * cos(a) + im * sin(a), 6) + 0.0 AS re, round(im * cos(a) - re * sin(a), 6) + 0.0 AS im FROM (SELECT *, 2 * {PI} * (x - 16) * 0.01e0 * s FROM pairs, range(3) AS r(s)) AS t(trace, label, x, re, im, s, a)")
def f0_segments(spark, d):
    """Off-resonance phase by segment."""
    f = spark.range(32).select(F.col("id").cast("int").alias("x"), ((F.col("id") - 16) * 0.01).alias("f"))
    return cells(sense.Segments(f, {"trace": 0, "x": 32}, [0.0, 1.0, 2.0]).forward(pairs(spark, d)), "trace", "x", "segment")


# ---- statistics ----


@query(f"WITH {KSPACE} SELECT a.channel AS a, b.channel AS b, round(sum(a.re * b.re) / 3, 4) + 0.0 AS re FROM kspace a JOIN kspace b ON a.trace = b.trace AND a.sample = b.sample GROUP BY 1, 2")
def coil_gram(spark, d):
    """A9."""
    return stats.gram(kspace(spark, d), "channel").select("a", "b", rounded(F.col("re"), 4).alias("re"))


@query(f"WITH {KSPACE}, m AS (SELECT channel, avg(re) AS m FROM kspace GROUP BY 1), z AS (SELECT trace, sample, k2.channel, re - m AS v FROM kspace k2 JOIN m ON k2.channel = m.channel), g AS (SELECT a.channel AS a, b.channel AS b, sum(a.v * b.v) AS g FROM z a JOIN z b ON a.trace = b.trace AND a.sample = b.sample GROUP BY 1, 2) SELECT g.a, g.b, round(g.g / sqrt(p.g * q.g), 6) + 0.0 AS re FROM g JOIN g p ON p.a = g.a AND p.b = g.a JOIN g q ON q.a = g.b AND q.b = g.b")
def coil_corr(spark, d):
    """A9, correlation."""
    return out(stats.correlation(kspace(spark, d), "channel"), "a", "b", re="re")


def _otsu_sql(table: str, column: str) -> str:
    return (
        f"v AS (SELECT CAST({column} AS DOUBLE) AS v FROM {table}), t AS (SELECT b, b * (SELECT max(v) FROM v) / 127 AS t FROM range(128) AS r(b)), "
        "c AS (SELECT b, t, count(*) FILTER (v >= t) AS n1, count(*) FILTER (v < t) AS n0, var_samp(v) FILTER (v >= t) AS v1, var_samp(v) FILTER (v < t) AS v0 FROM v, t GROUP BY b, t), "
        "o AS (SELECT t AS threshold, n1 AS above FROM c WHERE n1 > 1 AND n0 > 1 ORDER BY round(n0 / (n0 + n1) * v0 + n1 / (n0 + n1) * v1, 9), b LIMIT 1)"
    )


@query(f"WITH {_otsu_sql('events', 'value')} SELECT round(threshold, 6) + 0.0 AS threshold, above FROM o")
def otsu_threshold(spark, d):
    """A13."""
    return out(stats.otsu(read(spark, d, "events").select(F.col("value").alias("v"))), "above", threshold="threshold").select("threshold", "above")


@query(f"WITH {_otsu_sql('documents', 'n_chars')} SELECT doc_id, CASE WHEN n_chars > threshold THEN 1 ELSE 0 END AS mask FROM documents, o")
def otsu_mask(spark, d):
    """Strictly above the threshold."""
    x = read(spark, d, "documents").select("doc_id", F.col("n_chars").alias("v"))
    return x.crossJoin(F.broadcast(stats.otsu(x).select("threshold"))).select("doc_id", F.when(F.col("v") > F.col("threshold"), 1).otherwise(0).alias("mask"))


_RANKS = "r AS (SELECT value AS v, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events)"


@query(f"WITH {_RANKS} SELECT p, v FROM r, (SELECT unnest([0.0e0, 0.25e0, 0.5e0, 0.9e0, 1.0e0]) AS p) WHERE k = CAST(floor(p * (n - 1)) AS BIGINT)")
def percentile_nearest(spark, d):
    """A11, A12, T3."""
    return stats.nearest_rank(read(spark, d, "events").select(F.col("value").alias("v")), [0.0, 0.25, 0.5, 0.9, 1.0])


@query(f"WITH {_RANKS}, q AS (SELECT max(v) FILTER (k = CAST(floor(0.5e0 * n) AS BIGINT)) AS med, max(v) FILTER (k = CAST(floor(0.9e0 * n) AS BIGINT)) AS p90, max(v) AS top FROM r) SELECT round(1 / CASE WHEN top - p90 < 2 * (p90 - med) THEN p90 ELSE top END, 9) + 0.0 AS scale FROM q")
def scale_bart(spark, d):
    """V5, by percentiles of the data."""
    s = stats.scale_bart(read(spark, d, "events").select(F.col("value").alias("v")), rule="data")
    return s.select(rounded(F.col("scale"), 9).alias("scale"))


@query(f"WITH {_otsu_sql('events', 'value')}, a AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n FROM v, o WHERE v > threshold) SELECT round(1 / v, 9) + 0.0 AS scale FROM a WHERE k = CAST(floor(0.5e0 * (n - 1)) AS BIGINT)")
def scale_otsu(spark, d):
    """V5, by the median of the foreground."""
    return stats.scale_otsu(read(spark, d, "events").select(F.col("value").alias("v"))).select(rounded(F.col("scale"), 9).alias("scale"))


@query("WITH c AS (SELECT sum(v) OVER (ORDER BY v DESC, label) / sum(v) OVER () AS c FROM (SELECT label, sum(x * x) AS v FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label)) SELECT count(*) FILTER (c < 0.9e0) AS n FROM c")
def cumulative_energy(spark, d):
    """A10, T5: how many of the strongest channels hold less than 90 % of the energy."""
    e = read(spark, d, "embeddings")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return stats.cumulative_below(e.groupBy("label").agg(F.sum(square).alias("v")), F.col("v").desc(), 0.9)


@query("WITH s AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS m, sum(o_totalprice) AS v FROM orders GROUP BY 1) SELECT m, round(v, 2) + 0.0 AS v FROM s ORDER BY v DESC, m LIMIT 5")
def top_frames(spark, d):
    """The five frames (months) of the greatest sum."""
    s = read(spark, d, "orders").groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("m")).agg(F.sum("o_totalprice").alias("v"))
    return s.orderBy(F.col("v").desc(), "m").limit(5).select("m", rounded(F.col("v"), 2).alias("v"))


@query(f"WITH {LINES}, atoms AS (SELECT label AS atom, x, avg(re) AS d FROM lines GROUP BY 1, 2), q AS (SELECT trace, atom, sum(re * d) AS rho FROM lines l JOIN atoms a ON l.x = a.x GROUP BY 1, 2) SELECT trace, atom, round(rho, 6) + 0.0 AS rho FROM (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY round(abs(rho), 9) DESC, atom) AS n FROM q) WHERE n = 1")
def dictionary_match(spark, d):
    """For each line the channel mean of the largest inner product."""
    t = lines(spark, d).df
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("trace"), F.col("label").alias("atom"))
    atoms = t.join(e, "trace").groupBy("atom", "x").agg(F.avg("re").alias("v"))
    return out(sense.dictionary_match(t.select("trace", "x", F.col("re").alias("v")), atoms, "trace", "atom", "x"), "trace", "atom", rho="rho")


# ---- proximal operators ----


@query(f"WITH {PAIRS}, m AS (SELECT *, sqrt(re * re + im * im) AS m FROM pairs) SELECT trace, x, round(CASE WHEN m > 0.15e0 THEN re * (1 - 0.15e0 / m) ELSE 0 END, 6) + 0.0 AS re, round(CASE WHEN m > 0.15e0 THEN im * (1 - 0.15e0 / m) ELSE 0 END, 6) + 0.0 AS im FROM m")
def prox_l1(spark, d):
    """R1."""
    return cells(prox.L1(0.3).apply(0.5, pairs(spark, d)), "trace", "x")


@query(f"WITH {PAIRS}, m AS (SELECT *, greatest(sqrt(re * re + im * im), 0.1e0) AS m FROM pairs) SELECT trace, x, round(re * 0.1e0 / m, 6) + 0.0 AS re, round(im * 0.1e0 / m, 6) + 0.0 AS im FROM m")
def prox_l1_conj(spark, d):
    """R1, conjugate."""
    return cells(prox.L1(0.1).conj(0.5, pairs(spark, d)), "trace", "x")


@query(f"WITH {PAIRS} SELECT trace, x, round(re, 6) + 0.0 AS re, round(sign(im) * greatest(abs(im) - 0.05e0, 0), 6) + 0.0 AS im FROM pairs")
def prox_l1i(spark, d):
    """R2."""
    return cells(prox.L1I(0.1).apply(0.5, pairs(spark, d)), "trace", "x")


@query(f"WITH {PAIRS}, m AS (SELECT *, sqrt(sum(re * re + im * im) OVER (PARTITION BY trace)) AS m FROM pairs) SELECT trace, x, round(CASE WHEN m > 0.5e0 THEN re * (1 - 0.5e0 / m) ELSE 0 END, 6) + 0.0 AS re, round(CASE WHEN m > 0.5e0 THEN im * (1 - 0.5e0 / m) ELSE 0 END, 6) + 0.0 AS im FROM m")
def prox_l2_block(spark, d):
    """Whole lines are shrunk."""
    return cells(prox.L2(1.0, ["x"]).apply(0.5, pairs(spark, d)), "trace", "x")


@query(f"WITH {PAIRS} SELECT a.trace, a.x, round((a.re + 0.5e0 * b.re) / 1.5e0, 6) + 0.0 AS re, round((a.im + 0.5e0 * b.im) / 1.5e0, 6) + 0.0 AS im FROM pairs a JOIN pairs b ON a.trace = b.trace AND b.x = (a.x + 1) % 32")
def prox_sos(spark, d):
    """Towards the lines moved by one cell."""
    t = pairs(spark, d)
    b = Tensor(t.df.withColumn("x", F.pmod(F.col("x") - 1, F.lit(32))), t.shape)
    return cells(prox.SumOfSquares(b).apply(0.5, t), "trace", "x")


@query(f"WITH {PAIRS}, m AS (SELECT *, sqrt(re * re + im * im) AS m FROM pairs) SELECT trace, x, round(re * least(1, 0.2e0 / m), 6) + 0.0 AS re, round(im * least(1, 0.2e0 / m), 6) + 0.0 AS im FROM m WHERE m > 0")
def prox_moreau(spark, d):
    """The conjugate of soft thresholding, by Moreau's identity."""
    t = pairs(spark, d)
    t = Tensor(t.df.filter("re <> 0 or im <> 0"), t.shape)
    return cells(prox.Conjugate(prox.L1(0.2)).apply(0.5, t), "trace", "x")


# ---- operator algebra ----


@query(f"WITH {LINES} SELECT trace, a.x, round(3 * a.re - b.re / 2 + c.re / 2, 6) + 0.0 AS re FROM lines a JOIN lines b USING (trace) JOIN lines c USING (trace) WHERE b.x = a.x AND c.x = (a.x + 63) % 64")
def vstack_adjoint(spark, d):
    """U4: blocks (3 I) and the gradient; the sum of both adjoints."""
    s = {"x": 64, "trace": 0}
    t = Tensor(lines(spark, d).df, s)
    op = VStack([Scale(s, 3.0), differences.gradient(spark, s, ["x"])])
    y = Tensor(t.df.select(F.lit(0).alias("block"), "x", "trace", F.lit(0).alias("g"), "re", "im").unionByName(t.df.select(F.lit(1).alias("block"), "x", "trace", F.lit(0).alias("g"), "re", "im")), op.oshape)
    return out(op.adjoint(y).df, "trace", "x", re="re")


@query(f"WITH {LINES} SELECT a.trace, a.x, round(2 * a.re - b.re, 6) + 0.0 AS re FROM lines a JOIN lines b ON a.trace = b.trace AND b.x = 63 - a.x")
def hstack_forward(spark, d):
    """[2 I, -I] of (line, reversed line)."""
    s = {"x": 64, "trace": 0}
    t = Tensor(lines(spark, d).df, s)
    op = HStack([Scale(s, 2.0), Scale(s, -1.0)])
    x = t.df.select(F.lit(0).alias("block"), "x", "trace", "re", "im").unionByName(t.df.select(F.lit(1).alias("block"), (63 - F.col("x")).alias("x"), "trace", "re", "im"))
    return out(op.forward(Tensor(x, op.ishape)).df, "trace", "x", re="re")


@query(f"WITH {LINES} SELECT a.trace, a.x, round(a.re - (b.re - a.re) / 2, 6) + 0.0 AS re FROM lines a JOIN lines b ON a.trace = b.trace AND b.x = (a.x + 1) % 64")
def subtract_op(spark, d):
    """Identity less the gradient, after two scales that merge."""
    s = {"x": 64, "trace": 0}
    g = differences.gradient(spark, s, ["x"])
    flat = matmul(spark.createDataFrame([(0, 0, 1.0, 0.0)], "o int, i int, wr double, wi double"), 1, 1, "g", s)
    drop = compose(Scale(s, 4.0), compose(Scale(s, 0.25), Identity(s)))
    t = Tensor(lines(spark, d).df, s)
    y = combine([(1, drop.forward(t)), (-1, Tensor(flat.forward(g.forward(t)).df.drop("g"), s))])
    return out(y.df, "trace", "x", re="re")


# ---- trajectories ----


@query(f"WITH {SAMPLES} SELECT event_id, CASE WHEN abs(kx) > 12 THEN NULL ELSE round(kx, 6) + 0.0 END AS kx FROM samples")
def trajectory_valid(spark, d):
    """Points beyond 12 are invalid (NaN; shown as null)."""
    v = sense.valid_points(samples(spark, d), ["kx"], 24)
    return v.select("event_id", F.when(~F.isnan("kx"), rounded(F.col("kx"))).alias("kx"))


@query(f"WITH {SAMPLES} SELECT channel, count(*) FILTER (sqrt(kx / 8 * (kx / 8) + v / 250 * (v / 250)) <= 1) AS kept, count(*) AS n FROM samples GROUP BY channel")
def downsample(spark, d):
    """Points within an ellipse over (k, value)."""
    p = sense.downsampled(samples(spark, d).withColumn("kv", F.col("v")), ["kx", "kv"], [8.0, 250.0])
    return p.groupBy("channel").agg(F.count(F.when(~F.isnan("kx"), 1)).alias("kept"), F.count("*").alias("n"))


@query(f"WITH {SAMPLES} SELECT min(event_id % 50) AS first_sample, max(event_id % 50) AS last_sample, min(event_id // 50) AS first_trace, max(event_id // 50) AS last_trace FROM samples WHERE abs(kx) <= 2 AND v < 20")
def trim_bounds(spark, d):
    """P14."""
    p = samples(spark, d).select((F.col("event_id") % 50).alias("sample"), F.floor(F.col("event_id") / 50).alias("trace"), F.when((F.abs("kx") <= 2) & (F.col("v") < 20), F.col("kx")).otherwise(F.lit(float("nan"))).alias("kx"))
    return sense.bounds(p, ["kx"])


@query(f"WITH {SAMPLES} SELECT greatest(CAST(2 * ceil(max(abs(kx))) AS BIGINT), 1) AS m_kx FROM samples")
def matrix_guess(spark, d):
    """A15."""
    return sense.guess_matrix(samples(spark, d), ["kx"])


@query(f"WITH {SAMPLES} SELECT event_id, round(v * cos(2 * {PI} * kx * 0.125e0), 6) + 0.0 AS re, round(v * sin(2 * {PI} * kx * 0.125e0), 6) + 0.0 AS im FROM samples")
def fov_shift(spark, d):
    """V15."""
    s = samples(spark, d).select("event_id", "kx", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    return out(sense.shifted(s, {"kx": 0.125}), "event_id", re="re", im="im")


@query("SELECT CAST(s AS INT) AS sample, CAST(t AS INT) AS trace, CAST(s - 4 AS DOUBLE) AS kx, CAST(t % 8 - 4 AS DOUBLE) AS ky, CAST(t // 8 - 4 AS DOUBLE) AS kz FROM range(8) AS a(s), range(64) AS b(t)")
def traj_cartesian(spark, d):
    """G17."""
    return G.cartesian(spark, 8)


# ---- phantoms and maps ----

_GRID = "g AS (SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(k AS INT) AS k, (i - 8) * 3.0e0 AS px, (j - 8) * 3.0e0 AS py, (k - 8) * 3.0e0 AS pz FROM range(16) AS a(i), range(16) AS b(j), range(16) AS c(k))"


@query(f"WITH {_GRID} SELECT i, j, k, CASE WHEN px * px + py * py + pz * pz < 400 AND k < 8 THEN 1.0e0 ELSE 0 END AS v FROM g")
def phantom_sphere(spark, d):
    """G15, a hemisphere."""
    return G.sphere(spark, 16, 3.0, 20.0, hemi=True)


@query(f"WITH {_GRID}, r AS (SELECT *, greatest(abs(px), abs(py), abs(pz)) / 24 AS m FROM g) SELECT i, j, k, round(CASE WHEN m * 3 <= 1 + 1e-9 THEN px / 24 * 3 + 2 WHEN m * 3 <= 2 + 1e-9 THEN py / 24 * 1.5e0 + 2 WHEN m <= 1 + 1e-9 / 3 THEN pz / 24 + 2 ELSE 0 END, 6) + 0.0 AS v FROM r")
def phantom_cubes(spark, d):
    """G16."""
    return out(G.gradient_cubes(spark, 16, 3.0, 24.0), "i", "j", "k", v="v")


_ELL = ", ".join(f"({','.join(f'{float(x)!r}e0' for x in e)})" for e in G.ELLIPSOIDS)


@query(f"WITH {_GRID}, e(cx, cy, cz, a, b, c, t, w) AS (VALUES {_ELL}), r AS (SELECT i, j, k, w, px / 23.0e0 - cx AS x, py / 23.0e0 - cy AS y, pz / 23.0e0 - cz AS z, a, b, c, t * {PI} AS t FROM g, e) SELECT i, j, k, sum(CASE WHEN pow((x * cos(t) + y * sin(t)) / a, 2) + pow((y * cos(t) - x * sin(t)) / b, 2) + pow(z / c, 2) < 1 THEN w ELSE 0 END) AS v FROM r GROUP BY i, j, k")
def phantom_shepp(spark, d):
    """G14."""
    return G.shepp_logan(spark, 16, 3.0, 23.0)


@query(
    f"WITH {_GRID}, c AS (SELECT *, (c // 4) AS ring, 2 * {PI} * (c % 4) / 4 AS th FROM g, range(8) AS r(c)), "
    f"v AS (SELECT *, px - 60 * cos(th) AS dx, py - 60 * sin(th) AS dy, pz - 48.0e0 * 2 * (-0.5e0 + (ring + 1.0e0) / 3.0e0) AS dz FROM c), "
    f"p AS (SELECT i, j, k, CAST(c AS INT) AS channel, 50 / sqrt(dx * dx + dy * dy + dz * dz) AS r, atan2(dx, dy) - 2 * {PI} * c / 8 AS a FROM v) SELECT i, j, k, channel, round(r * cos(a), 6) + 0.0 AS re, round(r * sin(a), 6) + 0.0 AS im FROM p"
)
def birdcage(spark, d):
    """8 channels in 2 rings."""
    return out(G.birdcage(spark, 16, 3.0, 8, 2, 60.0, 50.0).df, "i", "j", "k", "channel", re="re", im="im")


# ---- solvers and what SQL has no way to say ----


@query(
    f"WITH {LINES}, x0 AS (SELECT CAST(n AS INT) AS x, 0.125e0 AS v FROM range(64) AS r(n)), "
    + ", ".join(
        f"y{i} AS (SELECT trace, sum(re * v) AS y FROM lines l JOIN x{i} ON l.x = x{i}.x GROUP BY trace), u{i} AS (SELECT l.x, sum(re * y) AS v FROM lines l JOIN y{i} ON l.trace = y{i}.trace GROUP BY l.x), x{i + 1} AS (SELECT x, v / (SELECT sqrt(sum(v * v)) FROM u{i}) AS v FROM u{i})"
        for i in range(5)
    )
    + " SELECT round(sqrt(sum(v * v)), 4) + 0.0 AS value FROM u4"
)
def power_fixed_5(spark, d):
    """Five power steps of the lines' Gram operator from a flat start."""
    from ..operators.linop import Sparse
    from ..operators.solvers import power_method

    w = lines(spark, d).df.select("trace", F.col("x").alias("in_x"), F.col("re").alias("wr"), F.col("im").alias("wi"))
    op = Sparse(w, {"x": 64}, {"trace": 0}, {})
    start = Tensor(spark.range(64).select(F.col("id").cast("int").alias("x"), F.lit(0.125).alias("re"), F.lit(0.0).alias("im")), {"x": 64})
    value, _ = power_method(op, start, 5)
    return spark.createDataFrame([(round(value, 4),)], "value double")


def _size(df: DataFrame, key: str) -> int:
    """The least size of a dimension that holds all its indices."""
    last = df.agg(F.max(key)).first()[0]
    return 0 if last is None else last + 1


def _events_operator(spark, d):
    p = _points(spark, d).select("sample", "kx", "v")
    op = fourier.ndft(p.select("sample", "kx"), {"kx": "x"}, 8, {"sample": 0})
    return op, Tensor(p.select("sample", F.col("v").alias("re"), F.lit(0.0).alias("im")), {"sample": 0})


def _events_eigenvalue(spark, d) -> float:
    """The largest eigenvalue of that operator's 8 x 8 Gram matrix, whose entries depend on the distance of two cells only: 8 sums over the samples."""
    import numpy as np

    angle = [F.col("kx") * (2 * math.pi * k / 8) for k in range(8)]
    sums = [F.sum(f(a)) for a in angle for f in (F.cos, F.sin)]
    s = [x or 0.0 for x in _points(spark, d).filter(~F.isnan("kx")).agg(*sums).first()]
    lag = np.array([complex(*s[2 * k : 2 * k + 2]) for k in range(8)]) / 8
    gram = np.array([[lag[i - j] if i >= j else lag[j - i].conjugate() for j in range(8)] for i in range(8)])
    return float(np.linalg.eigvalsh(gram)[-1])


@query()
def lsmr_recon(spark, d):
    """Least squares of an 8-cell image from non-uniform samples."""
    from ..operators.solvers import LSMR

    op, b = _events_operator(spark, d)
    return cells(LSMR(op, iterations=4).run(b), "x")


@query()
def pdhg_tv(spark, d):
    """The same with a penalty on differences."""
    from ..operators.solvers import PDHG, Regulariser

    op, b = _events_operator(spark, d)
    g = differences.gradient(spark, {"x": 8}, ["x"])
    # the solver adds 1; 4 is the bound of the differences' own eigenvalues
    return cells(PDHG(op, [Regulariser(prox.L1(5.0), g)], iterations=3, eigenvalue=_events_eigenvalue(spark, d) + 3).run(b), "x")


@query()
def admm_tv(spark, d):
    """O6, R12."""
    from ..operators.solvers import ADMM, Regulariser

    op, b = _events_operator(spark, d)
    g = differences.gradient(spark, {"x": 8}, ["x"])
    return cells(ADMM(op, [Regulariser(prox.L1(5.0), g)], outer=1, inner=2, rho=1.0).run(b), "x")


@query()
def llr_denoise(spark, d):
    """Singular values of 4 x 4 patches over groups of lines, thresholded."""
    t = images(spark, d)
    x = Tensor(t.df.select((F.col("trace") % 4).cast("int").alias("b"), F.floor(F.col("trace") / 4).alias("trace"), "i", "j", "re", "im"), {"trace": 0, "i": 8, "j": 8, "b": 4})
    return cells(prox.LocallyLowRank(0.02, ["i", "j"], "b", 4).apply(1.0, x), "trace", "b", "i", "j")


@query()
def pca_compress(spark, d):
    """Four channels compressed to two by their principal components; energy by channel."""
    t = kspace(spark, d)
    m = stats.compression(t, "channel", 2)
    y = stats.apply_matrix(t, "channel", m)
    e = y.df.groupBy("channel").agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("e"))
    return e.select("channel", rounded(F.col("e"), 2).alias("energy"))


@query()
def rovir_ratio(spark, d):
    """Signal to interference of channel combinations, early against late traces."""
    t = kspace(spark, d)
    inside = Tensor(t.df.filter("trace % 2 = 0"), t.shape)
    outside = Tensor(t.df.filter("trace % 2 = 1"), t.shape)
    w, _ = stats.rovir(*(stats.small_matrix(stats.gram(x, "channel"), 4) for x in (inside, outside)))
    return spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(w)], "rank int, ratio double")


@query(f"WITH {LINES}, h AS (SELECT trace, x, re, md5('7:' || trace || ':' || x) AS h FROM lines), u AS (SELECT trace, x, re, (CAST('0x' || substr(h, 1, 12) AS BIGINT) + 0.5e0) / 281474976710656 AS a, (CAST('0x' || substr(h, 13, 12) AS BIGINT) + 0.5e0) / 281474976710656 AS b FROM h) SELECT trace, x, round(re + 0.1e0 * sqrt(-2 * ln(a)) * cos(2 * {PI} * b), 6) + 0.0 AS re, round(0.1e0 * sqrt(-2 * ln(a)) * sin(2 * {PI} * b), 6) + 0.0 AS im FROM u")
def noisify_lines(spark, d):
    """Seeded complex noise; the same for any partitioning."""
    return cells(G.noisify(lines(spark, d), 0.1, 7), "trace", "x")


@query()
def simulate_ir(spark, d):
    """Inversion-recovery signals for tissue rows."""
    tissues = spark.range(16).select("id", (0.5 + F.col("id") * 0.1).alias("T1"), F.lit(0.9).alias("Q"), F.lit(1.0).alias("B1"))
    seq = {"alpha": 0.05, "TR": 0.005, "Tramp": 0.01, "Tssi": 0.01, "spoil": 2, "spokes": 16, "segments": 2, "Trec": 1.0}
    return out(G.simulate(tissues, "ir", seq), "id", "trace", v="v")


@query(f"WITH e AS (SELECT i, i / 32.0e0 AS z FROM range(1, 32) AS r(i)), p AS (SELECT i, sum(0.5e0 / 32 * sqrt(1 / (1 - z * z) * (256 * {PI} - 1 / (1 - z * z)))) OVER (ORDER BY i) AS phi, asin(z) AS theta FROM e), a AS (SELECT 32 - i AS trace, phi, theta FROM p UNION ALL SELECT 32 + i, -phi, -theta FROM p UNION ALL SELECT 0, 0, {PI} / 2 UNION ALL SELECT 32, 0, 0) SELECT CAST(s AS INT) AS sample, CAST(trace AS INT) AS trace, round(s / 2.0e0 * cos(theta) * cos(phi), 6) + 0.0 AS kx, round(s / 2.0e0 * cos(theta) * sin(phi), 6) + 0.0 AS ky, round(s / 2.0e0 * sin(theta), 6) + 0.0 AS kz FROM a, range(16) AS q(s)")
def traj_spiral(spark, d):
    """G18."""
    return out(G.archimedean(spark, 16, 2.0, 64), "sample", "trace", kx="kx", ky="ky", kz="kz")


@query(f"WITH a AS (SELECT t AS trace, {PI} * (3 - sqrt(5e0)) * (2 * (t % 8) + t // 8) AS phi, asin(greatest(least(1 - (16.0e0 * (t % 8) + 2.0e0 * (t // 8)) / 63, 1), -1)) AS theta FROM range(64) AS r(t)) SELECT CAST(s AS INT) AS sample, CAST(trace AS INT) AS trace, round(s / 2.0e0 * cos(theta) * cos(phi), 6) + 0.0 AS kx, round(s / 2.0e0 * cos(theta) * sin(phi), 6) + 0.0 AS ky, round(s / 2.0e0 * sin(theta), 6) + 0.0 AS kz FROM a, range(16) AS q(s)")
def traj_phyllotaxis(spark, d):
    """G19."""
    return out(G.phyllotaxis(spark, 16, 2.0, 64, 3, 8), "sample", "trace", kx="kx", ky="ky", kz="kz")


@query(f"SELECT CAST(b AS INT) AS b, CAST(b * 10 - 10 + t AS INT) AS sample, round(pow(sin({PI} * t / 20), 2), 6) + 0.0 AS v FROM range(5) AS r(b), range(20) AS s(t) WHERE b * 10 - 10 + t BETWEEN 0 AND 39")
def time_windows(spark, d):
    """Five overlapping squared-sine windows over 40 samples."""
    from ..operators import recon

    return out(recon.time_windows(spark, 5, 40), "b", "sample", v="v")


@query(f"WITH {PAIRS} SELECT trace, x FROM (SELECT trace, x, row_number() OVER (PARTITION BY trace ORDER BY abs(im), x) AS n FROM pairs) WHERE n = 1")
def autofocus(spark, d):
    """The cell of the least imaginary part."""
    from ..operators import recon

    return recon.autofocus(pairs(spark, d), "x")


@query(f"WITH {SAMPLES}, t AS (SELECT *, channel * 0.05e0 AS d FROM samples) SELECT event_id, round(v * cos(2 * {PI} * -kx * d), 6) + 0.0 AS re, round(v * sin(2 * {PI} * -kx * d), 6) + 0.0 AS im FROM t")
def move_navigators(spark, d):
    """Every channel's samples turned (here mirrored) and shifted by its own navigator."""
    from ..operators import recon

    s = samples(spark, d).select("event_id", F.col("channel").alias("trace"), "kx", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    navs = spark.range(8).select(F.col("id").cast("int").alias("nav"), F.lit(-1.0).alias("r00"), (F.col("id") * 0.05).alias("d0"))
    return out(recon.move_by_navigator(s, navs, ["kx"], 1), "event_id", re="re", im="im")


@query()
def precon_events(spark, d):
    """V1, V4: density weights of the samples."""
    from ..operators import recon

    p = _points(spark, d).select("sample", "kx")
    return out(recon.preconditioner(p, {"kx": "x"}, 32, {"sample": _size(p, "sample")}).df, "sample", w="re")


@query()
def recon_rss_events(spark, d):
    """Least squares for each channel, then the root of the sum of squares.

    A residual would have a row for each event in each of 8 channels; the steps are taken from two sums over all events instead. Each row is a sample of its own.
    """
    from ..operators import recon

    p = _points(spark, d)
    data = p.select("channel", "kx", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    normal = fourier.ndft_normal(p.select("kx"), {"kx": "x"}, 8, {"channel": 8})
    image = fourier.ndft_adjoint(data, {"kx": "x"}, 8, {"channel": 8})
    norm = math.sqrt(data.agg(F.sum(F.col("re") * F.col("re"))).first()[0] or 0.0)
    return out(recon.recon_rss_normal(normal, image, norm, iterations=2), "x", rss="v")


@query(f"WITH {LINES}, k AS (SELECT m, n, sum(cos(a)) / 64 AS wr, sum(sin(a)) / 64 AS wi FROM (SELECT m, n, 2 * {PI} * q * ((m - 48) / 96.0e0 - (n - 32) / 64.0e0) AS a FROM range(96) AS r(m), range(64) AS s(n), range(-32, 32) AS t(q)) GROUP BY m, n) SELECT trace, CAST(m AS INT) AS x, round(sum(re * wr), 6) + 0.0 AS re, round(sum(re * wi), 6) + 0.0 AS im FROM lines JOIN k ON x = n GROUP BY trace, m")
def resample_lines(spark, d):
    """lines of 64 cells brought to 96 by padding their spectra."""
    from ..operators import recon

    return cells(recon.resample(lines(spark, d), {"x": 96}), "trace", "x")


def _spline_weights(knots: list[float], at: list[float]) -> list[tuple[int, float, float]]:
    """(knot, place, weight): a natural cubic spline is linear in its values, so its weights are the splines of unit vectors. From the first derivatives."""
    import numpy as np

    x, n = np.array(knots), len(knots)
    h = np.diff(x)
    left, right = np.zeros((n, n)), np.zeros((n, n))
    left[0, :2], left[-1, -2:] = (2, 1), (1, 2)
    right[0, :2], right[-1, -2:] = (-3 / h[0], 3 / h[0]), (-3 / h[-1], 3 / h[-1])
    for k in range(1, n - 1):
        left[k, k - 1 : k + 2] = 1 / h[k - 1], 2 / h[k - 1] + 2 / h[k], 1 / h[k]
        a, b = 3 / h[k - 1] ** 2, 3 / h[k] ** 2
        right[k, k - 1 : k + 2] = -a, a - b, b
    slope = np.linalg.solve(left, right)
    out = []
    for q in at:
        i = min(int(np.searchsorted(x, q)) - 1, n - 2)
        t = (q - x[i]) / h[i]
        w = ((1 + 2 * t) * (1 - t) ** 2) * np.eye(n)[i] + t * t * (3 - 2 * t) * np.eye(n)[i + 1]
        w = w + h[i] * (t * (1 - t) ** 2 * slope[i] - t * t * (1 - t) * slope[i + 1])
        out += [(int(k), q, float(v)) for k, v in zip(knots, w)]
    return out


_SPLINE = ", ".join(f"({k}, {q!r}, CAST({w!r} AS DOUBLE))" for k, q, w in _spline_weights([float(4 * i) for i in range(16)], [1.0, 2.0, 3.0, 30.5]))


@query(f"WITH {LINES}, w(x, q, w) AS (VALUES {_SPLINE}) SELECT trace, CAST(q AS DOUBLE) AS \"at\", round(sum(re * w), 6) + 0.0 AS v FROM lines JOIN w USING (x) GROUP BY trace, q")
def spline_lines(spark, d):
    """Every fourth cell, interpolated between."""
    from ..operators import recon

    t = lines(spark, d).df.filter("x % 4 = 0").select("trace", F.col("x").cast("double").alias("x"), "re")
    return out(recon.spline(t, "trace", "x", "re", [1.0, 2.0, 3.0, 30.5]), "trace", "at", v="v")


@query()
def decay_basis(spark, d):
    """The four-vector basis of a table of decays; its projection's energy for each row."""
    t = G.decay_table(spark, 16, 8, 0.01, 0.01, 0.5)
    import numpy as np

    a = np.zeros((16, 8))
    for r in t.collect():  # a table of 128 cells
        a[r.row, r.echo] = r.v
    b = stats.svd_basis(spark, a, 4)
    y = stats.apply_matrix(Tensor(t.select("row", "echo", F.col("v").alias("re"), F.lit(0.0).alias("im")), {"row": 16, "echo": 8}), "echo", b.conj())
    return out(stats.rss(y, "echo"), "row", energy="v")


from . import further  # noqa: E402, F401  registers its queries here
