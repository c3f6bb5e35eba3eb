"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine >= t differ by a squared distance of at most 2 (1 - t). Vectors are rotated by a fixed
orthogonal matrix and split into blocks of low dimension; each block gets the share of that budget that it has of the
dimensions. If every block were over its budget, so would be the whole: linked vectors are within budget in some block.
Each block is range-joined: some of its dimensions (the more, the more vectors there are: see grid_dims) are cut into cells, each vector is at home in one cell and replicated to
the cells within the block's radius that come after its own (of two cells, one comes after the other: a pair meets once).
Within a cell, tiles of home rows and of home rows and replicas are compared by one matrix product;
pairs within budget in this block and in no earlier one (so that no pair counts twice) are verified by their cosine
in double precision.

Scale: equal vectors are collapsed first. A cell's rows are dealt into tiles of bounded size by counts, so a crowded cell
becomes many tasks of the same size. A tile emits counts and a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, load, materialize, np_components, ship, small_or_shuffled
from .textblocks import mix

#: Rows of a tile's side, and how many of them are compared at once.
TILE = 8192
STRIP = 512
#: What a row is in its tile: a replica on the right, a home row on the left, a home row on both sides (cells of one tile), a home row on the right.
REPLICA, LEFT, BOTH, RIGHT = range(4)
#: What a replica costs in comparisons, and the share of pairs that meet in a cell for each dimension cut, where vectors have no structure.
REPLICA_COST = 1500
MEETING = 0.85
PLACED = "id long, b int, cell long, home boolean"
ARROW_PLACED = pa.schema([("id", pa.int64()), ("b", pa.int32()), ("cell", pa.int64()), ("home", pa.bool_())])
PACKED = "id long, m long, v binary"
FOUND = "u long, v long, n long"
ARROW_FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])


def rotation(d: int, seed: int = 7) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rotated(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """x @ q, term by term: the same vector gives the same bits wherever it is computed."""
    out = np.zeros((len(x), q.shape[1]))
    for k in range(q.shape[0]):
        out += x[:, k : k + 1] * q[k]
    return out


def grid_dims(n: int, size: int) -> int:
    """How many of a block's dimensions to cut for n vectors: each one cut leaves fewer comparisons a vector and makes more replicas of it.

    A ball of half a cell's width reaches sum over k of C(g, k) V(k) / 2^k cells of a grid of g dimensions, V(k) the unit ball's volume.
    """

    def cost(g: int) -> float:
        replicas = sum(math.comb(g, k) * math.pi ** (k / 2) / math.gamma(k / 2 + 1) / 2**k for k in range(g + 1))
        return REPLICA_COST * replicas + n * MEETING**g

    return min(range(1, min(size, 10) + 1), key=cost)


class Blocks:
    """The blocks of dimension d for cosine t: slices of rotated coordinates, squared-distance budgets, cells over the first `cut` dimensions."""

    def __init__(self, d: int, t: float, size: int, cut: int = 1):
        self.cut = cut
        self.slices = [slice(i, min(i + size, d)) for i in range(0, d, size)]
        total = 2 * (1 - t) + 1e-9
        self.budget = [total * (s.stop - s.start) / d for s in self.slices]
        self.q = rotation(d)

    def cells(self, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, home) of the home cell of each row and of the cells after it within the radius of block k."""
        r = np.sqrt(self.budget[k])
        g = y[:, self.slices[k]][:, : self.cut] / (2 * r)
        base = np.floor(g)
        inside = g - base
        rows, cells, home = [], [], []
        for move in np.ndindex(*(3,) * g.shape[1]):
            m = np.array(move) - 1
            if tuple(m) < (0,) * len(m):
                continue
            gap = np.where(m < 0, inside, np.where(m > 0, 1 - inside, 0))
            near = np.flatnonzero((gap**2).sum(1) <= 0.25 + 1e-9)
            at = (base[near] + m).astype(np.int64)
            code = np.zeros(len(near), np.uint64)
            for c in range(at.shape[1]):
                code = mix(code + at[:, c].view(np.uint64))
            rows.append(near)
            cells.append(code.view(np.int64))
            home.append(np.full(len(near), not m.any()))
        return np.concatenate(rows), np.concatenate(cells), np.concatenate(home)


def _place(d: int, t: float, size: int, cut: int):
    def run(batches):
        b = Blocks(d, t, size, cut)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = rotated(units(x), b.q)
            for k in range(len(b.slices)):
                row, cell, home = b.cells(y, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(np.full(len(row), k, np.int32)), pa.array(cell), pa.array(home)], schema=ARROW_PLACED)

    return run


def _pack(d: int):
    """Vectors as bytes: of single precision where that is exact."""

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            single = x.astype(np.float32)
            exact = (single == x).all(1)
            v = [s.tobytes() if e else r.tobytes() for s, r, e in zip(single, x, exact)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("m"), pa.array(v, pa.binary())], ["id", "m", "v"])

    return run


def _unpack(v: list[bytes], d: int) -> np.ndarray:
    if all(len(b) == 4 * d for b in v):
        return np.frombuffer(b"".join(v), np.float32).reshape(-1, d).astype(np.float64)
    return np.stack([np.frombuffer(b, np.float32 if len(b) == 4 * d else np.float64).astype(np.float64) for b in v])


def _tile(d: int, t: float, size: int):
    def run(group: pa.Table) -> pa.Table:
        """Links between the tile's home rows and its other side, each once: counts for each vector and a forest."""
        b = Blocks(d, t, size)
        k = group.column("b")[0].as_py()
        ids, m = group.column("id").to_numpy(), group.column("m").to_numpy()
        side = group.column("side").to_numpy()
        x = units(_unpack(group.column("v").to_pylist(), d))
        parts = b.slices[: k + 1]
        own = rotated(x, b.q[:, parts[k]])
        one, two = np.flatnonzero((side == LEFT) | (side == BOTH)), np.flatnonzero(side != LEFT)
        single = bool((side == BOTH).any())
        if single:  # both sides begin with the home rows by id: a strip meets only those from its own first on
            one = one[np.argsort(ids[one], kind="stable")]
            two = np.concatenate([one, np.flatnonzero(side == REPLICA)])
        if not len(one) or not len(two):
            return ARROW_FOUND.empty_table()
        # (u, -|u|^2 / 2, 1) . (v, 1, -|v|^2 / 2) is -d^2 / 2: one product and one comparison in single precision, with room for its error
        u, v = own[one], own[two]
        ones = np.ones((len(ids), 1))
        u = np.hstack([u, -(u * u).sum(1, keepdims=True) / 2, ones[: len(u)]]).astype(np.float32)
        v = np.hstack([v, ones[: len(v)], -(v * v).sum(1, keepdims=True) / 2]).astype(np.float32).T.copy()
        count = np.zeros(len(ids))
        i = j = np.zeros(0, np.int64)  # the links so far, as a forest
        for s in range(0, len(u), STRIP):
            first = s if single else 0
            near = np.flatnonzero((u[s : s + STRIP] @ v[:, first:]).ravel() >= np.float32(-b.budget[k] / 2 - 1e-5))
            a, c = one[s + near // (len(two) - first)], two[first + near % (len(two) - first)]
            way = (ids[a] < ids[c]) | (side[c] == REPLICA)
            a, c = a[way], c[way]
            for at in range(0, len(a), 1 << 15):
                p, q = a[at : at + (1 << 15)], c[at : at + (1 << 15)]
                mine = ((own[p] - own[q]) ** 2).sum(1) <= b.budget[k]
                p, q = p[mine], q[mine]
                for n, e in enumerate(parts[:-1]):  # not within budget in an earlier block
                    some, where = np.unique(np.concatenate([p, q]), return_inverse=True)
                    y = rotated(x[some], b.q[:, e])
                    new = ((y[where[: len(p)]] - y[where[len(p) :]]) ** 2).sum(1) > b.budget[n]
                    p, q = p[new], q[new]
                close = (x[p] * x[q]).sum(1) >= t
                p, q = p[close], q[close]
                count += np.bincount(p, weights=m[q], minlength=len(ids)) + np.bincount(q, weights=m[p], minlength=len(ids))
                label = np_components(np.concatenate([i, p]), np.concatenate([j, q]), len(ids))
                i = np.flatnonzero(label != np.arange(len(ids)))
                j = label[i]
        # a row may be on both sides: forests and counts are by id
        named, at = np.unique(ids, return_inverse=True)
        label = np_components(at[i], at[j], len(named))
        far = np.flatnonzero(label != np.arange(len(named)))
        total = np.bincount(at, weights=count, minlength=len(named)).astype(np.int64)
        some = np.flatnonzero(total)
        return pa.table({"u": np.concatenate([named[far], named[some]]), "v": pa.array([*named[label[far]].tolist(), *[None] * len(some)], pa.int64()), "n": np.concatenate([np.zeros(len(far), np.int64), total[some]])}, ARROW_FOUND)

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.95, block_dims: int = 16, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each row of vectors: id, n_links, component_id, kept.

    n_links: other rows whose vector has a cosine >= threshold with this one (exact copies included); component_id: the
    smallest id reachable by links, itself included; kept: it is the row's own. Vectors that are null, empty or zero or
    hold null or non-finite components link with nothing. Vectors of different length link with nothing. Null ids: no
    links, component null, kept true. Rows of one id are one vector each; they share a component. No rows: no rows. Ids are
    whole numbers; others raise as Spark's cast does.
    """
    spark = vectors.sparkSession
    if not 0 < threshold <= 1:
        raise ValueError("threshold is over 0, at most 1")
    ship(spark)
    own = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf")))
    sound = F.coalesce((F.size("x") > 0) & ~bad & F.exists("x", lambda a: a != 0), F.lit(False)) & F.col("id").isNotNull()
    # largest component 1: lengths neither overflow nor vanish in the squares
    scaled = F.transform("x", lambda a: a / F.array_max(F.transform("x", F.abs)))
    own = own.withColumn("x", F.when(sound, F.when(F.array_max(F.transform("x", F.abs)).between(1e-100, 1e100), F.col("x")).otherwise(scaled)))
    own = own.withColumns({"k1": F.when(sound, F.xxhash64("x")), "k2": F.when(sound, F.xxhash64(F.lit(1), "x"))})
    own = materialize(own, "vectors")
    # equal vectors are known by 128 bits, and each distinct one by a number from here on
    distinct = own.filter("k1 is not null").groupBy("k1", "k2").agg(F.min("id").alias("least"), F.count("*").alias("m"), F.first("x").alias("x"))
    distinct = materialize(distinct.withColumn("h", F.monotonically_increasing_id()), "distinct")
    found = None
    for d, n in distinct.groupBy(F.size("x")).count().collect():  # lengths of vectors: one, or a few
        same = distinct.filter(F.size("x") == d).select(F.col("h").alias("id"), "m", "x")
        placed = materialize(same.select("id", "x").mapInArrow(_place(d, threshold, min(block_dims, d), grid_dims(n, min(block_dims, d))), PLACED), "placed")
        packed = materialize(same.mapInArrow(_pack(d), PACKED), "packed")
        size = placed.groupBy("b", "cell").agg(F.count("*").alias("n"), F.count(F.when(F.col("home"), 1)).alias("nh")).filter("nh > 0 and n > 1")
        # cells are few next to rows: their sizes come to the rows, which are dealt only once, by tile
        both = placed.join(small_or_shuffled(materialize(size, "cells")), ["b", "cell"])
        salt = F.abs(F.hash("id"))
        both = both.withColumn("rows", F.ceil(F.col("nh") / TILE).cast("int")).withColumn("columns", F.ceil(F.col("n") / TILE).cast("int"))
        own_row, own_column = F.pmod(salt, "rows"), F.pmod(salt, "columns")

        def place(r, c, side):
            return F.struct(r.cast("int").alias("r"), c.cast("int").alias("c"), F.lit(side).alias("side"))

        def down(side):
            return F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: place(r, own_column, side))

        across = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda c: place(own_row, c, LEFT))
        single = (F.col("rows") == 1) & (F.col("columns") == 1)
        sides = F.when(~F.col("home"), down(REPLICA)).when(single, down(BOTH)).otherwise(F.concat(across, down(RIGHT)))
        tiles = both.select("id", "b", "cell", F.inline(sides))
        tiles = tiles.join(small_or_shuffled(packed), "id")
        part = tiles.groupBy("b", "cell", "r", "c").applyInArrow(_tile(d, threshold, min(block_dims, d)), FOUND)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    found = materialize(found, "links")
    links = found.filter("v is null").groupBy("u").agg(F.sum("n").alias("n"))
    comp = connected_components(found.filter("v is not null").select("u", "v"))
    classes = distinct.select("h", "k1", "k2", "least", "m").join(comp, F.col("h") == comp.node, "left").withColumn("c", F.coalesce("component", "h"))
    ids = classes.groupBy("c").agg(F.min("least").alias("component_id"))
    links = links.withColumnRenamed("u", "h")
    named = classes.join(ids, "c").join(links, "h", "left").select(F.col("k1").alias("g1"), F.col("k2").alias("g2"), "component_id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    out = own.join(small_or_shuffled(materialize(named, "named")), (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2")), "left")
    c = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), c.alias("component_id"), F.coalesce(c == F.col("id"), F.lit(True)).alias("kept"))


def op1_subspace_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(load(spark, sf_dir, "embeddings"))


QUERIES = {"op1_subspace_near_dedup": op1_subspace_near_dedup}
ORACLES = {
    "op1_subspace_near_dedup": """
WITH RECURSIVE raw AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
unit AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS l FROM raw),
link AS (SELECT a.vec_id AS u, b.vec_id AS v FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND list_dot_product(a.x, b.x) >= 0.95 * a.l * b.l AND a.l > 0 AND b.l > 0),
walk AS (SELECT vec_id AS u, vec_id AS v FROM raw UNION SELECT walk.u, link.v FROM walk JOIN link ON walk.v = link.u),
comp AS (SELECT u, min(v) AS c FROM walk GROUP BY u)
SELECT vec_id, (SELECT count(*) FROM link WHERE link.u = vec_id) AS n_links, c AS component_id, c = vec_id AS kept
FROM raw JOIN comp ON comp.u = vec_id"""
}
