"""What the operators of this subpackage share: the shared folder, materialised tables, connected components."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import shared_dir

#: White space of every word rule here: space and the bytes 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows go to Python workers in batches of about this many bytes, unless the session asks for less.
BATCH_BYTES = 8 << 20
#: Above this many bytes a side is joined by a shuffle, not broadcast.
BROADCAST_BYTES = 48 << 20

_shipped: set[str] = set()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Gives the executors this package's modules, once for each application, and bounds the bytes of Arrow batches."""
    sc = spark.sparkContext
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="fathomgrid-")
    path = os.path.join(folder, "fathomgrid_modules.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"fathomgrid/{f.relative_to(root)}")
    sc.addPyFile(path)


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of df that have none of these names: an operator's own columns replace those of the same name."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            delete_path(spark, path)
    except Exception:  # the JVM may be gone by then
        pass


def new_shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/fathomgrid-{tag}-{uuid.uuid4().hex}"
    atexit.register(_delete_at_exit, spark, path)
    return path


def list_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder of the shared ones; none if it is not there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_shared_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fathomgrid_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a materialised table that nothing reads any more."""
    path = getattr(df, "_fathomgrid_path", None)
    if path:
        delete_path(df.sparkSession, path)


def bytes_of(df: DataFrame) -> int:
    """Bytes of a materialised table's files."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(df._fathomgrid_path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def broadcast_bytes(view: DataFrame) -> int:
    """About how many bytes the hashed rows of a materialised side take in the driver: a key, a row and their places in the map for each row, and what is of any length."""
    longs = [F.octet_length(c) if k in ("string", "binary") else 8 * F.size(c) for c, k in view.dtypes if k in ("string", "binary") or k.startswith("array")]
    rows, more = view.agg(F.count("*"), F.coalesce(F.sum(sum(longs, F.lit(0)).cast("long")), F.lit(0))).first()
    return rows * (80 + 16 * len(view.columns)) + more


def small_or_shuffled(df: DataFrame, *columns) -> DataFrame:
    """These columns (all, if none are given) of a materialised side: broadcast if its files and its rows in memory are small, else joined by a shuffle whatever Spark's threshold.

    Files alone don't tell: copies and rising ids leave two or three bytes a row of zstd, of over a hundred in a broadcast.
    """
    view = df.select(*columns) if columns else df
    small = bytes_of(df) * 8 <= BROADCAST_BYTES and broadcast_bytes(view) <= BROADCAST_BYTES
    return F.broadcast(view) if small else view.hint("merge")


def np_components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest node reachable from each of n nodes over the undirected edges (u, v)."""
    label = np.arange(n)
    while True:
        lo = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], lo)
        np.minimum.at(new, label[v], lo)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            return label
        label = new


def _contract(batches):
    """Edges of each batch as a forest of stars: at most one edge a node."""
    for p in batches:
        if len(p):
            ids, at = np.unique(np.concatenate([p.u.to_numpy(), p.v.to_numpy()]), return_inverse=True)
            label = np_components(at[: len(p)], at[len(p) :], len(ids))
            far = label != np.arange(len(ids))
            yield pd.DataFrame({"u": ids[far], "v": ids[label[far]]})


def _state(edges: DataFrame) -> tuple:
    """Count and checksum of a table of edges: alike in two rounds, nothing moves any more."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (u, v), both long and not null.

    Alternating large-star and small-star rounds; each batch of edges is contracted to a forest first. Each round's
    edges (at most one a node, soon) are written to the shared folder; nothing comes to the driver but counts and sums.
    An empty input gives an empty result.
    """
    ship(edges.sparkSession)
    e = materialize(edges.filter("u <> v").mapInPandas(_contract, "u long, v long").distinct(), "cc")
    seen = _state(e)
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.filter("u <> m").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(small, "cc")
        now = _state(new)
        drop(e)
        e = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("the components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
