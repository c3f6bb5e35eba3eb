"""Tensors on disk: Parquet with a JSON side-car, and the NIfTI-1 sink."""

from __future__ import annotations

import json
import math
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tensor import Tensor

HEADER = {"voxel_size": [1.0, 1.0, 1.0], "origin": [0.0, 0.0, 0.0], "direction": [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], "tr": 1.0}


def write_tensor(t: Tensor, path: str, name: str = "data", header: dict | None = None, meta: dict[str, float] | None = None, mode: str = "error", compression: str = "zstd") -> None:
    """Writes <path>/<name>.parquet and its description; a dimension of size 0 is an error."""
    if any(n < 1 for n in t.shape.values()):
        raise ValueError(f"empty dimension in {t.shape}")
    t.df.select(*t.dims, "re", "im").write.mode(mode).option("compression", compression).parquet(f"{path}/{name}.parquet")
    told = {"dims": t.dims, "shape": list(t.shape.values()), "info": HEADER | (header or {}), "meta": meta or {}}
    t.spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/{name}.json")


def describe(spark: SparkSession, path: str, name: str = "data") -> dict:
    """Dimensions, shape, header and meta of a stored tensor."""
    return json.loads(spark.read.text(f"{path}/{name}.json").first()[0])


def read_tensor(spark: SparkSession, path: str, name: str = "data", rank: int | None = None, slab: dict[str, int] | None = None) -> Tensor:
    """A stored tensor; slab: equality slices, which reach the Parquet scan and drop their dimensions."""
    told = describe(spark, path, name)
    if rank is not None and rank != len(told["dims"]):
        raise ValueError(f"{name} has rank {len(told['dims'])}, expected {rank}")
    t = Tensor(spark.read.parquet(f"{path}/{name}.parquet"), dict(zip(told["dims"], told["shape"])))
    for d, i in (slab or {}).items():
        if not 0 <= i < t.shape[d]:
            raise IndexError(f"{d} = {i} of {t.shape[d]}")
        t = t.chip(d, i)
    return t


def names(spark: SparkSession, path: str) -> list[str]:
    """The names of the tensors in a store, in order; none if it is not there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n.removesuffix(".json") for n in found if n.endswith(".json"))


def exists(spark: SparkSession, path: str, name: str = "data") -> bool:
    return name in names(spark, path)


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(name, rank, dims, sizes) of each tensor in a store."""
    rows = []
    for n in names(spark, path):
        told = describe(spark, path, n)
        if "dims" in told:
            rows.append((n, len(told["dims"]), ",".join(told["dims"]), ",".join(map(str, told["shape"]))))
    return spark.createDataFrame(rows, "name string, rank int, dims string, sizes string")


def read_into(target: Tensor, path: str, name: str = "data") -> Tensor:
    """A stored tensor in place of target, whose shape it must have."""
    t = read_tensor(target.spark, path, name)
    if t.shape != target.shape:
        raise ValueError(f"{name} is {t.shape}, expected {target.shape}")
    return t


def read_matrix(spark: SparkSession, path: str, name: str = "data", limit: int = 1 << 20) -> np.ndarray:
    """A stored tensor of rank 1 or 2 as an array on the driver; more than limit cells are an error."""
    t = read_tensor(spark, path, name)
    if not 1 <= len(t.dims) <= 2 or math.prod(t.shape.values()) > limit:
        raise ValueError(f"{name} of {t.shape} is not a small matrix")
    return t.to_numpy()


def _tell(spark: SparkSession, path: str, name: str, told: dict, mode: str = "error") -> None:
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/{name}.json")


def write_strings(df: DataFrame, column: str, path: str, name: str, mode: str = "error") -> None:
    """A column of strings; their order is kept by a running number only if df has a column `at`."""
    df.select(*(["at"] if "at" in df.columns else []), F.col(column).alias("value")).write.mode(mode).option("compression", "zstd").parquet(f"{path}/{name}.parquet")
    _tell(df.sparkSession, path, name, {"strings": True}, mode)


def read_strings(spark: SparkSession, path: str, name: str) -> DataFrame:
    if not describe(spark, path, name).get("strings"):
        raise ValueError(f"{name} holds no strings")
    return spark.read.parquet(f"{path}/{name}.parquet")


def write_trajectory(points: DataFrame, axes: list[str], path: str, matrix: list[int], voxel_size: list[float] | None = None, name: str = "trajectory", mode: str = "error") -> None:
    """(sample, trace, axes...) with the matrix it is for, one size an axis."""
    if len(matrix) != len(axes):
        raise ValueError("one matrix size an axis")
    keys = [c for c in ("sample", "trace") if c in points.columns]
    points.select(*keys, *axes).write.mode(mode).option("compression", "zstd").parquet(f"{path}/{name}.parquet")
    _tell(points.sparkSession, path, name, {"axes": axes, "matrix": matrix, "voxel_size": voxel_size or [1.0] * len(axes)}, mode)


def read_trajectory(spark: SparkSession, path: str, name: str = "trajectory") -> tuple[DataFrame, dict]:
    """The points, and what is told of them: axes, matrix, voxel_size."""
    told = describe(spark, path, name)
    if "matrix" not in told:
        raise ValueError(f"{name} is no trajectory")
    return spark.read.parquet(f"{path}/{name}.parquet"), told


def write_basis(basis: DataFrame, path: str, r: np.ndarray | None = None, mode: str = "error") -> None:
    """(b, sample, trace, re, im), and the matrix R if there is one."""
    basis.select("b", "sample", "trace", "re", "im").write.mode(mode).option("compression", "zstd").parquet(f"{path}/basis.parquet")
    told = {"basis": True} | ({} if r is None else {"r": [[[float(z.real), float(z.imag)] for z in row] for row in np.asarray(r, complex)]})
    _tell(basis.sparkSession, path, "basis", told, mode)


def read_basis(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray | None]:
    told = describe(spark, path, "basis")
    r = told.get("r")
    return spark.read.parquet(f"{path}/basis.parquet"), None if r is None else np.array([[complex(*z) for z in row] for row in r])


def read_weights(spark: SparkSession, path: str, samples: dict[str, int], name: str = "weights") -> Tensor:
    """Stored weights of samples, or of channels and samples; another shape is an error."""
    t = read_tensor(spark, path, name)
    rest = {d: n for d, n in t.shape.items() if d != "channel"}
    if rest != samples:
        raise ValueError(f"weights are for {rest}, the samples are {samples}")
    return t


class DebugSink:
    """Named tensors of a run's inner steps; a name that is there already gets -1, -2 and so on."""

    def __init__(self, path: str):
        self.path = path

    def write(self, name: str, t: Tensor) -> str:
        taken, n, k = set(names(t.spark, self.path)), name, 0
        while n in taken:
            k += 1
            n = f"{name}-{k}"
        write_tensor(t, self.path, n)
        return n


def write_log(spark: SparkSession, entries: list[tuple[str, str]], path: str, mode: str = "append") -> None:
    """(category, message) pairs as lines that log_lines() reads."""
    spark.createDataFrame([(f"[{c}] {m}",) for c, m in entries], "value string").coalesce(1).write.mode(mode).text(path)


def real_tensor(df: DataFrame, dims: list[str], value: str) -> Tensor:
    """A relation with a real value as a complex tensor; the shape is one more than each dimension's largest index."""
    top = df.agg(*(F.max(d) for d in dims)).first()
    return Tensor(df.select(*dims, F.col(value).cast("double").alias("re"), F.lit(0.0).alias("im")), {d: int(m or 0) + 1 for d, m in zip(dims, top)})


def nifti_bytes(volume: np.ndarray, header: dict | None = None) -> bytes:
    """A 3-D or 4-D real or complex array as a NIfTI-1 file."""
    h = HEADER | (header or {})
    complex_ = np.iscomplexobj(volume)
    a = volume.astype("<c8" if complex_ else "<f4")
    dims = [a.ndim, *a.shape, *[1] * (7 - a.ndim)]
    vox = [*h["voxel_size"], h["tr"]]
    head = bytearray(348)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, *dims)
    struct.pack_into("<hh", head, 70, 32 if complex_ else 16, 64 if complex_ else 32)
    struct.pack_into("<8f", head, 76, 1.0, *vox, 1.0, 1.0, 1.0)
    struct.pack_into("<f", head, 108, 352.0)
    struct.pack_into("<f", head, 112, 1.0)
    struct.pack_into("<B", head, 123, 2 | 8)
    struct.pack_into("<hh", head, 252, 0, 1)
    affine = np.array(h["direction"]) * np.array(h["voxel_size"])
    for r in range(3):
        struct.pack_into("<4f", head, 280 + 16 * r, *affine[r], h["origin"][r])
    head[344:348] = b"n+1\0"
    return bytes(head) + bytes(4) + a.tobytes(order="F")


def write_nifti(t: Tensor, path: str, dims: list[str], header: dict | None = None) -> None:
    """One volume or series (small by nature: a file of one image) from the driver."""
    if sorted(dims) != sorted(t.dims):
        raise ValueError("dims must name the tensor's dimensions")
    a = t.to_numpy().transpose([t.dims.index(d) for d in dims])
    with open(path, "wb") as f:
        f.write(nifti_bytes(a, header))


def log_lines(log: DataFrame, category: str | None = None) -> DataFrame:
    """Saved log lines (line), those of one category if given."""
    return log if category is None else log.filter(F.col("line").contains(f"[{category}]"))
