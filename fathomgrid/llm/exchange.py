"""Compact shuffles of hashed positions.

A unit is a block of whole texts. Its hashes are sorted, cut into buckets by their high bits and packed, each bucket's
part as one row of binary columns. A bucket's rows meet in one task, which answers each unit with positions; the answers
of a unit meet its own row again. Buckets are by hash, so a frequent passage costs one entry for each place where it
stands and no more, and no bucket grows with it alone. The number of buckets follows the bytes of the texts.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
ROW = "bucket long, unit long, kind byte, n long, a binary, b binary, c binary, d binary"
ARROW_ROW = pa.schema([("bucket", pa.int64()), ("unit", pa.int64()), ("kind", pa.int8()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
#: Bytes of packed entries that a bucket should hold.
BUCKET_BYTES = 32 << 20


def pack(x: np.ndarray) -> bytes:
    """The bytes of x, plane by plane: sorted or small numbers then compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unpack(b: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def unpack_all(parts, kind: str) -> np.ndarray:
    return np.concatenate([unpack(b, kind) for b in parts]) if parts else np.zeros(0, kind)


def bucket_of(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket (of n) and a further 32 bits of each hash."""
    return ((h >> U(32)) * U(n)) >> U(32), ((h * U(n)) >> U(32)).astype("<u4")


def buckets_for(texts: DataFrame, text: str, entry_bytes: float) -> int:
    """How many buckets the entries of all texts need, of entry_bytes for each byte of text; twice the shuffle's partitions at least."""
    total = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(2 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total * entry_bytes / BUCKET_BYTES))


def unit_key(number: int, *columns: np.ndarray) -> int:
    """The key of a task's unit of this number: no other unit has it, whatever rows it holds in whatever order; a repeated task gives it again."""
    context = TaskContext.get()
    digest = hashlib.blake2b(struct.pack("<qq", context.partitionId() if context else 0, number), digest_size=8)
    for c in columns:
        digest.update(np.ascontiguousarray(c))
    return int.from_bytes(digest.digest(), "little", signed=True)


def own_of(kind: np.ndarray, wanted: int = 1) -> int | None:
    """Where a unit's own row is among its rows; None if it has no rows but that one. Another unit's row under its key is an error."""
    own = np.flatnonzero(kind == wanted)
    if len(own) != 1:
        raise RuntimeError(f"a unit met {len(own)} rows of its own")
    return int(own[0]) if len(kind) > 1 else None


def runs_of(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first place of each run in it) of entries known by the 128 bits of h and g."""
    order = np.argsort(h)
    one, two = h[order], g[order]
    if len(h) and ((one[1:] == one[:-1]) & (two[1:] != two[:-1])).any():  # two values share 64 bits
        order = np.lexsort((g, h))
        one, two = h[order], g[order]
    new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(h) else np.zeros(0, bool)
    return order, np.flatnonzero(new)


def table(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of ARROW_ROW; columns left out at the end are null."""
    rows = [(*r, *[None] * (len(ARROW_ROW) - len(r))) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW_ROW.types)], schema=ARROW_ROW) if rows else pa.RecordBatch.from_pylist([], ARROW_ROW)


def parts(sorted_bucket: np.ndarray):
    """(bucket, slice) of each run in a sorted array of buckets."""
    if len(sorted_bucket):
        cut = np.flatnonzero(np.diff(sorted_bucket)) + 1
        for s, e in zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(sorted_bucket)]]).tolist()):
            yield int(sorted_bucket[s]), slice(s, e)
