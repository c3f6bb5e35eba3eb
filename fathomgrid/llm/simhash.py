"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into blocks, each with a covering code: bits 0-22 and 23-45 have the perfect binary Golay code
(length 23, 4096 code words, covering radius 3), bits 46-63 the perfect Hamming code of length 15 (2048 code words, covering
radius 1) and three bits as they are. The nearest code words are the fingerprint's home anchor. Fingerprints at distance t or less differ
in at most t places, so one lies within the covering radius plus a share of t of each of the other's code words, and the shares add
up to t or less. Each fingerprint is replicated to all such anchors and compared with the fingerprints at home there. No
link is lost, no link is found twice, and only true links leave the join.

Scale: equal fingerprints are collapsed before the join, so copies cost one row. The Golay blocks give 2^24 anchors for 61 or so
replicas (t = 2); the last block makes them 2^38 for 204. Fingerprints at home at one anchor are compared with all that reach it, so
the last block is used where so many fingerprints meet at each of 2^24 that comparing them costs more than the replicas: the count
decides, the links are the same. The join is an equi-join by a shuffle, never a broadcast; its large partitions Spark's adaptive execution splits. A
fingerprint has at most 1 + 64 + 2016 others in reach.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, load, materialize, others, ship, small_or_shuffled
from .textblocks import LOWER, blocks, joined, word_spans

SEED = 42
#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101


def fingerprints_of(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    """The SimHash of each whole text as unsigned 64-bit integers (see fingerprint_documents)."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    for row, data, offsets in blocks(texts):
        low = LOWER[data]
        starts, ends, text = word_spans(low, offsets)
        if not len(starts):
            continue
        joined_words, at, to = joined(low, starts, ends)
        words = np.bincount(text, minlength=len(offsets) - 1)
        last = np.cumsum(words)
        first = last - words
        count = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
        begin = np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        end = np.minimum(begin + shingle, np.repeat(last, count)) - 1
        h = np.fromiter((digest(joined_words[s:e], SEED) for s, e in zip(at[begin].tolist(), to[end].tolist())), np.uint64, len(begin))
        filled = np.flatnonzero(count)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = (np.cumsum(count) - count)[filled]
        most = np.add.reduceat(bits, cut, axis=0, dtype=np.int32) * 2 > count[filled][:, None]
        out[row + filled] = np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint_documents(docs: DataFrame, text: str = "text", shingle: int = 3, name: str = "fp") -> DataFrame:
    """docs without text, with name: the SimHash of each whole text as a long (its 64 bits).

    A-Z is lower-cased; words are runs without white space; shingles of so many words, repeats included, space-joined
    (fewer words: the whole sequence); each is hashed by XXH64 (seed 42); a bit is set if it is in over half the hashes.
    Null, empty and blank texts: zero.
    """
    ship(docs.sparkSession)
    rest = others(docs, text, name)

    def run(batches):
        for b in batches:
            fp = fingerprints_of(b.column(text), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(fp)], [*rest, name])

    kinds = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest), f"`{name}` long"])
    return docs.select(*rest, text).mapInArrow(run, kinds)


def golay_syndrome(x: np.ndarray) -> np.ndarray:
    """Remainder of the polynomial x (23 bits) by the generator."""
    x = x.astype(np.uint32)
    for i in range(22, 10, -1):
        x = np.where((x >> np.uint32(i)) & np.uint32(1), x ^ np.uint32(GOLAY << (i - 11)), x)
    return x


def hamming_syndrome(x: np.ndarray) -> np.ndarray:
    """The exclusive or of the places (1 to 15) of the bits set among the lowest 15; further bits are as they are."""
    out = np.zeros(len(x), np.uint32)
    for i in range(15):
        out ^= ((x.astype(np.uint32) >> np.uint32(i)) & np.uint32(1)) * np.uint32(i + 1)
    return out


@dataclass(frozen=True)
class Code:
    """A perfect code of length and radius over the lowest bits of a block of size bits; each further bit is a word of its own."""

    size: int
    length: int
    radius: int
    syndromes: int
    syndrome: Callable[[np.ndarray], np.ndarray]

    def cosets(self, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """For each syndrome (rows) the errors that lead to code words, and by how much they are beyond the radius, at most reach."""
        words = np.arange(1 << self.size, dtype=np.uint32)
        inside = np.bitwise_count(words & np.uint32((1 << self.length) - 1)).astype(np.int8)
        excess = np.maximum(0, inside - self.radius) + np.bitwise_count(words >> np.uint32(self.length)).astype(np.int8)
        words, excess = words[excess <= reach], excess[excess <= reach]
        order = np.argsort(excess, kind="stable")
        words, excess = words[order], excess[order]
        s = self.syndrome(words)
        by = np.argsort(s, kind="stable")
        count = np.bincount(s, minlength=self.syndromes)
        errors = np.zeros((self.syndromes, count.max()), np.uint32)
        beyond = np.full((self.syndromes, count.max()), 99, np.int8)
        column = np.arange(len(words)) - np.repeat(np.cumsum(count) - count, count)
        errors[s[by], column] = words[by]
        beyond[s[by], column] = excess[by]
        return errors, beyond


TWO_BLOCKS = (Code(23, 23, 3, 2048, golay_syndrome),) * 2
ALL_BLOCKS = (*TWO_BLOCKS, Code(18, 15, 1, 16, hamming_syndrome))
#: Beyond so many fingerprints, eight at home at each of 2^24 anchors, all blocks are used.
CROWDED = 1 << 27


def anchors_of(fp: np.ndarray, reach: int, codes: tuple[Code, ...], cosets: list) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of all anchors in reach of each fingerprint; with reach 0 the home anchors, in order."""
    row, left, anchor = np.arange(len(fp)), np.full(len(fp), reach, np.int8), np.zeros(len(fp), np.uint64)
    shift = 0
    for code, (errors, beyond) in zip(codes, cosets):
        block = ((fp >> np.uint64(shift)) & np.uint64((1 << code.size) - 1)).astype(np.uint32)
        s = code.syndrome(block)
        at, k = np.nonzero(beyond[s[row]] <= left[:, None])
        row, left, anchor = row[at], left[at], anchor[at]
        left = left - beyond[s[row], k]
        anchor = anchor << np.uint64(code.size) | (block[row] ^ errors[s[row], k]).astype(np.uint64)
        shift += code.size
    return row, anchor.view(np.int64)


def near_links(fingerprints: DataFrame, distance: int = 2, name: str = "fp", codes: tuple[Code, ...] | None = None) -> DataFrame:
    """(u, v), u < v as longs: every pair of distinct values of the column whose 64 bits differ in 1 to distance places.

    codes: the blocks' codes, by the count of the values if not given; the links do not depend on it.
    """
    if not 0 <= distance <= 3:
        raise ValueError("distance is 0 to 3")
    ship(fingerprints.sparkSession)
    codes = codes or (ALL_BLOCKS if fingerprints.count() > CROWDED else TWO_BLOCKS)

    def placed(reach):
        def run(batches):
            cosets = [c.cosets(reach) for c in codes]
            for b in batches:
                fp = b.column(0).to_numpy(zero_copy_only=False)
                for at in range(0, len(fp), 4096):
                    part = fp[at : at + 4096]
                    row, anchor = anchors_of(part.view(np.uint64), reach, codes, cosets)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row])], ["anchor", "fp"])

        return run

    one = fingerprints.select(F.col(name).alias("fp"))
    home = one.mapInArrow(placed(0), "anchor long, fp long").withColumnRenamed("fp", "u")
    reach = one.mapInArrow(placed(distance), "anchor long, fp long").select(F.col("anchor").alias("near"), F.col("fp").alias("v"))
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance
    # Spark takes the replicas for as many bytes as the fingerprints, and would broadcast 61 or 204 times what it believes
    return home.join(reach.hint("merge"), (F.col("anchor") == F.col("near")) & (F.col("u") < F.col("v")) & close).select("u", "v")


def group_documents(docs: DataFrame, distance: int = 2, shingle: int = 3, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: id, fp long, component: smallest id among documents linked by fingerprints, itself included.

    Null ids: the row takes part; a component of null ids only is null. Repeated rows give repeated rows. Documents
    without words share fingerprint zero and link like any others. No rows: no rows.
    """
    return _grouped(docs.select(id, text), distance, shingle, id, text)


def _grouped(docs: DataFrame, distance: int, shingle: int, id: str, text: str) -> DataFrame:
    """The columns of docs but text, fp and component for each row."""
    fp = materialize(fingerprint_documents(docs, text, shingle), "simhash")
    distinct = materialize(fp.groupBy("fp").agg(F.min(id).alias("least")), "fps")
    links = near_links(distinct, distance)
    comp = connected_components(links)
    named = distinct.join(comp, distinct.fp == comp.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("class"))
    ids = named.groupBy("class").agg(F.min("least").alias("component"))
    table = materialize(named.join(ids, "class").select(F.col("fp").alias("f"), "component"), "classes")
    return fp.join(small_or_shuffled(table), fp.fp == F.col("f")).select(*fp.columns, "component")


def keep_one(docs: DataFrame, distance: int = 2, shingle: int = 3, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its group, repeated rows included; rows without an id stay.

    An id on rows of different texts is judged for each text. Columns and their order are those of docs.
    """
    own = docs.withColumn("_fathomgrid_o", F.xxhash64(text))
    g = _grouped(own.select(id, "_fathomgrid_o", text), distance, shingle, id, text)
    gone = g.filter(F.col(id) != F.col("component")).select(F.col(id).alias("_fathomgrid_gone"), F.col("_fathomgrid_o").alias("_fathomgrid_text")).distinct()
    on = (own[id] == F.col("_fathomgrid_gone")) & (F.col("_fathomgrid_o") == F.col("_fathomgrid_text"))
    return own.join(small_or_shuffled(materialize(gone, "gone")), on, "left_anti").select(*docs.columns)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = group_documents(load(spark, sf_dir, "documents"))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op2_simhash_near_dedup": op2_simhash_near_dedup}
ORACLES: dict[str, str] = {}
