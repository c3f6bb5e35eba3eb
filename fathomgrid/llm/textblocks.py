"""Vectorised word and byte hashing over blocks of whole texts (numpy over Arrow buffers, no loop over words)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (the finaliser of SplitMix64)."""
    x = np.asarray(x, U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A random-looking value for each byte, by rule.
BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BASE = U(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def blocks(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about limit bytes, or of one longer text. Null: empty."""
    for chunk_at, chunk in _chunks(texts):
        chunk = chunk.cast(pa.large_string()).fill_null("")
        n = len(chunk)
        if not n:
            continue
        _, where, data = chunk.buffers()
        where = np.frombuffer(where, np.int64)[chunk.offset : chunk.offset + n + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(where, where[at] + limit, "right")) - 1)
            yield chunk_at + at, data[where[at] : where[to]], where[at : to + 1] - where[at]
            at = to


def _chunks(texts):
    if isinstance(texts, pa.ChunkedArray):
        at = 0
        for c in texts.chunks:
            yield at, c
            at += len(c)
    else:
        yield 0, texts


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte and text index of each word; words never cross texts."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    word = ~SPACE[data]
    first = np.zeros(n, bool)
    cut = offsets[(offsets < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    first[cut] = True
    starts = np.flatnonzero(word & (~before | first))
    after = np.empty(n + 1, bool)
    after[-1] = True
    after[:-1] = ~word | first
    ends = np.flatnonzero(word & after[1:]) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, run: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial over random byte values, scrambled. Works through runs of words of about run bytes."""
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + run)))
        s, e = starts[at:to] - starts[at], ends[at:to] - starts[at]
        part = data[starts[at] : ends[to - 1]]
        length = e - s
        begin = np.zeros(len(part), np.int32)
        begin[s] = s
        inside = np.arange(len(part), dtype=np.int32) - np.maximum.accumulate(begin)
        value = BYTE[part]
        value[SPACE[part]] = 0
        value *= powers(int(max(inside.max(), length.max())) + 1)[inside]
        out[at:to] = mix(np.add.reduceat(value, s) + length.astype(U) * U(0xA24BAED4963EE407))
        at = to
    return out


def word_checks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, run: int = 1 << 18) -> np.ndarray:
    """A second 64-bit hash of each word, of another kind: the sum of scrambled values of its bytes and their places."""
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + run)))
        s, e = starts[at:to] - starts[at], ends[at:to] - starts[at]
        part = data[starts[at] : ends[to - 1]]
        begin = np.zeros(len(part), np.int32)
        begin[s] = s
        inside = np.arange(len(part), dtype=np.int32) - np.maximum.accumulate(begin)
        value = mix(BYTE[part] + inside.astype(U) * U(0x9E6C63D0876A9A47))
        value[SPACE[part]] = 0
        out[at:to] = mix(np.add.reduceat(value, s) ^ (e - s).astype(U))
        at = to
    return out


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive entries of h (len(h) - k + 1 of them), by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    p = powers(k, U(0xF1357AEA2E62A9C5))
    for i in range(k):
        out += h[i : i + n] * p[i]
    return mix(out)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space after each, and where each begins and ends there."""
    length = ends - starts
    to = np.cumsum(length + 1) - 1
    at = to - length
    out = np.full(int(to[-1]) + 1 if len(to) else 0, 32, np.uint8)
    total = int(length.sum())
    step = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(at, length) + step] = data[np.repeat(starts, length) + step]
    return out.tobytes(), at, to


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of true."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
